"""Random draws that depend on a seed and a row, never on how rows are dealt out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, purpose: str, *row: Column) -> Column:
    """A number in [0, 1) with 53 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(purpose), *row), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def below(n: Column | int, seed: int, purpose: str, *row: Column) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, purpose, *row) * (F.lit(n) if isinstance(n, int) else n)).cast("int")


def gaussian(sd: float, seed: int, purpose: str, *row: Column) -> Column:
    """A normal number with mean 0."""
    u = F.lit(1.0) - uniform(seed, purpose + "-r", *row)
    return F.lit(float(sd)) * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * uniform(seed, purpose + "-a", *row))


def ticket(seed: int, purpose: str, *row: Column) -> Column:
    """A hash to order rows by."""
    return F.xxhash64(F.lit(seed), F.lit(purpose), *row)
