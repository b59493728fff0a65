"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte 3-grams and 4-grams, lower-cased in ASCII and hashed to
rows of an embedding table; the mean of the rows feeds a linear softmax. Both are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows. Since all
is linear, scoring folds table and weights into one table of class scores. A temperature
and a threshold for rejection come from rows of the sample that training leaves out.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, rows_of

#: Rows of the embedding table (a power of two) and its width.
BUCKETS, WIDTH = 1 << 15, 16
#: Labelled rows that are learned from, at most: those whose hashed id comes first.
SAMPLE = 6_000
EPOCHS, RATE, SEED = 8, 0.5, 7
#: The share of left-out rows that may be wrong among those accepted.
ERROR = 0.005

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LETTER = re.compile(r"[^\W\d_]")


def subwords(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The table rows of all byte 3-grams and 4-grams of the text between two spaces."""
    b = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(_LOWER) + b" ", np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    if len(b) < 3:
        return np.zeros(0, np.int64)
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    four = three[:-1] | b[3:] << np.uint32(24)
    return np.concatenate(((three * np.uint32(0x9E3779B1)) >> shift, (four * np.uint32(0x85EBCA77) ^ np.uint32(0x27D4EB2F)) * np.uint32(0x9E3779B1) >> shift)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, calibrated probability and whether it is accepted."""
        if not self.langs:
            return "und", 0.0, False
        rows = subwords(text, len(self.table))
        mean = np.bincount(rows, minlength=len(self.table)).astype(np.float32) @ self.table if len(rows) > 4096 else self.table[rows].sum(axis=0)
        p = _softmax((mean / max(1, len(rows)) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def shares(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The table rows that a text's subwords have, and the share of each."""
    rows, n = np.unique(subwords(text, buckets), return_counts=True)
    return rows, (n / max(1, n.sum())).astype(np.float32)


def train(counts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """A model of the given shares; every fifth row is left out for temperature and threshold."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    table = rng.uniform(-1, 1, (buckets, width)).astype(np.float32) / width
    weights, bias = np.zeros((width, len(names)), np.float32), np.zeros(len(names), np.float32)
    own = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(own):
            rows, share = counts[i]
            mean = share @ table[rows]
            error = _softmax(mean @ weights + bias)
            error[y[i]] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            table[rows] -= (step * 20 * share)[:, None] * back
    folded = table @ weights
    apart = np.flatnonzero(held) if held.any() else own
    logits = np.array([share @ folded[rows] for rows, share in (counts[i] for i in apart)]) + bias
    truth = y[apart]
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = _softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= ERROR)
    threshold = float(p.max(axis=1)[order[fine[-1]]]) if len(fine) else 1.0
    return Model(names, folded, bias, float(temperature), threshold)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from columns doc_id, text and lang; rows with a null in any, or an empty text or lang, are left out.

    The ids of the sample are chosen first and broadcast, so texts never reach the driver:
    it gets the shares of at most `sample` rows. Without a row to learn from the model
    knows no language and takes every text for `und`.
    """
    rows = labelled.where("doc_id is not null and text is not null and lang is not null and lang <> '' and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    chosen = rows.select(F.col("doc_id").alias("chosen")).orderBy(F.xxhash64("chosen"), "chosen").limit(sample).distinct()
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("rows", pa.binary()), ("share", pa.binary())])

    def run(batches):
        def each():
            for doc_id, text, lang in rows_of(batches, "doc_id", "text", "lang"):
                at, share = shares(text)
                yield doc_id, lang, at.astype("<i4").tobytes(), share.tobytes()

        yield from batched(each(), schema)

    picked = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))  # at most `sample` numbers
    made = picked.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, rows binary, share binary")
    # a repeated id may have many rows, so the sample is cut once more
    seen = made.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "rows").limit(sample).collect()
    if not seen:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    seen.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.lang, r.rows))
    return train([(np.frombuffer(r.rows, "<i4"), np.frombuffer(r.share, np.float32)) for r in seen], [r.lang for r in seen])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the probability) and accepted (not rejected) for every row.

    A text that is null or has no letter, or any text if nothing was learned, gets `und`,
    score 0 and is not accepted. Repeated rows and null ids are kept; no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value

        def each():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                yield (doc_id, *(model.predict(text) if has_letter(text) else ("und", 0.0, False)))

        yield from batched(each(), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
