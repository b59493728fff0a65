"""Order MinHash: document fingerprints whose likeness falls with the edit distance.

Every k-mer of a text is numbered by its occurrence, and the pair is hashed once to a
place on a ring of 2^44. Sketch j orders the pairs by their distance after the ring's
point j and takes the TUPLE minimal ones; they are put back in text order and the tuple
of their k-mers is hashed. So a sketch agrees only if the minimal k-mers agree *and*
stand in the same order. One hash and one sort serve all sketches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, materialize, rows_of

#: Characters of a k-mer, k-mers of a tuple, tuples of a fingerprint.
KMER, TUPLE, SKETCHES = 7, 2, 64

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_RING = 44


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str, kmer: int = KMER, size: int = TUPLE, sketches: int = SKETCHES) -> str:
    """Four hex digits for each sketch.

    A text shorter than a k-mer is a single k-mer; one with fewer k-mers than a tuple
    takes the same k-mer again as often as the ring comes round; the empty text has a
    fingerprint of its own.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - kmer + 1
    if n < 1:
        grams = np.array([len(points) + 1], np.uint64)
        for x in points:
            grams = _mix(grams + x)
        n = 1
    else:
        grams = points[:n] + np.uint64(1)
        for i in range(1, kmer):
            grams = grams * _A + points[i : i + n]
        grams = _mix(grams)
    bits = np.uint64(max(20, (n - 1).bit_length()))
    ring = np.uint64(_RING) if bits <= 20 else np.uint64(64) - bits
    low = (np.uint64(1) << bits) - np.uint64(1)
    at = np.arange(n, dtype=np.uint64)
    tags = grams >> (np.uint64(64) - ring)
    order = np.sort((tags << bits) | at)
    places = (order & low).astype(np.int64)
    sorted_tags = order >> bits
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(sorted_tags[1:], sorted_tags[:-1], out=fresh[1:])
    starts = np.flatnonzero(fresh)
    number = at - np.repeat(starts, np.diff(np.append(starts, n))).astype(np.uint64)
    hashed = _mix(sorted_tags * _B + number) >> (np.uint64(64) - ring)
    order = np.sort((hashed << bits) | places.astype(np.uint64))
    first = np.searchsorted(order, (np.arange(sketches, dtype=np.uint64) << (np.uint64(64) - np.uint64((sketches - 1).bit_length()))))
    chosen = np.sort((order[(first[:, None] + np.arange(size)) % n] & low).astype(np.int64), axis=1)
    value = np.full(sketches, len(points) > 0, np.uint64)
    for i in range(size):
        value = _mix(value * _A + grams[chosen[:, i]])
    return (value >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal sketches; equal texts have 1."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint16) for s in (a, b))
    return float((x == y).mean())


def document_fingerprints(docs: DataFrame, kmer: int = KMER, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint for every row; null texts are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        yield from batched(((d, len(t), fingerprint(t, kmer, size, sketches)) for d, t in rows_of(batches, "doc_id", "text")), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited_likeness(docs: DataFrame, kmer: int = KMER, size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document by ascending doc_id; after the last comes the
    first. A single document is its own next. Null texts are empty. Rows with a null
    doc_id come first and repeated ids follow each other in the order of their text.

    The texts are dealt once by range of doc_id. Within a range the next document is the
    next row; the last row of each range and its first text are put together in a second,
    small step: two rows for each range.
    """
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((x, pa.float64()) for x in ("near_edited", "near_next"))])
    both = pa.schema([*done, ("range_id", pa.int32()), ("edge", pa.int32()), ("edge_text", pa.string())])
    spark = docs.sparkSession

    def row(doc_id, text, mark, after, after_mark):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        changed = mark if edited == text else fingerprint(edited, kmer, size, sketches)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, mark, changed, likeness(mark, changed), likeness(mark, after_mark)

    def run(batches):
        def each():
            held = None
            for doc_id, text, part in rows_of(batches, "doc_id", "text", "range_id"):
                mark = fingerprint(text, kmer, size, sketches)
                if held is None:
                    yield doc_id, len(text), None, mark, None, None, None, part, 0, text
                else:
                    yield *row(*held, text, mark), part, 2, None
                held = doc_id, text, mark
            if held:
                yield held[0], len(held[1]), None, held[2], None, None, None, part, 1, held[1]

        yield from batched(each(), both, weight=lambda r: len(r[-1] or ""))

    ranged = id_text(docs).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text").withColumn("range_id", F.spark_partition_id())
    rows = materialize(ranged.mapInArrow(run, out + ", range_id int, edge int, edge_text string"), "ranges")

    # the ids of the ranges only: as many as there are partitions
    ranges = sorted(r.range_id for r in rows.where("edge = 0").select("range_id").collect())
    follows = [(a, b) for a, b in zip(ranges, ranges[1:] + ranges[:1], strict=True)]
    after = spark.createDataFrame(follows, "last_of int, first_of int")
    heads = rows.where("edge = 0").select(F.col("range_id").alias("first_of"), F.col("edge_text").alias("after"), F.col("fingerprint").alias("after_mark"))
    tails = rows.where("edge = 1").select(F.col("range_id").alias("last_of"), "doc_id", F.col("edge_text").alias("text"), F.col("fingerprint").alias("mark"))

    def join_up(batches):
        yield from batched((row(*x) for x in rows_of(batches, "doc_id", "text", "mark", "after", "after_mark")), done)

    ends = tails.join(after, "last_of").join(heads, "first_of").select("doc_id", "text", "mark", "after", "after_mark")
    return rows.where("edge = 2").select(*done.names).unionAll(ends.mapInArrow(join_up, out))
