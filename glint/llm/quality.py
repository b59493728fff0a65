"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has a sparse random index vector: a few places of +1 or -1, read off its
hash. Its context vector is the sum of the index vectors of its neighbours, over every
document of the corpus; no label enters it. A document is pooled as the mean and the
spread of its words' vectors and the shares of its words' shapes. A network of two
layers is trained in numpy on a bounded sample of labelled documents, and a temperature
fitted on rows that training leaves out turns its output into probabilities.
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

#: Word buckets (a power of two), width of a vector, places of an index vector, neighbours on each side.
BUCKETS, WIDTH, PLACES, REACH = 1 << 14, 32, 2, 2
#: Labelled rows that the network learns from, at most: those whose hashed id comes first.
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, SEED = 32, 30, 3e-3, 11
#: Scores from here on count as good.
ACCEPT = 0.7
#: Words that a worker remembers the codes of.
CACHE = 400_000
#: Rows of the vector table in one row of the shuffle.
BLOCK = 512

_PART = re.compile(r"[^\W_]+|[\W_]+")
SHAPES = 12


def _shape(part: str) -> int:
    if part.isalpha():
        if part.islower():
            return 0 if len(part) < 4 else 1 if len(part) < 12 else 2
        if part.isupper():
            return 3 if len(part) > 1 else 4
        return 5 if part.istitle() else 6
    if part.isdigit():
        return 7
    if part.isalnum():
        return 8
    return 9 if len(part) == 1 and part in ".,;:?!'\"()-" else 10 if len(part) == 1 else 11


class WordCodes(dict):
    """For each white-space-separated word the codes of its parts, packed: bucket | shape << 24."""

    def __missing__(self, word: str) -> bytes:
        codes = np.array([zlib.crc32(p.lower().encode("utf-8", "surrogatepass")) % BUCKETS | _shape(p) << 24 for p in _PART.findall(word)], "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = codes
        return codes

    def of(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every bucket's index vector, (BUCKETS, PLACES) each."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, WIDTH, (BUCKETS, PLACES)), rng.choice([-1.0, 1.0], (BUCKETS, PLACES))


def add_contexts(sums: np.ndarray, buckets: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds the neighbours' index vectors of a run of words to the flat sums; -1 parts documents."""
    there = buckets >= 0
    for gap in range(1, REACH + 1):
        near = there[:-gap] & there[gap:]
        a, b = buckets[:-gap][near], buckets[gap:][near]
        for own, other in ((a, b), (b, a)):
            for k in range(PLACES):
                sums += np.bincount(own * WIDTH + places[other, k], signs[other, k], BUCKETS * WIDTH)


def context_sums(docs: DataFrame) -> np.ndarray:
    """The context vectors of all buckets over all documents: BUCKETS * WIDTH numbers.

    Each task sums its part in one array and sends it in blocks of rows; the driver gets
    one array, whose size doesn't depend on the corpus.
    """
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])

    def run(batches):
        places, signs = index_vectors()
        codes, sums, held, size = WordCodes(), np.zeros(BUCKETS * WIDTH), [], 0
        apart = np.full(REACH, -1, np.int64)
        for (text,) in rows_of(batches, "text"):
            found = codes.of(text)
            for at in range(0, len(found), 1 << 20):
                held += [(found[at : at + (1 << 20)] & np.uint32(0xFFFFFF)).astype(np.int64), apart]
                size += len(held[-2])
                if size >= 1 << 20:
                    add_contexts(sums, np.concatenate(held), places, signs)
                    held, size = [], 0
        if held:
            add_contexts(sums, np.concatenate(held), places, signs)
        table = sums.reshape(-1, BLOCK * WIDTH).astype("<f8")
        yield from batched(((k, np.rint(row).astype("<i4").tobytes()) for k, row in enumerate(table) if row.any()), schema)

    def add(key, table):
        total = np.zeros(BLOCK * WIDTH)
        for part in table.column("sums"):
            total += np.frombuffer(part.as_py(), "<i4")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    made = id_text(docs).select("text").mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary")
    sums = np.zeros((BUCKETS // BLOCK, BLOCK * WIDTH))
    for row in made.collect():
        sums[row.block] = np.frombuffer(row.sums)
    return sums.reshape(BUCKETS, WIDTH)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors without their common part; a bucket that never occurred has zeros."""
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
    used = norms[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(axis=0)
    return unit.astype(np.float32)


def features(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, shares of shapes, and the logarithm of the length."""
    out = np.zeros(2 * WIDTH + SHAPES + 1, np.float32)
    n = len(codes)
    if n:
        first, second = np.zeros(WIDTH), np.zeros(WIDTH)
        for at in range(0, n, 1 << 16):
            part = vectors[codes[at : at + (1 << 16)] & np.uint32(0xFFFFFF)]
            first += part.sum(axis=0)
            second += np.einsum("ij,ij->j", part, part)
        out[:WIDTH] = first / n
        out[WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(second / n - (first / n) ** 2, 0))
        out[2 * WIDTH : -1] = np.bincount(codes >> np.uint32(24), minlength=SHAPES)[:SHAPES] / n
        out[-1] = np.log1p(n) / 10
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Network:
    """A network of rows x and labels y (0 or 1); every fifth row sets the temperature only."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
    z = (x - net.center) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    own, t = np.flatnonzero(~held), 0
    for epoch in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            h = np.maximum(z[rows] @ weights[0] + weights[1], 0)
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (h > 0)
            grads = [z[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), h.T @ error + 1e-4 * weights[2], np.array([error.sum()])]
            t += 1
            for w, g, (m, v) in zip(weights, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    apart = np.flatnonzero(held) if held.any() else own
    logits, truth = net.logits(x[apart]), y[apart]
    net.temperature = float(min(np.geomspace(0.1, 10, 80), key=lambda s: np.logaddexp(0, np.where(truth > 0.5, -1, 1) * logits / s).mean()))
    return net


@dataclass
class Model:
    """Word vectors and the network; without a network nothing was learned."""

    vectors: np.ndarray
    network: Network | None

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.network.score(x) if self.network else np.full(len(x), 0.5)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Vectors of all texts of docs, and a network of at most `sample` labelled rows.

    labels has doc_id and quality; rows with a null in either, or whose document isn't in
    docs, are left out. Repeated labels and repeated documents count as often as they
    occur, up to the sample. Without a labelled document the model has no network: it
    scores every text 0.5, predicts 0 and rejects nothing.
    """
    vectors = word_vectors(context_sums(docs))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vectors)
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("labelled"), "labelled", "quality").limit(sample)
    rows = id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most `sample` rows of two numbers
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.binary())])

    def run(batches):
        codes = WordCodes()
        yield from batched(((d, q, features(codes.of(t), shared.value).tobytes()) for d, t, q in rows_of(batches, "doc_id", "text", "quality")), schema)

    made = rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary")
    # a repeated id may have many rows, so the sample is cut once more
    seen = made.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample).collect()
    if not seen:
        return Model(vectors, None)
    seen.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.quality, r.x))
    return Model(vectors, train(np.array([np.frombuffer(r.x, np.float32) for r in seen]), np.array([r.quality for r in seen])))


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `accept` on) for every row.

    Null and empty texts are scored as texts without words. Repeated rows and null ids stay.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codes, model = WordCodes(), shared.value

        def each():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                s = float(model.score(features(codes.of(text), model.vectors)[None, :].astype(np.float64))[0])
                yield doc_id, s, int(s >= accept)

        yield from batched(each(), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns, whatever their names.

    Null and empty texts are judged as texts without words; repeated rows and null ids are
    rows like others. A model without a network accepts all. No rows give no rows.
    """
    if not model.network:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        codes, model = WordCodes(), shared.value
        for batch in batches:
            x = [features(codes.of(t or ""), model.vectors) for t in batch.column(place).to_pylist()]
            if x:
                yield batch.filter(pa.array(model.score(np.array(x, np.float64)) >= accept))

    return docs.mapInArrow(run, docs.schema)
