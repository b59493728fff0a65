"""Best-fit packing of tokenized documents by exact complements.

Only the histogram of piece lengths - at most `room` numbers - decides what goes
together. The plan takes the longest length left, then looks in the indexes of sums for
one, two or three lengths that fill the gap exactly and are still available, as often as
their counts allow; if there are none, the best-fitting length goes in and the
smaller gap is tried again. Pieces are then numbered within their length, and a number
stands for a place in the plan.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, id_text, materialize, rows_of

ROOM = 2048
END = 0
#: Words, and runs of letters or signs within words, that a worker remembers the ids of.
WORDS, RUNS = 400_000, 800_000

#: The tokenizer's own split, for words of the first 256 code points in lower case.
_SPLIT = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")


def _byte_signs() -> list[str]:
    """The sign that byte-level BPE writes for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordIds(dict):
    """The ids of each white-space-separated word, packed as little-endian unsigned 32-bit.

    The tokenizer drops white space and never looks across it, so a text's ids are those
    of its words. Words of the first 256 code points are split here and each run goes to
    the BPE model once; words with an apostrophe, a special token or other letters go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self.signs = _byte_signs()

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if max(word) < "\u0100" and "'" not in word and "<|" not in word:
            ids = b"".join([self.runs.get(x) or self._run(x) for x in _SPLIT.findall(word.lower())])
        else:
            ids = self.encode(word)
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids

    def _run(self, run: str) -> bytes:
        if len(self.runs) >= RUNS:
            self.runs.clear()
        signs = run if run.isascii() and run.isprintable() else "".join([self.signs[b] for b in run.encode()])
        ids = self.runs[run] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(signs)])
        return ids

    #: Separators that str.split() knows and the tokenizer takes for signs.
    odd = re.compile("[\x1c-\x1f]")

    def of(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, room: int = ROOM, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids and salt of every row's pieces of at most `room` ids.

    A document is its text's ids and END. Null and empty texts are END alone. The salt
    numbers a task's rows, so that pieces of one id can be dealt apart.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("salt", pa.int32())])

    def run(batches):
        words = WordIds(path or tokenizer_path())

        def each():
            for salt, (doc_id, text) in enumerate(rows_of(batches, "doc_id", "text")):
                ids = words.of(text) + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part, salt & 0xFFFF

        yield from batched(each(), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, salt int")


class Complements:
    """Indexes of the available lengths by the sums of one, two and three of them.

    For each sum that is asked for, the pairs of lengths with that sum are listed once, the
    larger length falling; for triples the first lengths are, each with the pairs of the rest.
    What is used up never comes back, so each list has a place that only moves on.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.there = counts > 0
        self.lengths = np.flatnonzero(counts)[::-1].tolist()
        self.pairs: dict[int, list] = {}
        self.firsts: dict[int, int] = {}

    def _pair(self, total: int, less: int = 0) -> tuple[int, int] | None:
        """The available pair with that sum whose larger length is largest; one of `less` is taken already."""
        left = self.left
        if total < 2:
            return None
        if total not in self.pairs:
            high = np.arange(min(total - 1, len(left) - 1), (total - 1) // 2, -1)
            high = high[self.there[high] & self.there[total - high]]
            self.pairs[total] = [0, high.tolist()]
        entry = self.pairs[total]
        listed = entry[1]
        while entry[0] < len(listed) and not self._has(listed[entry[0]], total - listed[entry[0]], 0):
            entry[0] += 1
        for high in listed[entry[0] :]:
            if self._has(high, total - high, less):
                return high, total - high
        return None

    def _has(self, high: int, low: int, less: int) -> bool:
        if high == low:
            return self.left[high] > 1 + (high == less)
        return self.left[high] > (high == less) and self.left[low] > (low == less)

    def exact(self, gap: int) -> tuple[int, ...] | None:
        if gap < len(self.left) and self.left[gap]:
            return (gap,)
        if pair := self._pair(gap):
            return pair
        at = self.firsts.get(gap, 0)
        found = None
        while at < len(self.lengths) and 3 * self.lengths[at] >= gap:
            first = self.lengths[at]
            if first <= gap - 2 and self.left[first] and (pair := self._pair(gap - first, first)) and pair[0] <= first:
                found = first, *pair
                break
            at += 1
        self.firsts[gap] = at
        return found


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, tuple[int, ...]]]:
    """(sequences, lengths) so that each length is used as often as it occurs.

    Each step uses a length up, so there are no more steps than a few for each length.
    """
    left = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index, steps = Complements(left), []
    while (there := np.flatnonzero(left)).size:
        taken = [int(there[-1])]
        left[taken[0]] -= 1
        gap = room - taken[0]
        while gap:
            if fill := index.exact(gap):
                for length in fill:
                    left[length] -= 1
                taken += fill
                break
            fits = np.flatnonzero(left[: gap + 1])
            if not fits.size:
                break
            taken.append(int(fits[-1]))
            left[taken[-1]] -= 1
            gap -= taken[-1]
        kinds, each = np.unique(taken, return_counts=True)
        more = int((left[kinds] // each).min())
        left[kinds] -= more * each
        steps.append((1 + more, tuple(taken)))
    return steps


def slots(steps: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number, first sequence and offset of every run of places."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for many, lengths in steps:
        offset = 0
        for length in lengths:
            found.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + many
            offset += length
        sequence += many
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(made: DataFrame, room: int = ROOM) -> DataFrame:
    """Adds sequence_id and offset to a materialized table of pieces.

    Pieces are numbered within their length by a count for each (bucket, length) - the
    buckets are hashes of doc_id and salt, more of them the more rows there are - and their
    place in the bucket. Equal pieces of repeated rows are told apart by their place only.
    """
    spark = made.sparkSession
    histogram = {r.length: r["count"] for r in made.groupBy("length").count().collect()}
    places = slots(plan(histogram, room))
    buckets = max(1, -(-sum(histogram.values()) // 20_000))
    keyed = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)).cast("int")).drop("salt")
    sums = keyed.groupBy("bucket", "length").count()
    first = sums.selectExpr("bucket", "length as kind", "sum(count) over (partition by length order by bucket rows between unbounded preceding and 1 preceding) as before")
    first = first.groupBy("bucket").agg(F.collect_list(F.struct("kind", F.coalesce("before", F.lit(0)).alias("before"))).alias("firsts"))
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
    rest = [c for c in made.columns if c not in (*schema.names, "salt")]
    kinds = {c: made.schema[c].dataType for c in rest}
    from pyspark.sql.pandas.types import to_arrow_type

    full = pa.schema([*schema, *((c, to_arrow_type(k)) for c, k in kinds.items())])

    def place(key, table, firsts):
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = table.column("length").to_numpy()
        before = {x["kind"]: x["before"] for x in firsts.column("firsts")[0].as_py()}
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        edges = np.flatnonzero(np.diff(length, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            kind = int(length[a])
            number = before[kind] + np.arange(b - a)
            start, base, shift = places[kind]
            run = np.searchsorted(start, number, "right") - 1
            sequence[a:b] = base[run] + number - start[run]
            offset[a:b] = shift[run]
        columns = {"sequence_id": sequence, "offset": offset}
        return pa.table({c: columns[c] if c in columns else table.column(c) for c in full.names}).cast(full)

    names = ", ".join([f"{c} {'int' if c == 'piece' else 'long'}" for c in schema.names] + [f"`{c}` {k.simpleString()}" for c, k in kinds.items()])
    full = full.set(1, pa.field("piece", pa.int32()))
    return keyed.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(place, names)


def packed_sequences(docs: DataFrame, room: int = ROOM, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Every piece of every row with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With keep_ids also `ids`, the piece's ids as little-endian unsigned 32-bit numbers.
    Null and empty texts are one piece of one id. No rows give no rows; repeated rows and
    null ids are packed like others. Columns other than doc_id and text are not read.
    """
    made = pieces(docs, room, path)
    return pack(materialize(made if keep_ids else made.drop("ids"), "pieces"), room)
