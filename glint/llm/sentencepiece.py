"""SentencePiece encoding and decoding as a relational lattice.

White space becomes the sign U+2581, which begins words; pieces never go across one that
begins. Words are cut once more where no piece has the two characters side by side, so a
comma isn't part of the word before it. Each distinct word is encoded once: its substrings
of bounded length are exploded and equi-joined to the piece table (broadcast: a vocabulary
is a fixed number of rows); the edges are grouped by word and folded with a higher-order
aggregate.

The texts aren't dealt out for that. Their words are counted where they lie; of all encoded
words the COMMON most frequent, a bounded table, go to every task and serve most places.
The ids of a document, two bytes each with a mark at every place of a rarer word, are then
joined with the encodings of just those words. The ids travel packed: those of a document
by zstd, those of a rarer word as bytes behind its place.

For a unigram model the fold is Viterbi's: the best score at each end, and the edge that
got there. The scores of a BPE model are ranks of merges, and a best path over them isn't
what the model encodes, so for BPE the fold replays the merges on the lattice: of all
edges that join two neighbouring pieces the one of best score, leftmost on ties. A bit
mask holds the piece boundaries. Boundaries only vanish, and what lies within an edge
merges as the edge's own text does; so if each piece is made of two at its turn, one
pass over the edges by score does it. Pieces for which that doesn't hold ("late" ones)
are found once from the vocabulary, and words that have one are folded step by step.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, drop_source, id_text, materialize, rows_of

SPACE = "\u2581"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Encoded words that every task gets, at most; distinct words that a task counts before it sends them.
COMMON, COUNTED = 100_000, 100_000
#: Words that a worker remembers.
CACHE = 60_000
#: Longer words don't fit the bit mask of a long; they are folded with a run of bytes.
MASK = 61
#: Distinct words whose edges one task sorts, in memory.
PART = 20_000
#: Substring starts of a long word in one row.
WINDOW = 64


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model file: (piece, id, score), ids of the 256 bytes, kind of model."""

    rows: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown: int
    bpe: bool
    longest: int
    spelled: tuple[str, ...]
    late: tuple[int, ...] = ()


def late_pieces(rows: tuple[tuple[str, int, float], ...]) -> tuple[int, ...]:
    """Ids of the pieces that aren't two neighbours when their turn by score comes, but later are."""
    cost = {p: -s for p, _, s in rows}

    def fits(held: set[int], s: int, e: int) -> bool:
        return s in held and e in held and sum(b in held for b in range(s + 1, e)) == 1

    found = []
    for piece, i, _ in rows:
        n = len(piece)
        edges = sorted((cost[piece[s:e]], s, e) for s in range(n) for e in range(s + 2, n + 1) if piece[s:e] in cost)
        once, again = set(range(n + 1)), set(range(n + 1))
        for _, s, e in edges:
            if fits(once, s, e):
                once.difference_update(range(s + 1, e))
        while step := next(((s, e) for _, s, e in edges if fits(again, s, e)), None):
            again.difference_update(range(step[0] + 1, step[1]))
        if once != again:
            found.append(i)
    return tuple(found)


def _kind_is_bpe(data: bytes) -> bool:
    """Reads trainer_spec.model_type (field 2, then field 3) off the protocol buffer: 2 is BPE."""

    def fields(buf: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                b = buf[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(buf):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            elif tag & 7 == 2:
                n = number()
                yield tag >> 3, buf[at : at + n]
                at += n
            else:
                n = 8 if tag & 7 == 1 else 4
                yield tag >> 3, buf[at : at + n]
                at += n

    spec = next((v for k, v in fields(data) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1) == 2


def load_pieces(path: str | None = None) -> Pieces:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    spelled = tuple(model.id_to_piece(i) for i in ids)
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)) if any(model.is_byte(i) for i in ids) else ()
    with open(path, "rb") as f:
        bpe = _kind_is_bpe(f.read())
    rows = tuple((spelled[i], i, float(model.get_score(i))) for i in plain)
    return Pieces(rows, byte_ids, model.unk_id(), bpe, max(len(spelled[i]) for i in plain), spelled, late_pieces(rows) if bpe else ())


def _table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame([("", -1, 0.0), *pieces.rows], "piece string, id int, score double")


def _edges(spans: DataFrame, pieces: Pieces, keys: list[str]) -> DataFrame:
    """keys and the edges: structs (cost, s, e, id), one for each of the spans (s, e, piece) that is a piece."""
    table = F.broadcast(_table(spans.sparkSession, pieces))  # the vocabulary: a fixed number of rows
    edge = F.struct((-F.col("score")).alias("cost"), "s", "e", "id")
    return spans.join(table, "piece").groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _lattice(words: DataFrame, pieces: Pieces, parts: int | None = None) -> DataFrame:
    """words with their edges, for words of any moderate length.

    The empty piece at 0 is an edge of every word, so that words without a piece stay.
    """
    keys = words.columns
    # words are dealt before their substrings are made, which then are where they are grouped
    dealt = words.repartition(parts, "word") if parts else words.repartition("word")
    spans = dealt.select(*keys, F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("s"))
    spans = spans.select(*keys, "s", F.explode(F.sequence(F.when(F.col("s") == 0, 0).otherwise(1), F.least(F.lit(pieces.longest), F.char_length("word") - F.col("s")))).alias("n"))
    spans = spans.select(*keys, "s", (F.col("s") + F.col("n")).alias("e"), F.substr("word", F.col("s") + 1, F.col("n")).alias("piece"))
    return _edges(spans, pieces, keys)


def _long_lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """The same for long words: their substrings travel without them, by a hash of the word."""
    named = words.withColumn("wid", F.sha2("word", 256))
    windows = F.transform(F.sequence(F.lit(0), F.char_length("word") - 1, F.lit(WINDOW)), lambda at: F.struct(at.alias("at"), F.substr("word", at + 1, F.lit(WINDOW + pieces.longest)).alias("part")))
    parts = named.select("wid", F.explode(windows).alias("w")).select("wid", "w.at", "w.part")
    parts = parts.select("wid", "at", "part", F.explode(F.sequence(F.lit(0), F.least(F.char_length("part"), F.lit(WINDOW)) - 1)).alias("o"))
    parts = parts.select("wid", "at", "part", "o", F.explode(F.sequence(F.when(F.col("at") + F.col("o") == 0, 0).otherwise(1), F.least(F.lit(pieces.longest), F.char_length("part") - F.col("o")))).alias("n"))
    spans = parts.select("wid", (F.col("at") + F.col("o")).alias("s"), (F.col("at") + F.col("o") + F.col("n")).alias("e"), F.substr("part", F.col("o") + 1, F.col("n")).alias("piece"))
    return named.join(_edges(spans, pieces, ["wid"]), "wid").select(*words.columns, "edges")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _once(value: Column, use) -> Column:
    """use(value), with value evaluated once for each row rather than at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ends(x: Column) -> Column:
    return _bit(x["s"]).bitwiseOR(_bit(x["e"]))


def _within(x: Column) -> Column:
    return _bit(x["e"]) - _bit(x["s"] + 1)


def _merges_masked(edges: Column, n: Column, late: Column) -> Column:
    """Boundaries after all merges, as a mask: bit i is set if a piece begins or ends at i."""
    merges = F.transform(F.filter(edges, lambda x: x["e"] - x["s"] > 1), lambda x: F.struct(_ends(x).alias("ends"), _within(x).alias("within")))
    every = _bit(n + 1) - F.lit(1).cast("long")

    def fits(held: Column, m: Column) -> Column:
        return (held.bitwiseAND(m["ends"]) == m["ends"]) & (F.bit_count(held.bitwiseAND(m["within"])) == 1)

    def once(held: Column, m: Column) -> Column:
        # edges are sorted by cost and start
        return F.when(fits(held, m), held - held.bitwiseAND(m["within"])).otherwise(held)

    def by_step(merges: Column) -> Column:
        def step(held: Column, _: Column) -> Column:
            fit = F.filter(merges, lambda m: fits(held, m))
            return held - held.bitwiseAND(F.coalesce(F.get(fit, F.lit(0))["within"], F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), every, step)

    return F.when(late, _once(merges, by_step)).otherwise(F.aggregate(merges, every, once))


def _merges_listed(edges: Column, n: Column, late: Column) -> Column:
    """The same for words of any length, as a sorted array of boundaries."""
    merges = F.filter(edges, lambda x: x["e"] - x["s"] > 1)
    every = F.sequence(F.lit(0), n)

    def fits(held: Column, m: Column) -> Column:
        return (F.array_position(held, m["s"]) > 0) & (F.array_position(held, m["e"]) - F.array_position(held, m["s"]) == 2)

    def merge(held: Column, m: Column) -> Column:
        return _once(F.array_position(held, m["s"]).cast("int"), lambda at: F.concat(F.slice(held, F.lit(1), at), F.slice(held, at + 2, F.size(held))))

    def once(held: Column, m: Column) -> Column:
        return F.when(fits(held, m), merge(held, m)).otherwise(held)

    def by_step(merges: Column) -> Column:
        def step(held: Column, _: Column) -> Column:
            return _once(F.get(F.filter(merges, lambda m: fits(held, m)), F.lit(0)), lambda first: F.when(first.isNull(), held).otherwise(merge(held, first)))

        return F.aggregate(F.sequence(F.lit(1), n), every, step)

    return F.when(late, _once(merges, by_step)).otherwise(F.aggregate(merges, every, once))


def _held(held: Column, x: Column) -> Column:
    """The part of a run of bytes, 1 for a boundary and 0 for none, from an edge's start to its end."""
    return F.substr(held, x["s"] + 1, x["e"] - x["s"] + 1).cast("string")


def _merges_long(edges: Column, n: Column) -> Column:
    """Boundaries after all merges as a run of bytes; for long words that have no late piece."""
    merges = F.filter(edges, lambda x: x["e"] - x["s"] > 1)

    def once(held: Column, m: Column) -> Column:
        part = _held(held, m)
        fits = (F.left(part, F.lit(1)) == "1") & (F.right(part, F.lit(1)) == "1") & (F.replace(part, F.lit("0")) == "111")
        return F.when(fits, F.overlay(held, F.repeat(F.lit("0"), m["e"] - m["s"] - 1).cast("binary"), m["s"] + 2)).otherwise(held)

    return F.aggregate(merges, F.repeat(F.lit("1"), n + 1).cast("binary"), once)


def _best_path(edges: Column, n: Column, unknown: float) -> Column:
    """Boundaries of the best path; a character without a piece costs `unknown`."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, i: Column) -> Column:
        into = F.transform(F.filter(edges, lambda x: x["e"] == i), lambda x: F.struct((F.get(best, x["s"])["cost"] + x["cost"]).alias("cost"), F.concat(F.get(best, x["s"])["path"], F.array(i)).alias("path")))
        last = F.get(best, i - 1)
        bare = F.array(F.struct((last["cost"] + F.lit(unknown)).alias("cost"), F.concat(last["path"], F.array(i)).alias("path")))
        single = F.exists(edges, lambda x: (x["e"] == i) & (x["s"] == i - 1))
        return F.concat(best, F.array(F.array_min(F.when(single, into).otherwise(F.concat(into, bare)))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, step), -1)["path"]


def encode_words(words: DataFrame, pieces: Pieces, parts: int | None = None) -> DataFrame:
    """words and ids for each distinct, non-empty word; a column `times` that goes with it stays.

    A word of any length is one row of its edges, some 40 bytes for each substring that is
    a piece: a hundred thousand characters take 60 MB at most. The words are dealt into `parts`, or as
    the session has it. A long word with a late
    piece is folded step by step, in time that grows with the square of its length.
    """
    n = F.char_length("word")
    edges = F.col("edges")
    late = F.exists(edges, lambda x: x["id"].isin(*pieces.late)) if pieces.late else F.lit(False)
    table = F.array(*(F.lit(i) for i in pieces.byte_ids)) if pieces.byte_ids else None

    def bare(s: Column) -> Column:
        """The ids of a character without a piece."""
        if table is None:
            return F.array(F.lit(pieces.unknown))
        code = F.hex(F.encode(F.substr(F.col("word"), s + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda k: F.get(table, F.conv(F.substr(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    def ids(x: Column) -> Column:
        edge = F.get(F.filter(edges, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"])), F.lit(0))
        return F.when(edge.isNotNull(), F.array(edge["id"])).otherwise(bare(x["s"]))

    def spell(cuts: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.struct(F.get(cuts, k - 1).alias("s"), F.get(cuts, k).alias("e")))
        return F.flatten(F.transform(spans, ids))

    def spell_masked(mask: Column) -> Column:
        # an edge is in the result if its ends are boundaries and none lies between them
        own = F.filter(edges, lambda x: (x["e"] > x["s"]) & (mask.bitwiseAND(_ends(x)) == _ends(x)) & (mask.bitwiseAND(_within(x)) == 0))
        cuts = F.filter(F.sequence(F.lit(0), n), lambda i: F.call_function("shiftright", mask, i) % 2 != 0)
        in_order = lambda own: F.transform(F.array_sort(F.transform(own, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))), lambda x: x["id"])
        return _once(own, lambda own: F.when(F.size(own) == F.bit_count(mask) - 1, in_order(own)).otherwise(_once(cuts, spell)))

    def spell_long(held: Column) -> Column:
        own = F.filter(edges, lambda x: (x["e"] > x["s"]) & (_held(held, x) == F.concat(F.lit("1"), F.repeat(F.lit("0"), x["e"] - x["s"] - 1), F.lit("1"))))
        known = F.transform(own, lambda x: F.struct(x["s"].alias("s"), F.array(x["id"]).alias("ids")))
        # what no edge covers is single characters
        singles = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substr(held, i + 1, F.lit(2)).cast("string") == "11")
        others = F.array_except(singles, F.transform(F.filter(own, lambda x: x["e"] - x["s"] == 1), lambda x: x["s"]))
        return F.flatten(F.transform(F.array_sort(F.concat(known, F.transform(others, lambda s: F.struct(s.alias("s"), bare(s).alias("ids"))))), lambda x: x["ids"]))

    short, long = (words.where(f"char_length(word) {sign} {MASK}") for sign in ("<=", ">"))
    if pieces.bpe:
        brief = _once(_merges_masked(edges, n, late), spell_masked)
        lengthy = F.when(late, _once(_merges_listed(edges, n, late), spell)).otherwise(_once(_merges_long(edges, n), spell_long))
    else:
        brief = lengthy = _once(_best_path(edges, n, max(-s for _, _, s in pieces.rows) + 10.0), spell)
    return _lattice(short, pieces, parts).select(*words.columns, brief.alias("ids")).unionAll(_long_lattice(long, pieces).select(*words.columns, lengthy.alias("ids")))


def space_block(pieces: Pieces) -> int:
    """The length of the blocks that a long run of spaces is merged to from the left, 0 if that isn't sure.

    Where all pieces of spaces have one score, merges go from the left, so what is merged
    first is the first block, whatever follows later. Whether a run of three such blocks
    begins with the longest piece is tried out. Two blocks are left to the end of a run.
    """
    cost = {len(p): -s for p, _, s in pieces.rows if not p.strip(SPACE) and len(p) > 1}
    if not pieces.bpe or len(set(cost.values())) != 1:
        return 0
    block = max(cost)
    held = list(range(3 * block + 1))
    while step := next(((i, j) for i in range(len(held) - 2) for j in [i + 2] if held[j] - held[i] in cost), None):
        del held[step[0] + 1]
    return block if held[:3] == [0, block, 2 * block] else 0


class Cuts:
    """For each white-space word its parts: it is cut where no piece has the two characters side by side."""

    def __init__(self, pieces: Pieces):
        self.side = {p[i : i + 2] for p, _, _ in pieces.rows for i in range(len(p) - 1)}
        self.block = space_block(pieces)

    def __getitem__(self, word: str) -> list[str]:
        side, parts = self.side, []
        if self.block and len(word) > 3 * self.block:
            spaces = len(word) - len(word.lstrip(SPACE))
            blocks = max(0, spaces // self.block - 2)
            parts, word = [SPACE * self.block] * blocks, word[self.block * blocks :]
        at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in side), len(word)]
        return parts + [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def words_of(text: str) -> list[str]:
    """The white-space words of a text in order, without the sign that begins them where all have one; none for the empty text."""
    if "  " not in text and SPACE not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return ["\n" + w for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]


def spelled(word: str) -> str:
    """A word of words_of with its sign."""
    return word[1:] if word[:1] == "\n" and word[1:2] == SPACE else SPACE + word


class Encoded(dict):
    """For each word of words_of its ids as bytes, with a mark for each part that isn't known; `lost` has those parts."""

    def __init__(self, pieces: Pieces, known: dict[str, bytes], mark: bytes):
        self.cuts, self.known, self.mark = Cuts(pieces), known, mark
        self.lost: dict[str, list[str]] = {}

    def __missing__(self, word: str) -> bytes:
        parts = self.cuts[spelled(word)]
        found = [self.known.get(p, self.mark) for p in parts]
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids = b"".join(found)
        if lost := [p for p, f in zip(parts, found, strict=True) if f is self.mark]:
            self.lost[word] = lost
        return ids

    def of(self, text: str) -> tuple[bytes, list[str]]:
        """The ids of a text, and the unknown parts in order."""
        if len(self.lost) >= CACHE:
            self.lost.clear()
            self.clear()
        words, lost = words_of(text), self.lost
        held = b"".join(map(self.__getitem__, words))
        return held, [p for w in words if w in lost for p in lost[w]]


class Known:
    """The common words with their ids; as bytes from the driver, as a dictionary in a worker."""

    def __init__(self, table: pa.Table):
        self.table, self.ids = table, None

    def __getstate__(self):
        return self.table, None

    def __setstate__(self, state):
        self.table, self.ids = state

    def by_word(self) -> dict[str, bytes]:
        if self.ids is None:
            self.ids = {}
            for batch in self.table.to_batches():
                self.ids.update(zip(batch.column("word").to_pylist(), batch.column("ids").to_pylist(), strict=True))
        return self.ids


def packed(ids: Column, kind: str) -> Column:
    """An array of ids as a run of bytes, of the unsigned type `kind` in network order."""
    digits = 2 * np.dtype(kind).itemsize
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), digits, "0")), ""))


def word_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """word and times, how often it occurs, for each distinct word of all texts."""

    def run(batches):
        cuts, held = Cuts(pieces), Counter()

        def send():
            parts: Counter = Counter()
            for word, n in held.items():
                for part in cuts[spelled(word)]:
                    parts[part] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), pa.array(list(parts.values()), pa.int64())], names=["word", "n"])

        for (text,) in rows_of(batches, "text"):
            held.update(words_of(text))
            if len(held) >= COUNTED:
                yield send()
        if held:
            yield send()

    return id_text(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("times"))


def _common(encoded: DataFrame, most: int) -> pa.Table:
    """word and packed ids of the most frequent words, at most so many; words of one magnitude go together."""
    size = F.floor(F.log2("times") * 16).cast("int")
    counts = sorted(((r.size, r["count"]) for r in encoded.groupBy(size.alias("size")).count().collect()), reverse=True)
    least, total = None, 0
    for size_of, n in counts:
        if total + n > most:
            break
        least, total = size_of, total + n
    return encoded.where(size >= least if least is not None else F.lit(False)).select("word", "ids").toArrow()


def encode(docs: DataFrame, pieces: Pieces | None = None, common: int = COMMON) -> DataFrame:
    """doc_id and ids, the encoding of the whole text, for every row.

    Null and empty texts have no ids. Repeated rows and null ids are kept, no rows give no
    rows. Columns other than doc_id and text are not read. `common` bounds the table that
    is broadcast and decides the work, not the result.
    """
    pieces = pieces or load_pieces()
    spark = docs.sparkSession
    kind, hole = (">u2", 0xFFFF) if len(pieces.spelled) < 0xFFFF else (">u4", 0xFFFFFFFF)
    # written, since short and long words would each count anew
    counted = materialize(word_counts(docs, pieces), "words")
    encoded = encode_words(counted, pieces, -(-counted.count() // PART) or 1).withColumn("ids", packed(F.col("ids"), kind))
    encoded = materialize(encoded, "encoded")
    drop_source(counted)
    shared = spark.sparkContext.broadcast(Known(_common(encoded, common)))
    mark = np.array([hole], kind).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("size", pa.int64()), ("held", pa.binary()), ("missing", pa.list_(pa.string()))])

    def look_up(batches):
        encoded, codec = Encoded(pieces, shared.value.by_word(), mark), pa.Codec("zstd", compression_level=3)

        def each():
            for doc_id, text, own in rows_of(batches, "doc_id", "text", "mark"):
                held, missing = encoded.of(text)
                yield doc_id, own, len(held), codec.compress(held, asbytes=True), missing

        yield from batched(each(), schema, size=500, weight=lambda row: row[2], most=8 << 20)

    rows = id_text(docs).withColumn("mark", F.xxhash64("text")).mapInArrow(look_up, "doc_id long, mark long, size long, held binary, missing array<string>")
    key = (F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    asked = rows.where(F.size("missing") > 0).select(*key, F.posexplode("missing").alias("at", "asked"))
    # places of four bytes in network order sort as numbers do
    placed = F.concat(F.unhex(F.lpad(F.hex("at"), 8, "0")), "ids")
    told = asked.join(encoded, F.col("asked") == F.col("word")).select("nameless", "id", "mark", placed.alias("placed"))
    told = told.groupBy("nameless", "id", "mark").agg(F.array_sort(F.collect_set("placed")).alias("told"))
    told = told.select(F.col("nameless").alias("t_nameless"), F.col("id").alias("t_id"), F.col("mark").alias("t_mark"), "told")
    ours = rows.select(*key, "size", "held", F.size("missing").alias("holes"))
    both = ours.join(told, [F.col(c) == F.col(f"t_{c}") for c in ("nameless", "id", "mark")], "left")
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def fill(batches):
        codec = pa.Codec("zstd")

        def each():
            for nameless, doc_id, size, held, holes, told in rows_of(batches, "nameless", "id", "size", "held", "holes", "told"):
                ids = np.frombuffer(codec.decompress(held, size, asbytes=True), kind).astype(np.int32)
                if holes:
                    at = np.flatnonzero(ids == (hole if kind == ">u2" else -1))
                    if len(at) != holes or told is None or len(told) != holes:
                        raise RuntimeError("the texts changed while they were encoded")
                    whole, last = [], 0
                    for i, new in zip(at.tolist(), told, strict=True):
                        whole += [ids[last:i], np.frombuffer(new, kind, offset=4).astype(np.int32)]
                        last = i + 1
                    ids = np.concatenate([*whole, ids[last:]])
                yield None if nameless else doc_id, ids

        yield from batched(each(), out, size=500, weight=lambda row: len(row[1]), most=2 << 20)

    return both.select("nameless", "id", "size", "held", "holes", "told").mapInArrow(fill, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """encoded with a column text in place of ids. Null ids give a null text, none the empty one.

    Bytes that aren't UTF-8 become the replacement character.
    """
    pieces = pieces or load_pieces()
    byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}
    hexes = "|".join(f"{byte_of[i]:02X}" if i in byte_of else p.replace(SPACE, " ").encode().hex() for i, p in enumerate(pieces.spelled))
    table = F.split(F.lit(hexes), r"\|")
    text = F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.get(table, i)), "")), "UTF-8")
    return encoded.withColumn("text", F.when(F.col("ids").isNotNull(), F.regexp_replace(text, "^ ", ""))).drop("ids")
