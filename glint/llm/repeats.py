"""Repeated passages: maximal repeats from enhanced suffix arrays, dealt by anchors.

A window of MATCH bytes has an anchor: its k-gram of least hash, the leftmost on ties.
Equal windows have equal anchors at equal places, so all windows of an anchor are looked
at in one task, wherever they occur. The windows of one anchor occurrence are contiguous
and make a fragment of at most 2 * MATCH - KMER bytes.

1. Each chunk of documents sends the hashes of its anchors, once each, and learns which
   of them other chunks have too: one bit for each hash comes back.
2. It sends the fragments of anchors that more than one document has: each content once,
   with its occurrences.
3. A task sorts the suffixes of the contents of its anchors, of MATCH bytes at least, to
   an array with common-prefix lengths, and scans it with a stack. Every interval whose
   members have different left extensions is a maximal repeat, with all its occurrences.
4. Occurrences in any document but the first become spans of the chunk they came from.

The texts are shuffled once; all steps read that exchange. A hot passage is one hash for
each chunk, and one content for each chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, KMER = 50, 24
#: Documents and characters in a chunk, and chunks for each group of anchors.
CHUNK, BYTES, GROUP = 1000, 8 << 20, 2
#: Window starts that are worked on at a time.
STEP = 1 << 20

#: The rank of rows without an id.
LAST = (1 << 63) - 1

_A = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on."""
    power = {1: b.astype(np.uint64) + np.uint64(1)}
    size = 1
    while 2 * size <= k:
        g = power[size]
        power[2 * size] = g[:-size] * np.uint64(pow(_A, size, 1 << 64)) + g[size:]
        size *= 2
    out, have = power[size], size
    while have < k:
        part = max(s for s in power if s <= k - have)
        n = len(b) - have - part + 1
        out = out[:n] * np.uint64(pow(_A, part, 1 << 64)) + power[part][have : have + n]
        have += part
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w numbers in a row."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


class Chunk:
    """The documents of a chunk, ordered by id and text, as one run of bytes."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), range(table.num_rows), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.order = [r[2] for r in rows]
        self.ids = [r[0] for r in rows]
        self.texts = [r[1].encode("utf-8", "surrogatepass") for r in rows]
        self.ends = np.cumsum([len(t) for t in self.texts]) if rows else np.zeros(0, np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])) if rows else self.ends
        self.bytes = b"".join(self.texts)
        # rows without an id rank after all others, and alike
        self.rank = np.array([LAST if d is None else d for d in self.ids], np.int64)

    def fragments(self, match: int, kmer: int):
        """(hash, first start, last start, row of the document) of every fragment, as arrays."""
        raw, width = np.frombuffer(self.bytes, np.uint8), match - kmer + 1
        found = []
        for at in range(0, max(0, len(raw) - match + 1), STEP):
            b = raw[at : at + STEP + match - 1]
            if len(b) < match:
                break
            hashes = _gram_hashes(b, kmer)
            keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
            anchor = (_least(keyed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            start = np.arange(at, at + len(anchor))
            row = np.repeat(np.arange(len(self.ends)), np.diff(np.clip(np.concatenate(([0], self.ends)), at, at + len(anchor)))) if len(self.ends) else start
            fits = start + match <= self.ends[row]
            start, anchor, row = start[fits], anchor[fits], row[fits]
            if len(start):
                new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                last = np.append(new[1:], len(start)) - 1
                found.append((hashes[anchor[new]], start[new], start[last], row[new]))
        if not found:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        hashes, first, last, row = (np.concatenate(x) for x in zip(*found, strict=True))
        # anchors are least hashes, so they are mixed anew to spread evenly over the groups
        hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0x94D049BB133111EB)
        return hashes ^ (hashes >> np.uint64(32)), first, last, row


def _thin(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their steps, high bytes together, so that they compress."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _thick(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0]
    return np.cumsum(steps, dtype=np.uint64)


def _edges(groups: int) -> np.ndarray:
    return (np.arange(1, groups, dtype=object) * (1 << 64) // groups).astype(np.uint64)


def _split(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's part of the sorted hashes begins and ends."""
    return np.concatenate(([0], np.searchsorted(hashes, _edges(groups)), [len(hashes)]))


def suffix_array(texts: list[bytes], least: int, most: int):
    """(text, offset, common prefix with the one before) of all suffixes of `least` bytes or more.

    In lexicographic order. The text's end counts as a byte that equals no other, so a
    common prefix ends there; common prefixes below `least` are given as 0.
    """
    size = np.array([len(t) for t in texts])
    width = -(-most // 8) * 8
    table = np.zeros((len(texts), width), np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(len(texts)), size)
    table[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    count = size - least + 1
    text = np.repeat(np.arange(len(texts)), count)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    wide = np.concatenate((table, np.zeros((len(texts), width), np.uint8)), axis=1).reshape(-1)
    base = text * (2 * width) + offset

    def word(which: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for i in range(8):
            out = out << np.uint64(8) | wide[base[which] + 8 * k + i]
        return out

    order = np.arange(len(text))
    first = word(order, 0)
    order = np.argsort(first, kind="stable")
    first = first[order]
    group = np.cumsum(np.diff(first, prepend=first[:1]) != 0) if len(first) else first
    tied = np.zeros(len(order), bool)
    same = np.flatnonzero(np.diff(group) == 0)
    tied[same], tied[same + 1] = True, True
    places = np.flatnonzero(tied)
    for k in range(1, width // 8):
        if not len(places):
            break
        part = order[places]
        value = word(part, k)
        again = np.lexsort((value, group[places]))
        order[places] = part[again]
        value, held = value[again], group[places]
        new = (np.diff(held, prepend=-1) != 0) | np.concatenate(([True], value[1:] != value[:-1]))
        group[places] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + len(order)
        alone = new & np.append(new[1:], True)
        places = places[~alone]
    text, offset = text[order], offset[order]
    common = np.zeros(len(order), np.int64)
    base = base[order]
    close = np.flatnonzero(wide[base[1:]] == wide[base[:-1]]) + 1 if len(base) > 1 else np.zeros(0, np.int64)
    for at in range(0, len(close), 1 << 16):
        i = close[at : at + (1 << 16)]
        for k in (range(0, least, 8)):  # most pairs part early
            ok = np.ones(len(i), bool)
            for j in range(k, min(k + 8, least)):
                ok &= wide[base[i] + j] == wide[base[i - 1] + j]
            i = i[ok]
        if len(i):
            differ = wide[base[i][:, None] + np.arange(width)] != wide[base[i - 1][:, None] + np.arange(width)]
            n = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            room = np.minimum(size[text[i]] - offset[i], size[text[i - 1]] - offset[i - 1])
            common[i] = np.where(np.minimum(n, room) >= least, np.minimum(n, room), 0)
    return text, offset, common


def maximal_repeats(texts: list[bytes], least: int, most: int):
    """(length, texts, offsets) of the maximal repeats that several of the distinct texts share.

    The intervals of the array's common-prefix tree, found with a stack; an interval is
    left out if all its members have the same byte before them, since a longer repeat has
    all its occurrences. All members are given, not neighbours only.
    """
    text, offset, common = suffix_array(texts, least, most)
    starts = np.flatnonzero((common == 0) & (np.append(common[1:], 0) > 0))
    for start in starts.tolist():
        end = start + 1
        while end < len(common) and common[end]:
            end += 1
        before = [texts[t][o - 1] if o else -1 - i for i, (t, o) in enumerate(zip(text[start:end].tolist(), offset[start:end].tolist(), strict=True))]
        lengths = common[start + 1 : end].tolist()
        stack: list[list] = [[0, 0]]
        for i, now in enumerate([*lengths, 0]):
            left = i
            while stack[-1][0] > now:
                length, left = stack.pop()
                own = before[left : i + 1]
                if len(set(own)) > 1:
                    yield length, text[start + left : start + i + 1], offset[start + left : start + i + 1]
            if stack[-1][0] < now:
                stack.append([now, left])


def _pack(**arrays) -> bytes:
    """Arrays as one run of bytes: the number of items, then each array's."""
    return b"".join(np.int64(len(a)).tobytes() + a.tobytes() for a in arrays.values())


def _unpack(data: bytes, kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.frombuffer(data, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


#: What a chunk sends of its fragments: sizes, numbers of occurrences, bytes; of occurrences: place, rank.
_SENT = (np.uint8, np.uint32, np.uint8, np.int64, np.int64)
_SPANS = (np.int64, np.uint8)


def group_spans(chunks: list[int], sent: list[bytes], match: int, kmer: int, groups=None):
    """The spans to remove, by chunk: (places, lengths) arrays.

    `groups`, if given, is called with (bytes, occurrences as (chunk, place, rank)) of every
    maximal repeat.
    """
    content: dict[bytes, int] = {}
    owner, chunk, place, rank = [], [], [], []
    for c, data in zip(chunks, sent, strict=True):
        size, count, raw, where, who = _unpack(data, _SENT)
        ends = np.cumsum(size, dtype=np.int64)
        raw = raw.tobytes()
        index = np.array([content.setdefault(raw[a:b], len(content)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.int64)
        owner.append(np.repeat(index, count))
        chunk.append(np.full(len(where), c))
        place.append(where)
        rank.append(who)
    texts = list(content)
    owner, chunk, place, rank = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, chunk, place, rank))
    order = np.argsort(owner, kind="stable")
    owner, chunk, place, rank = owner[order], chunk[order], place[order], rank[order]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    least = np.minimum.reduceat(rank, first[:-1]) if len(texts) else rank
    greatest = np.maximum.reduceat(rank, first[:-1]) if len(texts) else rank
    size = np.array([len(t) for t in texts], np.int64)
    # a content by itself is a repeat if it occurs in several documents; its ends make it maximal
    whole = np.flatnonzero(least < greatest)
    text, offset, length, lowest = [whole], [np.zeros(len(whole), np.int64)], [size[whole]], [least[whole]]
    if groups:
        for t in whole.tolist():
            groups(texts[t], list(zip(chunk[first[t] : first[t + 1]], place[first[t] : first[t + 1]], rank[first[t] : first[t + 1]], strict=True)))
    for n, members, offsets in maximal_repeats(texts, match, 2 * match - kmer):
        text.append(members)
        offset.append(offsets)
        length.append(np.full(len(members), n))
        lowest.append(np.full(len(members), least[members].min()))
        if groups:
            spots = [(c, p + o, r) for t, o in zip(members.tolist(), offsets.tolist(), strict=True) for c, p, r in zip(chunk[first[t] : first[t + 1]], place[first[t] : first[t + 1]], rank[first[t] : first[t + 1]], strict=True)]
            groups(texts[members[0]][offsets[0] : offsets[0] + n], spots)
    text, offset, length, lowest = (np.concatenate(x) for x in (text, offset, length, lowest))
    count = first[text + 1] - first[text]
    use = np.repeat(np.arange(len(text)), count)
    at = np.repeat(first[text], count) + np.arange(len(use)) - np.repeat(np.cumsum(count) - count, count)
    later = rank[at] > lowest[use]
    use, at = use[later], at[later]
    order = np.argsort(chunk[at], kind="stable")
    use, at = use[order], at[order]
    edges = np.flatnonzero(np.diff(chunk[at], prepend=-1, append=-1)) if len(at) else at
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        both = np.unique(np.stack((place[at[a:b]] + offset[use[a:b]], length[use[a:b]])), axis=1)
        yield int(chunk[at[a]]), both[0], both[1].astype(np.uint8)


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover."""
    if not len(starts):
        return starts, starts
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1]


class _Job:
    """The chunks, groups and functions of one run."""

    def __init__(self, docs: DataFrame, match: int, kmer: int, rest: list[str] = []):
        if not kmer < match <= 150:
            raise ValueError("a match must be longer than a k-mer and at most 150 bytes")
        self.match, self.kmer = match, kmer
        rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        self.chunks = max(1, -(-rows // CHUNK), -(-size // BYTES))
        self.groups = max(1, self.chunks // GROUP)
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # by id and text, so that the rows of one id, or without any, spread out
        key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.chunks)).cast("int")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *([F.struct(*(F.col(c) for c in rest)).alias("rest")] if rest else []))
        self.docs = texts.withColumn("chunk", key).repartition(min(parts, self.chunks), "chunk")

    def hashes(self):
        match, kmer, groups = self.match, self.kmer, self.groups

        def run(key, table):
            hashes = np.unique(Chunk(table).fragments(match, kmer)[0])
            edges = _split(hashes, groups)
            full = np.flatnonzero(np.diff(edges))
            return pa.table({"part": pa.array(full.astype(np.int32)), "chunk": pa.array(np.full(len(full), key[0].as_py(), np.int32)), "hashes": pa.array([_thin(hashes[edges[i] : edges[i + 1]]) for i in full.tolist()], pa.binary())})

        def shared(key, table):
            parts = [_thick(x.as_py()) for x in table.column("hashes")]
            value = np.sort(np.concatenate(parts))
            twice = np.unique(value[1:][value[1:] == value[:-1]])
            del value
            bits = []
            for p in parts:
                at = np.minimum(np.searchsorted(twice, p), max(0, len(twice) - 1))
                bits.append(np.packbits(twice[at] == p).tobytes() if len(twice) else bytes(-(-len(p) // 8)))
            return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

        sent = self.docs.groupBy("chunk").applyInArrow(run, "part int, chunk int, hashes binary")
        return sent.groupBy("part").applyInArrow(shared, "chunk int, part int, bits binary")

    def fragments(self):
        match, kmer, groups = self.match, self.kmer, self.groups

        def run(key, table, known):
            chunk = Chunk(table)
            hashes, first, last, row = chunk.fragments(match, kmer)
            kinds = np.unique(hashes)
            edges = _split(kinds, groups)
            flagged = np.zeros(len(kinds), bool)
            for part, bits in zip(known.column("part").to_pylist(), known.column("bits"), strict=True):
                n = edges[part + 1] - edges[part]
                flagged[edges[part] : edges[part + 1]] = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=n)
            kind = np.searchsorted(kinds, hashes)
            low = np.full(len(kinds), 1 << 62, np.int64)
            high = np.full(len(kinds), -1, np.int64)
            np.minimum.at(low, kind, row)
            np.maximum.at(high, kind, row)
            keep = (flagged | (low < high))[kind]
            order = np.flatnonzero(keep)
            order = order[np.argsort(hashes[order], kind="stable")]
            content: dict[tuple, list[int]] = {}
            for i, h, a, b in zip(order.tolist(), hashes[order].tolist(), first[order].tolist(), last[order].tolist(), strict=True):
                content.setdefault((h, chunk.bytes[a : b + match]), []).append(i)
            keys = np.array([h for h, _ in content], np.uint64)
            edges = _split(keys, groups)
            items = list(content.items())
            parts, sent = [], []
            for part in np.flatnonzero(np.diff(edges)).tolist():
                own = items[edges[part] : edges[part + 1]]
                where = np.array([i for _, at in own for i in at], np.int64)
                parts.append(part)
                sent.append(_pack(size=np.array([len(t) for (_, t), _ in own], np.uint8), count=np.array([len(at) for _, at in own], np.uint32), raw=np.frombuffer(b"".join(t for (_, t), _ in own), np.uint8), place=first[where], rank=chunk.rank[row[where]]))
            return pa.table({"part": pa.array(parts, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()), "sent": pa.array(sent, pa.binary())})

        return self.docs.groupBy("chunk").cogroup(self.hashes().groupBy("chunk")).applyInArrow(run, "part int, chunk int, sent binary")

    def spans(self):
        match, kmer = self.match, self.kmer

        def run(key, table):
            found = list(group_spans(table.column("chunk").to_pylist(), [x.as_py() for x in table.column("sent")], match, kmer))
            return pa.table({"chunk": pa.array([c for c, _, _ in found], pa.int32()), "spans": pa.array([_pack(a=a, n=n) for _, a, n in found], pa.binary())})

        return self.fragments().groupBy("part").applyInArrow(run, "chunk int, spans binary")

    def apply(self, each, schema: pa.Schema, ddl: str) -> DataFrame:
        """Runs each(doc_id, bytes, starts, ends) on every document and its maximal runs."""

        def run(key, table, spans):
            chunk = Chunk(table)
            parts = [_unpack(x.as_py(), _SPANS) for x in spans.column("spans")]
            starts, ends = merged(*(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 2
            # runs of two documents may touch, so each is cut at the documents' ends
            rows = []
            first, last = np.searchsorted(ends, chunk.starts, "right"), np.searchsorted(starts, chunk.ends, "left")
            for k, (doc_id, text) in enumerate(zip(chunk.ids, chunk.texts, strict=True)):
                base = int(chunk.starts[k])
                a = np.maximum(starts[first[k] : last[k]] - base, 0)
                b = np.minimum(ends[first[k] : last[k]] - base, len(text))
                rows.append(each(doc_id, text, a.tolist(), b.tolist()))
            out = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()
            if "rest" not in table.column_names:
                return out
            rest = table.column("rest").take(pa.array(chunk.order, pa.int64()))
            return out.append_column("rest", rest.cast(nullable(rest.type)))

        return self.docs.groupBy("chunk").cogroup(self.spans().groupBy("chunk")).applyInArrow(run, ddl)


def kept_bytes(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))


def removed_repeats(docs: DataFrame, match: int = MATCH, kmer: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs.

    A byte goes if a string of `match` bytes covers it that also starts in a document of
    smaller doc_id. Texts are UTF-8 bytes, null texts are empty. Rows of one doc_id are
    never compared with each other; rows without an id count as later than all with one,
    and aren't compared with each other either. No rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def each(doc_id, text, starts, ends):
        return doc_id, len(text), sum(ends) - sum(starts), len(starts), hashlib.sha256(kept_bytes(text, starts, ends)).hexdigest()

    return _Job(docs, match, kmer).apply(each, schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with all its fields nullable, as a declared schema has them."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, nullable(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, nullable(kind.item_type))
    return kind


def without_repeats(docs: DataFrame, match: int = MATCH, kmer: int = KMER) -> DataFrame:
    """docs with the later repeats cut out of `text`, and n_chars counted anew where it exists.

    All rows and columns stay, whatever the columns' names. Where a cut parts a character,
    its remaining bytes go too. A null text becomes an empty one. Rows of one doc_id, and
    rows without any, lose nothing to each other. No rows give no rows.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def each(doc_id, text, starts, ends):
        return doc_id, kept_bytes(text, starts, ends).decode("utf-8", "ignore")

    kind = docs.select(rest).schema.simpleString()
    out = _Job(docs, match, kmer, rest).apply(each, schema, f"doc_id long, text string, rest {kind}").withColumnRenamed("text", "cut")
    columns = {"text": F.col("cut"), "n_chars": F.length("cut").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*((columns[c] if c in columns else F.col("rest")[c]).alias(c) for c in docs.columns))


def repeat_groups(docs: DataFrame, match: int = MATCH, kmer: int = KMER) -> DataFrame:
    """Every maximal repeat of a fragment: passage (bytes), n_occurrences and occurrences (doc_id, start).

    A repeat is maximal within the windows of one anchor; longer passages are chains of
    such groups. Starts count bytes. Null and empty texts have none, and no rows give no
    rows; rows of one doc_id, and those without any, count as one document.
    """
    job = _Job(docs, match, kmer)
    schema = pa.schema([("chunk", pa.int32()), ("passage", pa.binary()), ("n_occurrences", pa.int64()), ("places", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int32()))])

    def run(key, table):
        rows = []
        for _ in group_spans(table.column("chunk").to_pylist(), [x.as_py() for x in table.column("sent")], match, kmer, lambda text, spots: rows.append((0, text, len(spots), [int(p) for _, p, _ in spots], [int(c) for c, _, _ in spots]))):
            pass
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()

    groups = job.fragments().groupBy("part").applyInArrow(run, "chunk int, passage binary, n_occurrences long, places array<long>, chunks array<int>")

    def bounds(key, table):
        chunk = Chunk(table)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(chunk.ids), pa.int32()), "doc_id": pa.array(chunk.ids, pa.int64()), "low": pa.array(chunk.starts.astype(np.int64)), "high": pa.array(chunk.ends.astype(np.int64))})

    where = job.docs.groupBy("chunk").applyInArrow(bounds, "chunk int, doc_id long, low long, high long")
    spots = groups.select("passage", "n_occurrences", F.explode(F.arrays_zip("chunks", "places")).alias("s")).select("passage", "n_occurrences", F.col("s.chunks").alias("chunk"), F.col("s.places").alias("place"))
    named = spots.join(where, (spots["chunk"] == where["chunk"]) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    return named.groupBy("passage", "n_occurrences").agg(F.sort_array(F.collect_set(F.struct("doc_id", (F.col("place") - F.col("low")).alias("start")))).alias("occurrences"))
