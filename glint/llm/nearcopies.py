"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 at least.

SimHash links at a few bits find most copies, but at similarity 0.8 fingerprints lie 10 +- 3
bits apart, so no small radius finds all. Prefix buckets find the others without loss: if the
shingles of all texts are put in one order, two sets of similarity 0.8 share one of the first
n - ceil(0.8 n) + 1 of each. The order is rarest first by a sample's counts; it decides the
work, not the result. Each candidate pair is confirmed with the sets of its texts.

Candidates come in three rounds: SimHash links and neighbours in a bucket, in linear
number; then each member of a bucket with the one that has most partners so far, such as
the original of many edited copies; then all pairs of a bucket that are still in different
components. So the members of a large group aren't compared with each other. Equal sets
are one point throughout.

In the third round tallies and parities, 64 bytes each, rule out most pairs where they are
found, before any is kept, so a bucket of many texts holds only pairs that may be alike. A
candidate pair is first looked at with sketches, 16 bits of every shingle hash:
sketches never differ in more places than the sets, so what they rule out is ruled out.
Of the others each component has its best pair confirmed with the sets themselves, and
again; those that still part components are then confirmed one and all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batched, drop_source, id_text, materialize, rows_of
from .components import connected_components

WORDS = 5
#: One of so many texts is in the sample that orders the shingles, and so many common shingles are kept of it.
SAMPLE, COMMON = 16, 50_000
#: Bucket rows in one task.
PART = 50_000
#: Neighbours by size that each member of a bucket is paired with on either side, and members of most partners.
NEAR, HUBS = 4, 8


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a text of fewer words is one shingle."""
    parts = text.encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()
    if not parts:
        return np.zeros(0, np.int64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(line)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(parts) - words] + 1)).tolist()
        hashes = [digest(line[a:b]) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 at least; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """16 bits of every hash, sorted. Sketches of two sets differ in no more places than the sets."""
    return np.unique(hashes.astype(np.uint16))


def sketched_difference(a: np.ndarray, b: np.ndarray) -> int:
    """In how many places two sketches differ; if 9 times that is above the sizes' sum, the sets aren't alike."""
    return len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True))


def tally(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each value of their last six bits, 255 at most: 64 bytes.

    Tallies of two sets differ, added up, by no more than the sets do.
    """
    return np.minimum(np.bincount(hashes & 63, minlength=64), 255).astype(np.uint8)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes has each value of the nine bits before the last six: 512 bits.

    Those of two sets differ in no more bits than the sets do in hashes.
    """
    return np.packbits(np.bincount(hashes >> 6 & 511, minlength=512) & 1)


def may_be_alike(one: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the others (128 bytes each: tally, parities) that set may be alike to; sizes has the sums of both sizes."""
    maybe = 9 * np.bitwise_count(others[:, 64:] ^ one[64:]).sum(axis=1, dtype=np.int64) <= sizes
    near = others[maybe, :64].astype(np.int16) - one[:64]
    maybe[maybe] = 9 * np.abs(near).sum(axis=1, dtype=np.int64) <= sizes[maybe]
    return maybe


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (count, hash), one of which any set alike shares."""
    weight = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, weight))[: len(hashes) + 4 * -len(hashes) // 5 + 1]] if len(hashes) else hashes


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set, as a signed long."""
    bits = np.unpackbits(hashes.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big", signed=True)


def text_mark() -> Column:
    """The hash that, with doc_id, tells rows of docs apart; null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for (text,) in rows_of(batches, "text"):
            found = shingles(text)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["token"])

    texts = id_text(docs).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    rows = texts.mapInArrow(run, "token long").groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(COMMON).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _keys(docs: DataFrame) -> DataFrame:
    common, counts = _common(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("sid", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary()), ("tally", pa.binary())])

    def run(batches):
        seen: set[int] = set()  # a task tells each set once, so a group of copies costs a row for each task

        def each():
            for doc_id, text, mark in rows_of(batches, "doc_id", "text", "mark"):
                found = shingles(text)
                sid = int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))
                new = sid not in seen
                seen.add(sid)
                yield doc_id, mark, sid, set_fingerprint(found), len(found), prefix(found, common, counts) if new else [], sketch(found).tobytes() if new else None, tally(found).tobytes() + parities(found).tobytes() if new else None

        yield from batched(each(), schema, weight=lambda row: len(row[5]), most=1 << 21)

    return id_text(docs).withColumn("mark", text_mark()).mapInArrow(run, "doc_id long, mark long, sid long, fp long, n int, prefix array<long>, sketch binary, tally binary")


_BUCKET = "part int, token long, sid long, n int, pos int"


def _shared(key, table):
    """The rows whose token another set of the part has, each (token, set) once."""
    token, sid = table.column("token").to_numpy(), table.column("sid").to_numpy()
    order = np.lexsort((sid, token))
    new = np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (sid[order][1:] != sid[order][:-1])))[: len(order)]
    order = order[new]
    _, inverse, counts = np.unique(token[order], return_inverse=True, return_counts=True)
    return table.take(pa.array(np.sort(order[counts[inverse] > 1])))


def bucket_pairs(token: np.ndarray, sid: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray | None, marks: np.ndarray | None = None) -> np.ndarray:
    """Pairs (a, b), a < b, in the buckets: neighbours by size, or all that differ in root; each once.

    With marks, a row of 128 bytes for each set in ascending order of sid, pairs that they rule out are left out.
    """
    order = np.lexsort((sid, n, token))
    token, sid, n, pos = token[order].copy(), sid[order], n[order].astype(np.int64), pos[order].astype(np.int64)

    def fit(i, j):
        # no more can be shared from the first common shingle on
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])
        return (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * most >= 4 * (n[i] + n[j]))

    found = []
    if root is None:
        for k in range(1, NEAR + 1):
            i = np.flatnonzero(token[k:] == token[:-k])
            i = i[fit(i, i + k)]
            found.append(np.stack((sid[i], sid[i + k]), axis=1))
    else:
        root = root[order]
        place = np.searchsorted(np.unique(sid), sid)
        cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        mixed = np.add.reduceat(np.concatenate((root[1:] != root[:-1], [False])) & np.concatenate((token[1:] == token[:-1], [False])), cuts[:-1], dtype=np.int64) > 0 if len(token) else np.zeros(0, bool)
        held = 0
        for a, b in zip(cuts[:-1][mixed].tolist(), cuts[1:][mixed].tolist(), strict=True):
            names, where, counts = np.unique(root[a:b], return_inverse=True, return_counts=True)
            # rows of the largest component are compared with the others only
            for i in (a + np.flatnonzero(where != counts.argmax())).tolist():
                lo = a + int(np.searchsorted(n[a:b], -(-4 * n[i] // 5)))
                hi = a + int(np.searchsorted(n[a:b], 5 * n[i] // 4, side="right"))
                j = np.arange(lo, hi)
                j = j[(root[j] != root[i]) & fit(np.full(len(j), i), j)]
                if marks is not None and len(j):
                    j = j[may_be_alike(marks[place[i]], marks[place[j]], n[i] + n[j])]
                found.append(np.stack((np.full(len(j), sid[i]), sid[j]), axis=1))
                held += len(j)
                if held > 4_000_000:
                    found, held = [np.unique(np.sort(np.concatenate(found), axis=1), axis=0)], 0
    return np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)


def hub_pairs(token: np.ndarray, sid: np.ndarray, n: np.ndarray, root: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Pairs (a, b), a < b, of each member of a bucket with the HUBS of most partners, if their roots differ."""
    order = np.lexsort((sid, -degree, token))
    token, sid, n, root, degree = token[order], sid[order], n[order].astype(np.int64), root[order], degree[order]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))[: len(token)])
    ends = np.append(first[1:], len(token))
    found = [np.zeros((0, 2), np.int64)]
    for k in range(HUBS):
        there = first + k < ends
        hub = np.repeat((first + k)[there], (ends - first)[there])
        own = np.flatnonzero(np.repeat(there, ends - first))
        fit = (degree[hub] > 0) & (root[own] != root[hub]) & (5 * np.minimum(n[own], n[hub]) >= 4 * np.maximum(n[own], n[hub]))
        found.append(np.sort(np.stack((sid[own[fit]], sid[hub[fit]]), axis=1), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _pairs_of(pairs: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _neighbours(key, table):
    return _pairs_of(bucket_pairs(*(table.column(c).to_numpy() for c in ("token", "sid", "n", "pos")), None))


def _mixed(key, table):
    """The rows of buckets that hold several roots."""
    _, bucket = np.unique(table.column("token").to_numpy(), return_inverse=True)
    root = table.column("root").to_numpy()
    low, high = np.full(bucket.max(initial=0) + 1, np.iinfo(np.int64).max), np.full(bucket.max(initial=0) + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, bucket, root)
    np.maximum.at(high, bucket, root)
    return table.filter(pa.array((low < high)[bucket]))


def _apart(key, table):
    """The pairs of different roots that tallies and parities don't rule out."""
    sid = table.column("sid").to_numpy()
    _, first = np.unique(sid, return_index=True)
    marks = np.frombuffer(b"".join(table.column("tally").take(pa.array(first)).to_pylist()), np.uint8).reshape(-1, 128)
    return _pairs_of(bucket_pairs(*(table.column(c).to_numpy() for c in ("token", "sid", "n", "pos", "root")), marks))


def _hubs(key, table):
    return _pairs_of(hub_pairs(*(table.column(c).to_numpy() for c in ("token", "sid", "n", "root", "degree"))))


class _Job:
    """The tables of one run: a point for each distinct set, and what is linked so far."""

    #: Points that are broadcast to find their texts, at most; 40 bytes each.
    BROADCAST = 1_000_000

    def __init__(self, docs: DataFrame):
        self.docs = id_text(docs)
        self.keys = materialize(_keys(docs), "keys")
        self.points = materialize(self.keys.groupBy("sid").agg(F.min(F.struct(F.col("doc_id").alias("own_id"), "mark")).alias("own"), F.first("fp").alias("fp"), F.first("n").alias("n")), "sets")
        self.sure: DataFrame | None = None
        self.roots: DataFrame | None = None

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their sketches don't rule out, with the difference of the sketches in parts of the sizes."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct()
        told = self.keys.where("sketch is not null").select("sid", "n", "sketch").join(ends, F.col("sid") == F.col("need")).dropDuplicates(["sid"])
        told = materialize(told.select("sid", "n", "sketch"), "sketches")

        def check(batches):
            for batch in batches:
                a, b, left, right, n, m = (batch.column(i) for i in range(6))
                differ = np.array([sketched_difference(np.frombuffer(x.as_buffer(), np.uint16), np.frombuffer(y.as_buffer(), np.uint16)) for x, y in zip(left, right, strict=True)], np.int64)
                both = n.to_numpy().astype(np.int64) + m.to_numpy()
                keep = pa.array(9 * differ <= both)
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(differ / np.maximum(both, 1)).filter(keep)], names=["a", "b", "off"])

        of = lambda end, name, size: told.select(F.col("sid").alias(end), F.col("sketch").alias(name), F.col("n").alias(size))
        both = pairs.join(of("a", "left", "n"), "a").join(of("b", "right", "m"), "b")
        out = materialize(both.select("a", "b", "left", "right", "n", "m").mapInArrow(check, "a long, b long, off double"), "possible")
        drop_source(told)
        return out

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are alike; sets are made anew from one text each."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct()
        wanted = materialize(self.points.join(ends, F.col("sid") == F.col("need")).select("sid", "own.*"), "wanted")
        # few points find their texts without those being dealt; beyond that both sides are
        few = F.broadcast(wanted) if wanted.count() <= self.BROADCAST else wanted
        texts = self.docs.withColumn("m", text_mark()).join(few, F.col("m").eqNullSafe(F.col("mark")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("sid", "text")

        def run(batches):
            def each():
                for sid, text in rows_of(batches, "sid", "text"):
                    yield sid, shingles(text).tobytes()

            yield from batched(each(), pa.schema([("sid", pa.int64()), ("set", pa.binary())]), weight=lambda row: len(row[1]))

        sets = materialize(texts.mapInArrow(run, "sid long, set binary").dropDuplicates(["sid"]), "sets")

        def check(batches):
            for batch in batches:
                a, b, left, right = (batch.column(i) for i in range(4))
                keep = pa.array([alike(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)) for x, y in zip(left, right, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

        both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("set").alias("left")), "a").join(sets.select(F.col("sid").alias("b"), F.col("set").alias("right")), "b")
        out = materialize(both.select("a", "b", "left", "right").mapInArrow(check, "a long, b long"), "alike")
        for done in (wanted, sets):
            drop_source(done)
        return out

    def rooted(self, pairs: DataFrame) -> DataFrame:
        """The pairs with the roots of both ends, ra and rb, where these differ."""
        if self.roots is None:
            return pairs.withColumn("ra", F.col("a")).withColumn("rb", F.col("b"))
        of = lambda end, name: self.roots.select(F.col("node").alias(end), F.col("root").alias(name))
        out = pairs.join(of("a", "_a"), "a", "left").join(of("b", "_b"), "b", "left")
        return out.withColumn("ra", F.coalesce("_a", "a")).withColumn("rb", F.coalesce("_b", "b")).drop("_a", "_b").where("ra <> rb")

    def link(self, pairs: DataFrame, rounds: int = 2) -> DataFrame:
        """Confirms what links components among the candidate pairs; returns those that sketches don't rule out."""
        possible = self.sketched(pairs)
        left = possible
        for k in range(rounds + 1):
            open_pairs = materialize(self.rooted(left), "open")
            if not open_pairs.limit(1).count():
                break
            if k < rounds:
                ends = open_pairs.select(F.col("ra").alias("end"), "a", "b", "off").unionAll(open_pairs.select(F.col("rb").alias("end"), "a", "b", "off"))
                tried = ends.groupBy("end").agg(F.min(F.struct("off", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
            else:
                tried = open_pairs.select("a", "b")
            tried = materialize(tried, "tried")
            found = self.confirmed(tried)
            left = open_pairs.join(tried, ["a", "b"], "left_anti").select("a", "b", "off")
            self.sure = found if self.sure is None else self.sure.unionAll(found)
            self.roots = materialize(connected_components(self.sure), "roots")
        return possible


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text) and root for every row of docs; rows of one root are near copies, or linked by some.

    Null texts are empty; texts without a word are alike. Null ids and repeated rows are
    rows like others. No rows give no rows. Other columns are not read.
    """
    job = _Job(docs)
    keys, points = job.keys, job.points
    total = keys.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = -(-total // PART) or 1
    rows = keys.select("sid", "n", F.posexplode("prefix").alias("pos", "token")).select(F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int").alias("part"), "token", "sid", "n", "pos")
    shared = materialize(rows.groupBy("part").applyInArrow(_shared, _BUCKET), "shared")
    leads = materialize(points.groupBy("fp").agg(F.min("sid").alias("lead")), "leads")
    links = simhash.near_links(leads.select("fp"))
    one, two = leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), leads.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    close = links.join(one, "a").join(two, "b").select("x", "y").unionAll(points.select("fp", "sid").join(leads, "fp").where("sid <> lead").select("lead", "sid"))
    close = close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    first = materialize(close.unionAll(shared.groupBy("part").applyInArrow(_neighbours, "a long, b long")).distinct(), "pairs")
    possible = job.link(first)
    partners = materialize(possible.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").cast("int").alias("degree")), "partners")

    def placed() -> DataFrame:
        if job.roots is None:
            return shared.withColumn("root", F.col("sid"))
        return shared.join(job.roots, F.col("sid") == F.col("node"), "left").select("part", "token", "sid", "n", "pos", F.coalesce("root", "sid").alias("root"))

    ranked = placed().join(partners, F.col("sid") == F.col("end"), "left").select("part", "token", "sid", "n", "root", F.coalesce("degree", F.lit(0)).alias("degree"))
    second = materialize(ranked.groupBy("part").applyInArrow(_hubs, "a long, b long").distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    job.link(second)
    # only buckets of several roots get the tallies, and only pairs that these let pass leave the task
    mixed = materialize(placed().groupBy("part").applyInArrow(_mixed, f"{_BUCKET}, root long"), "mixed")
    told = keys.where("tally is not null").select(F.col("sid").alias("of"), "tally").dropDuplicates(["of"])
    marked = mixed.join(told, F.col("sid") == F.col("of")).drop("of")
    third = materialize(marked.groupBy("part").applyInArrow(_apart, "a long, b long").distinct().join(first.unionAll(second), ["a", "b"], "left_anti"), "pairs")
    job.link(third)
    for done in (points, shared, leads, first, second, mixed, third):
        drop_source(done)
    roots = job.roots
    if roots is None:
        return keys.select("doc_id", "mark", F.col("sid").alias("root"))
    return keys.join(roots, keys["sid"] == roots["node"], "left").select("doc_id", "mark", F.coalesce("root", "sid").alias("root"))
