"""SimHash near-duplicates: 64-bit fingerprints, linked with vantage-point trees.

Fingerprints of equal value are one point, so a group of copies is one point however
large it is. Random 64-bit fingerprints lie 32 +- 4 bits apart, so a single tree hardly
parts them at radius 4: its shards overlap, and more so the more there are. Hence the
bits are cut into radius + 1 groups. Two points within `radius` bits are equal in at
least one group, so a vantage-point tree over each group's distance, read with that
group's share of the radius (0), brings each linked pair together in a shard, and each
point goes to as many shards as there are groups, however many points there are. With
more bits of radius than groups, that share isn't 0, and the triangle bound sends a point
to each shard whose boundary it is near.

A task takes one shard, or two blocks of a shard that couldn't be parted further. It
holds a vantage-point tree over all 64 bits, prunes it by the triangle inequality at the
full radius, and returns one link to the root of each local component, never all pairs.
A group of 13 bits has 8192 shards at most; beyond that many full blocks of distinct
fingerprints (about 270 million), the pairs of blocks grow faster than the points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, drop_source, id_text, materialize, rows_of
from .components import connected_components

WORDS = 4
RADIUS = 4
SEED = 42
#: Groups of bits at most.
GROUPS = 8
#: Points in one block; a task compares a block with itself or another.
BLOCK = 32_768
#: Fingerprints that the upper trees are built from.
SAMPLE = 8_192
#: Points in a leaf of the tree that a task builds.
LEAF = 256

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of all shingles of a text, repeats included; 0 if it has no word."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(parts) - words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], dtype=np.uint64).astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long, for every row; null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        def each():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                fp = fingerprint(text)
                yield doc_id, fp - (1 << 64) if fp >> 63 else fp

        yield from batched(each(), schema)

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """A vantage-point tree over unsigned 64-bit fingerprints.

    Inner nodes hold a vantage point and the median distance to it: points at most that
    far lie inside, all others outside. Leaves are numbered from 0.
    """

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 64):
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(points)), points, leaf, depth)

    def _grow(self, rows: np.ndarray, points: np.ndarray, leaf: int, depth: int):
        if len(rows) > leaf and depth > 0:
            vantage = points[rows[len(rows) // 2]]
            far = np.bitwise_count(points[rows] ^ vantage)
            middle = int(np.median(far))
            if middle == far.max():
                middle -= 1
            inside = far <= middle
            if inside.any() and not inside.all():
                return vantage, middle, self._grow(rows[inside], points, leaf, depth - 1), self._grow(rows[~inside], points, leaf, depth - 1)
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def reach(self, points: np.ndarray, radius: int):
        """Yields (leaf, rows): the rows of `points` that may have a neighbour in that leaf."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            vantage, middle, inside, outside = node
            far = np.bitwise_count(points[rows] ^ vantage).astype(np.int16)
            todo += [(inside, rows[far - radius <= middle]), (outside, rows[far + radius > middle])]


class Union:
    """Disjoint sets over 0..n-1, the smallest member as the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]; after a few joins most pairs of a dense group are done at once."""
        step = 256
        while len(a):
            for i, j in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
                while i != self.up[i]:
                    i = self.up[i]
                while j != self.up[j]:
                    j = self.up[j]
                self.up[max(i, j)] = min(i, j)
            up = self.flatten()
            a, b = up[a[step:]], up[b[step:]]
            apart = a != b
            a, b = a[apart], b[apart]
            step *= 2


def local_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) for every point with a neighbour: left against right, or left in itself."""
    points = left if right is None else np.concatenate((left, right))
    sets, own, base = Union(len(points)), left if right is None else right, 0 if right is None else len(left)
    tree = VantageTree(own, LEAF)
    for leaf, rows in tree.reach(left, radius):
        members = tree.leaves[leaf]
        for at in range(0, len(rows), 8192):
            part = rows[at : at + 8192]
            i, j = np.nonzero(np.bitwise_count(left[part][:, None] ^ own[members][None, :]) <= radius)
            i, j = part[i], members[j] + base
            if right is None:
                keep = i < j
                i, j = i[keep], j[keep]
            sets.link(i, j)
    up = sets.flatten()
    moved = np.flatnonzero(up != np.arange(len(up)))
    return points[moved], points[up[moved]]


def near_links(points: DataFrame, radius: int = RADIUS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` within `radius` bits, transitively.

    `sample` fingerprints, in the order of their hash, shape the upper trees; the result
    doesn't depend on them. What reaches the driver is that sample and a count per shard.
    """
    n = points.count()
    seen = [r.fp for r in points.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    base = np.array(seen, np.int64).view(np.uint64)
    # a single block needs no parting
    masks = bit_groups(min(radius + 1, GROUPS) if n > block else 1)
    within = radius // len(masks)
    trees = [VantageTree(base & mask, max(1, len(base) * block // max(1, 2 * n)) if n > block else len(base)) for mask in masks]
    bases = np.cumsum([0] + [len(tree.leaves) for tree in trees])
    schema = pa.schema([("pair", pa.int64()), ("side", pa.int32()), ("fp", pa.int64())])

    def own(fps, g):
        """Yields (shard, rows): the shard of group g in whose region each row lies."""
        for leaf, rows in _own_leaf(trees[g], fps & masks[g]):
            if len(rows):
                yield int(bases[g]) + leaf, rows

    def sizes(batches):
        total = np.zeros(int(bases[-1]), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for g in range(len(masks)):
                for shard, rows in own(fps, g):
                    total[shard] += len(rows)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["shard", "n"])

    counted = points.mapInArrow(sizes, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    parts = {r.shard: -(-r.n // block) for r in counted}
    first, count = {}, 0
    for shard in sorted(parts):
        first[shard] = count
        count += parts[shard]

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for g in range(len(masks)):
                home = np.zeros(len(fps), np.int64)
                for shard, rows in own(fps, g):
                    home[rows] = first[shard] + (mixed[rows] % np.uint64(parts[shard])).astype(np.int64)
                for leaf, rows in trees[g].reach(fps & masks[g], within):
                    shard = int(bases[g]) + leaf
                    for other in range(first.get(shard, 0), first.get(shard, 0) + parts.get(shard, 0)):
                        mine = home[rows]
                        pair = np.minimum(mine, other) * count + np.maximum(mine, other)
                        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array((mine > other).astype(np.int32)), pa.array(fps[rows].view(np.int64))], schema=schema)

    def compare(key, table):
        side = table.column("side").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        pair = key[0].as_py()
        left = fps[side == 0]
        a, b = local_links(left, None if pair // count == pair % count else fps[side == 1], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return points.mapInArrow(deal, "pair long, side int, fp long").groupBy("pair").applyInArrow(compare, "a long, b long")


def _own_leaf(tree: VantageTree, points: np.ndarray):
    """Yields (leaf, rows): the leaf in whose region each row lies."""
    todo = [(tree.root, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            yield node, rows
            continue
        vantage, middle, inside, outside = node
        near = np.bitwise_count(points[rows] ^ vantage) <= middle
        todo += [(inside, rows[near]), (outside, rows[~near])]


def bit_groups(groups: int) -> list[np.uint64]:
    """Masks that deal the 64 bits into groups of neighbours, as even as can be."""
    cuts = [64 * i // groups for i in range(groups + 1)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    Documents are linked if their fingerprints differ in at most `radius` bits; the
    component_id is the smallest doc_id that links reach. Null and wordless texts have
    fingerprint zero and link like others; rows with a null doc_id link, but name a
    component only if it has no other id. Repeated rows stay. No rows give no rows.
    Columns other than doc_id and text are not read.
    """
    prints = materialize(fingerprints(docs), "simhash")
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    roots = connected_components(near_links(points.select("fp"), radius))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = materialize(rooted.join(named, "root").select(F.col("fp").alias("label_fp"), "component_id"), "labels")
    for done in (points, rooted):
        drop_source(done)
    return prints.join(labels, prints["fp"] == labels["label_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
