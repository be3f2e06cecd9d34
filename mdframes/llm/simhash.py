"""SimHash near-duplicates by a forest of vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import connected, forest, runs, staged, table

ROWS = 500    # texts whose hashes are held at a time
SPLIT = 48    # points below which a tree node is compared directly
LANES = np.uint64(0x0101010101010101)


def _shingles(text: str | None, width: int, seed: int) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    h = xxhash.xxh64_intdigest
    return [h(line[a:b - 1], seed) for a, b in zip([0, *ends], ends[width - 1:])]


def majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes: bit set where over half of the run has it."""
    at, counts = 0, np.zeros((len(starts), 64), np.int64)
    # Eight bit positions share a word of byte counters, summed over at most 255 hashes at a time.
    pieces = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts, sizes)]).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), -(-sizes // 255))
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, pieces)
        for byte in range(8):
            part = ((lanes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            at = 8 * byte + shift
            counts[:, at] = np.bincount(owner, part, len(starts)).astype(np.int64)
    bits = (2 * counts > sizes[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for every row: the SimHash of the text's lower-cased word shingles. A text
    without words, null included, has fingerprint 0; fewer words than ``width`` make one shingle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                found = [np.array(_shingles(t, width, seed), np.uint64) for t in batch.column(1).to_pylist()]
                sizes = np.array([len(x) for x in found], np.int64)
                fp = np.zeros(len(found), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    n = sizes[full]
                    fp[full] = majority(np.concatenate(found), np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, fp long")


class Tree:
    """A vantage-point tree over the Hamming distance on the bits of ``mask``.

    Each node holds a vantage point and the median distance; points up to the median go inside,
    others outside. Two points at most ``radius`` apart differ by at most ``radius`` in their distance
    to any vantage point, so a point that close to a boundary visits both sides.
    """

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list[tuple] = []      # (vantage, median, inside, outside); a leaf is its number, negated
        self.leaves = 0
        self.root = self._grow(sample & self.mask, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        cut = _cut(points, self.mask) if len(points) > leaf else None
        if cut is None:
            self.leaves += 1
            return -self.leaves
        vantage, median, far = cut
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (vantage, median, self._grow(points[far <= median], leaf),
                          self._grow(points[far > median], leaf))
        return at

    def shards(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, indices of the points that live in it or are within the radius of it)."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node, at
                continue
            vantage, median, inside, outside = self.nodes[node]
            far = np.bitwise_count((points[at] ^ vantage) & self.mask).astype(np.int64)
            stack += [(inside, at[far <= median + self.radius]), (outside, at[far > median - self.radius])]


def _cut(points: np.ndarray, mask: np.uint64) -> tuple | None:
    """A vantage point, the median distance and all distances; None if all points lie equally far."""
    for vantage in (points[len(points) // 2], points[0]):
        far = np.bitwise_count((points ^ vantage) & mask).astype(np.int64)
        if far.min() < far.max():
            return vantage, min(int(np.median(far)), int(far.max()) - 1), far
    return None


def _near(points: np.ndarray, mask: np.uint64, radius: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) that connect all points at most ``bits`` apart whose masked distance is at
    most ``radius``; links within a group of near points are a spanning tree at least."""
    left, right = [], []
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        cut = _cut(points[at], mask) if len(at) > SPLIT else None
        sides = [] if cut is None else [at[cut[2] <= cut[1] + radius], at[cut[2] > cut[1] - radius]]
        if sides and max(map(len, sides)) < len(at):
            stack += [s for s in sides if len(s) > 1]
        elif len(at) <= 256:
            near = np.triu(np.bitwise_count(points[at][:, None] ^ points[at][None, :]) <= bits, 1)
            i, j = np.nonzero(near)
            left.append(at[i])
            right.append(at[j])
        else:  # not separable: grow each group from one point, comparing only with points not yet reached
            rest = at
            while len(rest):
                front, rest = [rest[0]], rest[1:]
                while front and len(rest):
                    x = front.pop()
                    near = np.bitwise_count(points[rest] ^ points[x]) <= bits
                    if near.any():
                        new = rest[near]
                        left.append(np.full(len(new), x))
                        right.append(new)
                        front += new.tolist()
                        rest = rest[~near]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left).astype(np.int64), np.concatenate(right).astype(np.int64)


def near_links(points: DataFrame, bits: int = 3, blocks: int = 4, shard_rows: int = 1000, sample: int = 50_000) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints at most ``bits`` bits apart; ``points`` holds
    distinct 64-bit fingerprints in one long column.

    On all 64 bits random fingerprints lie 32 +- 4 from any vantage point, so a radius of 3 prunes
    next to nothing. Distances are therefore measured on blocks of bits: two fingerprints at most
    ``bits`` apart are at most ``bits // blocks`` apart on one of ``blocks`` blocks, so a tree per
    block with that radius finds every pair. ``blocks=1`` is the plain tree.

    The upper levels are fitted on a tenth of the fingerprints, at most ``sample``, and every fingerprint is sent to
    its shard and to those whose boundary it overlaps. A shard of more than ``shard_rows`` is split into
    pairs of parts, each of which is a task's work; inside, the tree goes on until points are few.
    """
    spark = points.sparkSession
    points = points.toDF("fp")
    total = points.count()
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    radius = bits // blocks
    chosen = np.array([r[0] for r in points.orderBy(F.xxhash64("fp")).limit(min(sample, -(-total // 10))).collect()], np.int64).view(np.uint64)
    leaf = max(8, int(len(chosen) * shard_rows / max(total, 1) / 2))
    trees = [Tree(chosen, m, radius, leaf) for m in masks]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                parts = list(tree.shards(fp))
                if parts:
                    at = np.concatenate([i for _, i in parts])
                    shard = np.concatenate([np.full(len(i), s) for s, i in parts])
                    yield table("tree int, shard int, fp long", {"tree": np.full(len(at), t, np.int32), "shard": shard,
                                                                 "fp": fp[at].view(np.int64)})

    routed = staged(points.mapInArrow(route, "tree int, shard int, fp long"))
    sizes = routed.groupBy("tree", "shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = (routed.join(sizes, ["tree", "shard"]).withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .filter("parts = 1 or part <> other")
             .select("tree", F.xxhash64("tree", "shard", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["tile", "tree"]):
            fp = np.unique(run.column("fp").to_numpy()).view(np.uint64)
            i, j = _near(fp, np.uint64(masks[run.column("tree")[0].as_py()]), radius, bits)
            if len(i):
                used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = used[forest(at[:len(i)], at[len(i):], len(used))]
                far, ids = root != used, fp.view(np.int64)
                yield table("a long, b long", {"a": ids[used[far]], "b": ids[root[far]]})

    tiles = tiles.repartition(_tasks(spark), "tile").sortWithinPartitions("tile", "tree")
    return tiles.mapInArrow(compare, "a long, b long").distinct()


def _tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def simhash_groups(docs: DataFrame, bits: int = 3, blocks: int = 4, width: int = 3, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest
    doc_id reachable over fingerprints at most ``bits`` bits apart.

    Texts without words have fingerprint zero and link like any other. Rows with a null doc_id take
    part; a group of them alone has a null component_id. Equal fingerprints are compared once, however
    many rows share them. Other columns of ``docs`` are ignored.
    """
    prints = staged(fingerprints(docs, width, seed))
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(near_links(points.select("fp"), bits, blocks))
    linked = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.filter("root <> fp or least is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root", "left").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
