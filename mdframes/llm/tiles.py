"""Embedding near-duplicates: quantised tile products with error bounds, exact where a pair may qualify."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import connected, forest, runs, shuffle_partitions, staged, table

STRIP = 512         # rows of a tile that are multiplied at a time
PAIRS = 1 << 16     # pairs whose vectors are gathered at a time


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    # Null components make forall null, which counts as false.
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False))


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """List column as a matrix; shorter lists are padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return out


def _quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit integers (held as float32, in which their products are exact), scales, and the norm of what rounding took."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    left = np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-9
    return q.astype(np.float32 if unit.shape[1] <= 1024 else np.float64), scale, left


def _links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows with a cosine of at least ``threshold``; only i < j where both sides are the ``same``."""
    qa, sa, ra = _quantised(a)
    qb, sb, rb = (qa, sa, ra) if same else _quantised(b)
    # With u = su qu + eu: |u.v - su sv qu.qv| <= ru (1 + rv) + rv (1 + ru) + ru rv.
    for at in range(0, len(a), STRIP):
        part = slice(at, at + STRIP)
        near = qa[part] @ qb.T
        near *= sa[part, None].astype(near.dtype)
        near *= sb[None, :].astype(near.dtype)
        worst = ra[part].max() + rb.max() + 3 * ra[part].max() * rb.max() + 1e-5
        i, j = np.nonzero(near >= threshold - worst)
        i = i + at
        keep = near[i - at, j] + ra[i] + rb[j] + 3 * ra[i] * rb[j] + 1e-5 >= threshold
        if same:
            keep &= i < j
        i, j = i[keep], j[keep]
        if len(i) > a[part].shape[0] * len(b) // 16:       # many: the whole strip in full precision
            full = a[part] @ b.T
            sure = full[i - at, j] >= threshold
        else:
            sure = np.zeros(len(i), bool)
            for k in range(0, len(i), PAIRS):
                cut = slice(k, k + PAIRS)
                sure[cut] = np.einsum("ij,ij->i", a[i[cut]], b[j[cut]]) >= threshold
        yield i[sure], j[sure]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, block: int = 8192) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id and kept.

    Two vectors link if their cosine in double precision is at least ``threshold``. Null or zero vectors
    and those with a null or non-finite component link with nothing; shorter vectors are compared as if
    padded with zeros. Equal vectors are compared once and counted as often as they occur; rows that
    repeat a vec_id count as rows of their own. A component's id is its smallest vec_id; rows with a null
    vec_id are linked and counted but never name a component. Other columns are ignored.

    Different vectors are dealt into blocks of about ``block``; each pair of blocks is one tile. A tile
    emits how much each vector links to and a spanning forest of its links, never all pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    usable = finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    same = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = staged(same.withColumn("node", F.monotonically_increasing_id()))
    blocks = max(1, -(-nodes.count() // block))
    tiles = (nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
             .select((F.least("block", "other") * blocks + F.greatest("block", "other")).alias("tile"),
                     (F.col("block") * blocks + F.col("other")).alias("side"), "node", "n", "embedding"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["tile"]):
            x = matrix(tile.column("embedding"))
            x /= np.linalg.norm(x / np.abs(x).max(axis=1)[:, None], axis=1)[:, None] * np.abs(x).max(axis=1)[:, None]
            side, node, n = (tile.column(c).to_numpy() for c in ("side", "node", "n"))
            first = np.flatnonzero(side == side.min())
            second = np.flatnonzero(side != side.min())
            alone = len(set(divmod(tile.column("tile")[0].as_py(), blocks))) == 1      # a block with itself
            if not alone and not len(second):
                continue
            a, b = (first, first) if alone else (first, second)
            weight, left, right = np.zeros(len(x), np.int64), [], []
            for i, j in _links(x[a], x[a] if alone else x[b], threshold, alone):
                i, j = a[i], b[j]
                np.add.at(weight, i, n[j])
                np.add.at(weight, j, n[i])
                label = forest(i, j, len(x)) if len(i) else np.arange(len(x))
                far = np.flatnonzero(label != np.arange(len(x)))
                left.append(far)
                right.append(label[far])
            label = forest(np.concatenate(left), np.concatenate(right), len(x))
            hit = np.flatnonzero(weight)
            yield table("a long, b long, links long", {"a": node[hit], "b": node[label[hit]], "links": weight[hit]})

    dealt = tiles.repartition(max(shuffle_partitions(spark), blocks), "tile").sortWithinPartitions("tile", "side")
    found = staged(dealt.mapInArrow(compare, "a long, b long, links long"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "_node")
    roots = connected(found.select("a", "b").distinct()).withColumnRenamed("node", "_member")
    named = nodes.join(links, nodes.node == links._node, "left").join(roots, nodes.node == roots._member, "left")
    named = named.select("embedding", "least", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(least, "root").select(F.col("embedding").alias("_vector"), "n_links", "component")
    out = rows.join(known, F.when(usable, F.col("embedding")) == F.col("_vector"), "left")
    component = F.when(F.col("_vector").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
