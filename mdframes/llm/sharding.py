"""Sharding by histogram sort: exact counts refine the splitters, then every row moves once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdframes.llm.common import settled, shuffle_partitions, table

LOW = 24                                    # bits of a key that tell copies of a text apart: half by id, half by row
TOP = np.iinfo(np.int64).max


def _count(keys: DataFrame, edges: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """Exact bytes, rows, least and greatest key of every interval between ``edges``; interval i holds the
    keys from edges[i - 1] up to, not including, edges[i]."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        low, high = np.full(len(edges) + 1, TOP), np.full(len(edges) + 1, -TOP - 1)
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(edges, key, side="right")
            np.add.at(size, at, n)
            np.add.at(rows, at, 1)
            np.minimum.at(low, at, key)
            np.maximum.at(high, at, key)
        bins = np.flatnonzero(rows)
        yield table("bin int, size long, n long, low long, high long",
                    {"bin": bins, "size": size[bins], "n": rows[bins], "low": low[bins], "high": high[bins]})

    found = (keys.mapInArrow(count, "bin int, size long, n long, low long, high long").groupBy("bin")
             .agg(F.sum("size"), F.sum("n"), F.min("low"), F.max("high")))
    return {r[0]: tuple(r[1:]) for r in found.collect()}        # at most one row per probe


def splitters(keys: DataFrame, parts: int, every: int, tolerance: float, loose: float, group_tolerance: float, probes: int = 16) -> np.ndarray:
    """``parts - 1`` keys that cut the rows into runs of equal bytes.

    Every ``every``-th splitter bounds a shard and must meet ``tolerance`` (as a share of a shard's
    bytes), the others ``loose``. Each pass counts exactly what lies below all candidate boundaries;
    where a target's interval is still too wide it gets ``probes`` new boundaries between its least and
    greatest key. A target is settled once a boundary is within its tolerance or a single key is left.
    A shard's boundary moves to the end of a group of equal texts if that costs at most ``group_tolerance``.
    """
    total, low, high = keys.agg(F.sum("size"), F.min("key"), F.max("key")).first()
    if not total:
        return np.zeros(0, np.int64)
    shard = total * every / parts
    targets = {k: total * k // parts for k in range(1, parts)}
    slack = {k: (tolerance if k % every == 0 else loose) * shard / (1 if k % every == 0 else every) for k in targets}
    cum = {low: 0}                                     # exact bytes below a key
    chosen: dict[int, int] = {}
    wanted = {int(x) for x in np.linspace(float(low), float(high), max(probes * parts, 64)) if low < int(x) <= high}
    while wanted:
        edges = np.array(sorted(set(wanted) | set(cum)), np.int64)
        hist = _count(keys, edges)
        sums = np.cumsum([0] + [hist.get(i, (0,))[0] for i in range(len(edges) + 1)])
        cum = {int(e): int(s) for e, s in zip(edges, sums[1:])}
        wanted = set()
        for k, target in targets.items():
            if k in chosen:
                continue
            i = int(np.searchsorted(sums[1:-1], target, side="right"))     # the interval with the target in it
            ends = [int(e) for e in edges[max(i - 1, 0):i + 1]]
            best = min(ends, key=lambda e: abs(cum[e] - target))
            if abs(cum[best] - target) <= slack[k] or i not in hist:
                chosen[k] = best
                continue
            least, most = hist[i][2], hist[i][3]
            if least == most:       # one key: its run starts below the target and ends above it
                above = sums[i + 1]
                chosen[k] = least if least == TOP or target - sums[i] <= above - target else least + 1
            else:
                wanted |= {least + (most - least) * j // probes for j in range(1, probes + 1)} | {least + 1}
        # Only boundaries next to open targets are of further use.
        open_ = [t for k, t in targets.items() if k not in chosen]
        near = np.unique(np.clip(np.searchsorted(sums[1:-1], open_, side="right")[:, None] + np.array([-1, 0]), 0, len(edges) - 1)) if open_ else []
        cum = {int(edges[i]): cum[int(edges[i])] for i in near} | {low: 0}
        wanted -= set(cum)
    whole = {k: [e for e in ((s >> LOW) << LOW, ((s >> LOW) + 1) << LOW) if e <= TOP] for k, s in chosen.items() if k % every == 0}
    edges = np.array(sorted({e for x in whole.values() for e in x} | set(chosen.values())), np.int64)
    if len(edges) and whole:
        hist = _count(keys, edges)
        sums = np.cumsum([hist.get(i, (0,))[0] for i in range(len(edges))])
        cum = {int(e): int(s) for e, s in zip(edges, sums)}
        for k, ends in whole.items():
            best = min(ends, key=lambda e: abs(cum[e] - targets[k]))
            if abs(cum[best] - targets[k]) <= group_tolerance * shard:
                chosen[k] = best
    return np.sort(np.array([chosen[k] for k in sorted(chosen)], np.int64))


def shard(docs: DataFrame, shards: int = 16, part_bytes: int = 32 << 20, tolerance: float = 0.0005, group_tolerance: float = 0.01) -> DataFrame:
    """All rows and columns of ``docs``, sorted by text hash into ``shards`` shards of near-equal bytes,
    with size (UTF-8 bytes plus 1; null: 1), shard (from 0) and slot (gapless from 0 in each shard).
    Input columns of these names are replaced.

    Rows are ordered by 40 bits of the text's hash, 12 of the id's and 12 of the row's number, so copies of a text stay
    together unless a group is too large for the law, and a text held by a third of all rows is still cut, also where these rows
    have one id or none. Null texts and ids are values like others; other columns may have any name. An empty table gives an empty result.

    A shard is written by several tasks, each with a run of about ``part_bytes``; the exact row counts of
    the runs before it give a run's first slot, so rows move in one exchange and no task holds a shard.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    mask, half = (1 << LOW) - 1, (1 << LOW // 2) - 1
    low = F.shiftleft(F.xxhash64("doc_id").bitwiseAND(F.lit(half)), LOW // 2).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(half)))
    key = F.xxhash64("text").bitwiseAND(F.lit(~mask)).bitwiseOR(low)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    # Written once with their keys: a row's number must not change between counting and moving.
    kept = settled(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), key.alias("key"), size.alias("size")))
    keys = kept.select("key", "size")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    every = max(1, -(-max(shuffle_partitions(spark), total // part_bytes) // shards))
    parts = shards * every
    cuts = splitters(keys, parts, every, tolerance, 0.1, group_tolerance)
    rows = np.zeros(parts, np.int64)
    # An interval between equal splitters is empty: counts go by position.
    for i, (_, n, _, _) in _count(keys, cuts).items():
        rows[i] = n
    runs = rows.reshape(shards, every)
    first = (np.cumsum(runs, axis=1) - runs).reshape(-1)

    @F.pandas_udf("struct<part:int,shard:int,first:long>")
    def place(key):
        import pandas as pd
        part = np.searchsorted(cuts, key.to_numpy(), side="right")
        return pd.DataFrame({"part": part.astype(np.int32), "shard": (part // every).astype(np.int32), "first": first[part]})

    placed = kept.withColumn("at", place("key")).select("*", F.col("at.part").alias("part"))
    dealt = placed.repartitionById(parts, F.col("part"))
    slot = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.col("at.first")
    return dealt.select("doc.*", "size", F.col("at.shard").alias("shard"), slot.cast("long").alias("slot"))
