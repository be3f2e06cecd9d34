"""Exact top-k search by inner product with MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdframes.llm.common import runs, shuffle_partitions, table
from mdframes.llm.tiles import finite, matrix

GROUP = 8       # terms probed between two looks at the bounds
SEEDS = 32      # documents scored in full to get a first bound


class Shard:
    """The postings of some documents: a row of weights per term, with each term's extremes."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids = ids
        # Whole numbers whose sums stay below 2^53 are exact as doubles; others are kept as Python integers.
        self.postings = np.ascontiguousarray(weights.T)
        self.low, self.high = weights.min(axis=0), weights.max(axis=0)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the ``k`` best documents but ``own``; ties go to the smaller id."""
        bound = np.maximum(0, np.maximum(query * self.low, query * self.high))
        terms = np.argsort(-bound, kind="stable")
        terms = terms[query[terms] != 0]
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)[1:]       # what the terms after each can add
        worth = query[terms]
        score = worth[:GROUP] @ self.postings[terms[:GROUP]]
        # A few documents in full give the k-th score to beat.
        other = self.ids != own
        best = np.flatnonzero(other)
        if len(best) > SEEDS + k:
            best = best[np.argpartition(-score[best], SEEDS + k)[:SEEDS + k]]
        seeds = query @ self.postings[:, best] if len(best) else np.zeros(0)
        least = np.partition(seeds, -k)[-k] if len(seeds) >= k else -np.inf
        # Terms from here on can't lift a document to the bound by themselves: their postings aren't traversed.
        essential = int(np.argmax(np.append(rest, -np.inf) < least)) + 1 if least > 0 else len(terms)
        alive = np.flatnonzero(other & (score + rest[min(GROUP, len(terms)) - 1] >= least)) if len(terms) else np.flatnonzero(other)
        score = score[alive]
        for at in range(GROUP, len(terms), GROUP):
            if at >= essential and len(alive) <= k:
                last = terms[at:]
                score = score + query[last] @ self.postings[np.ix_(last, alive)]
                break
            group = terms[at:at + GROUP]
            score = score + query[group] @ self.postings[np.ix_(group, alive)]
            keep = score + rest[min(at + GROUP, len(terms)) - 1] >= least
            if not keep.all():
                alive, score = alive[keep], score[keep]
        order = np.lexsort([self.ids[alive], -score])[:k]
        return alive[order], score[order]


def top_k(index: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, query_rows: int = 8192) -> DataFrame:
    """For every row of ``queries`` the ``k`` rows of ``index`` (all, if fewer) with the highest inner product,
    but for rows of the query's own vec_id: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Both have vec_id and weights (array<long>, missing terms are zero). Rows with a null vec_id or
    weights take no part; equal queries count once, rows repeated in the index as often as they occur.
    The index is dealt into shards of about ``shard_rows`` and the queries into blocks of about
    ``query_rows``; each (block, shard) is searched exactly by itself and the shards' lists are merged.
    """
    spark = index.sparkSession
    index = index.select("vec_id", "weights").dropna().groupBy("vec_id", "weights").agg(F.count("*").alias("n"))
    queries = queries.select("vec_id", "weights").dropna().distinct()
    shards = max(1, -(-index.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    shard, block = F.pmod(F.xxhash64("vec_id", "weights"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", "weights"), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    tiles = (index.select(every(blocks).alias("block"), shard.alias("shard"), F.lit(1).alias("role"), "vec_id", "weights", "n")
             .unionAll(queries.select(block.alias("block"), every(shards).alias("shard"), F.lit(0).alias("role"), "vec_id", "weights", F.lit(1).cast("long"))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, ["block", "shard"]):
            role, ids, n = (tile.column(c).to_numpy() for c in ("role", "vec_id", "n"))
            weights = matrix(tile.column("weights"), np.int64)
            docs, asks = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
            if not len(docs) or not len(asks):
                continue
            top = float(np.abs(weights.astype(np.float64)).max(initial=0))
            weights = weights.astype(np.float64 if top * top * weights.shape[1] < 2 ** 52 else object)
            part = Shard(ids[docs], weights[docs])
            out: list[tuple] = []
            for a in asks:
                at, score = part.search(weights[a], ids[a], k)
                out += zip([int(ids[a])] * len(at), ids[docs[at]].tolist(), map(int, score), n[docs[at]].tolist())
            query, found, score, copies = zip(*out) if out else [()] * 4
            yield table("query_id long, vec_id long, score long, n long", {"query_id": query, "vec_id": found, "score": score, "n": copies})

    dealt = tiles.repartition(max(shuffle_partitions(spark), shards), "block", "shard").sortWithinPartitions("block", "shard")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long, n long")
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, weights): floor(factor * component) of every vector that is there and all finite."""
    weights = F.transform("embedding", lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    return vectors.where(finite(F.col("embedding"))).select("vec_id", weights.alias("weights"))


def search_embeddings(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``top_k`` of all usable vectors for those whose vec_id is divisible by ``every``."""
    index = scaled(vectors)
    return top_k(index, index.where(F.col("vec_id") % every == 0), k)
