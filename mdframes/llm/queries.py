"""One query per operator over the whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.llm.common import crc
from mdframes.llm.divergence import divergence
from mdframes.llm.language import language_id
from mdframes.llm.masked_lm import pseudo_likelihood
from mdframes.llm.packing import pack_documents
from mdframes.llm.pieces import piece_digest
from mdframes.llm.pii import pii_digest
from mdframes.llm.quality import quality
from mdframes.llm.recompression import repeats_digest
from mdframes.llm.repair import repair_digest
from mdframes.llm.sharding import shard
from mdframes.llm.simhash import simhash_groups
from mdframes.llm.tiles import near_vectors
from mdframes.llm.topk import search_embeddings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", crc("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_table(spark, sf_dir, "documents"))


@query
def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op4_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


@query
def op5_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(_table(spark, sf_dir, "embeddings"))


@query
def op8_quantised_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op9_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


@query
def op10_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


@query
def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


@query
def op13_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(_table(spark, sf_dir, "conversations"))


USABLE = """
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLES["op7_max_score"] = f"""
WITH v AS ({USABLE}),
w AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS w FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.w, d.w)::BIGINT AS score
      FROM w q JOIN w d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT query_id, (ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

ORACLES["op8_quantised_tiles"] = f"""
WITH RECURSIVE v AS ({USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, COUNT(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(d.n_links, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id"""


ORACLES["op12_source_divergence"] = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
        translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, UNNEST(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT rid, lang, source, term, COUNT(*) AS n FROM w GROUP BY ALL),
k AS (SELECT lang, term, SUM(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING COUNT(*) >= 3),
v AS (SELECT lang, COUNT(*) AS v, SUM(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT c.lang, c.source, c.term, SUM(c.n)::HUGEINT AS n FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
s AS (SELECT g.lang, g.source, COALESCE((SELECT SUM(n) FROM o WHERE o.lang = g.lang AND o.source = g.source), 0)::HUGEINT AS n FROM g),
p AS (SELECT s.lang, s.source, k.term, COALESCE(o.n, 0) AS n,
        1 + (1000000000::HUGEINT * (COALESCE(o.n, 0) + 1)) // (s.n + v.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
    FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang
    LEFT JOIN o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""
