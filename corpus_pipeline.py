"""From raw documents to packed training sequences: language, quality, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.llm.common import staged
from mdframes.llm.language import keep_identified
from mdframes.llm.packing import pack_documents
from mdframes.llm.pii import redact
from mdframes.llm.quality import keep_good
from mdframes.llm.shingles import row_hash, shingle_groups


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go: null and empty texts, texts without letters, and texts of no learned
    language. Texts are whole; repeated rows stay or go together; an empty table, or one without languages to learn, gives none."""
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents ranked below the threshold go. Null and empty texts are ranked like others, by their features; repeated rows
    stay or go together; an empty table gives an empty one."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more) one row stays: that with the
    smallest doc_id, rows without one last, and among equal ids that with the smallest hash of its columns. Texts without words are one
    group; columns may have any name; an empty table gives an empty one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first")
    kept = shingle_groups(docs).groupBy("group").agg(first).select("first.row").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_hash(docs).alias("row"))
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the whole text is replaced by its kind. Null texts stay null; repeated rows get the same text; an
    empty table gives an empty one."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place. Null and empty texts are one end mark; texts of more than a
    sequence are cut; repeated rows are packed as often as they stand; an empty table gives an empty one."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", packing)]

# Trained models, fingerprints and tokenizers are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
