"""Text files as ordered line tables, read in parallel.

A big file is split into blocks by Spark. Lines keep a total order without a global sort: the
block start orders blocks, and within a block lines arrive in file order. Whatever depends on
earlier lines (frame counters, the last cell seen) is a scan over blocks, so one huge file spreads
over as many tasks as it has blocks. Gzip files cannot be split and form one block each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.operators.scan import running, tasks_for
from mdframes.staging import stage

LINE = ["file", "block", "seq"]
LINES_PER_STRETCH = 1 << 16     # a block may have millions of lines
LINES_PER_TASK = 100_000        # lines that a task numbers


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """file, block, seq, line."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(paths if isinstance(paths, str) else list(paths))
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def numbered(lines: DataFrame) -> DataFrame:
    """Add ``ln``, the line number in its file, counting from 1, and ``stretch``, the part of the block a line stands in.

    Lines are dealt by stretches to as many tasks as there are lines for, so that no task sorts whole blocks.
    """
    df = lines.withColumn("stretch", F.struct("block", F.floor(F.col("seq") / LINES_PER_STRETCH).alias("part")))
    tasks = tasks_for(lines.count(), LINES_PER_TASK, lines.sparkSession)
    return running(df, ["file"], "stretch", ["seq"], {"ln": F.lit(1)}, tasks)


def stem(file: Column | str = "file") -> Column:
    """File name without directory, trajectory suffix and ``.gz``."""
    f = F.col(file) if isinstance(file, str) else file
    return F.regexp_extract(f, r"([^/]+?)(?:\.(?:pdb|xyz|arc|txt|out|log|csv))?(?:\.gz)?$", 1)


def renumber(frames: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``frame`` = 0, 1, 2, ... along ``order`` (an increasing integer) within ``keys``."""
    df = frames.withColumn("_b", F.floor(F.col(order) / 4096))
    df = running(df, keys, "_b", [order], {"frame": F.lit(1).cast("long")})
    return df.withColumn("frame", F.col("frame") - 1).drop("_b")


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """file and length of every file, without reading contents; each path once."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
          .load(paths if isinstance(paths, str) else list(paths)))
    return df.select(F.col("path").alias("file"), "length").dropDuplicates(["file"])


def numbered_series(files: DataFrame, prefix: str | None = None) -> DataFrame:
    """Snapshots ``prefix.001, prefix.002, ...`` of each directory: directory, prefix, index, file.

    The given prefix, or the one with the most files (ties: the first by name). Asking for a
    prefix that no directory has is an error.
    """
    name = r"/([^/]+)\.(\d{3,})$"
    df = files.where(F.col("file").rlike(name)).select(
        F.regexp_replace("file", r"/[^/]+$", "").alias("directory"),
        F.regexp_extract("file", name, 1).alias("prefix"),
        F.regexp_extract("file", name, 2).cast("bigint").alias("index"), "file")
    if prefix is not None:
        chosen = df.where(F.col("prefix") == prefix)
        if chosen.limit(1).count() == 0:
            raise FileNotFoundError(f"no numbered snapshots with prefix {prefix!r}")
        return chosen
    size = df.groupBy("directory", "prefix").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("directory").agg(F.min_by("prefix", F.struct(-F.col("n"), F.col("prefix"))).alias("prefix"))
    return df.join(best, ["directory", "prefix"])


def trajectory_files(files: DataFrame, patterns: Sequence[str] = (r".*\.arc(\.gz)?$", r".*\.xyz(\.gz)?$"),
                     prefix: str | None = None) -> DataFrame:
    """Sources of each directory: its numbered series, else files that match a pattern, in pattern
    order and each file once. directory, rank, file."""
    series = numbered_series(files, prefix).select("directory", F.col("index").alias("rank"), "file")
    hit = F.lit(None).cast("long")
    for k, p in reversed(list(enumerate(patterns))):
        hit = F.when(F.regexp_extract("file", r"([^/]+)$", 1).rlike(f"^{p}"), F.lit(k).cast("long")).otherwise(hit)
    other = files.select(F.regexp_replace("file", r"/[^/]+$", "").alias("directory"), hit.alias("_k"), "file")
    other = other.where(F.col("_k").isNotNull()).join(series.select("directory").distinct(), "directory", "left_anti")
    # Files are dealt by range, so that a directory of any size is ranked by many tasks: place in the part, and files in earlier parts.
    order = ["_k", "file"]
    dealt = stage(other.repartitionByRange("directory", *order).withColumn("_part", F.spark_partition_id()), "ranked")
    ranked = running(dealt, ["directory"], "_part", order, {"rank": F.lit(1).cast("long")})
    return series.unionByName(ranked.select("directory", "rank", "file"))


def preferred_file(files: DataFrame, root: str, suffix: str) -> DataFrame:
    """The reference file to use: one directly in ``root`` before run directories, then by name."""
    hits = files.where(F.col("file").endswith(suffix))
    inside = F.regexp_replace("file", r"/[^/]+$", "").endswith(root.rstrip("/"))
    return hits.agg(F.min_by("file", F.struct(~inside, F.col("file"))).alias("file"))
