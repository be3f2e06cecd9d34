"""Flows that take up where they stopped: which inputs are done, with which parameters, in a table beside the results.

A manifest row says that an input of this path, length and time, with this hash of the parameters, is in the results. It is
written after the results of its step, so what a broken step left behind is computed again and replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.plans.outputs import save
from mdframes.sources.sinks import exists
from mdframes.sources.text import stem

INPUT = ["file", "length", "modified"]
SCHEMA = "file string, length bigint, modified timestamp, traj string, parameters string, step bigint"


def inputs(spark: SparkSession, paths: str | Sequence[str], glob: str = "*", traj: Column | None = None) -> DataFrame:
    """file, length, modified and traj (the partition of the results) of every input; contents are not read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
          .load(paths if isinstance(paths, str) else list(paths)))
    df = df.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified")).dropDuplicates(["file"])
    return df.withColumn("traj", stem() if traj is None else traj)


def parameter_hash(parameters: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def done(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a result folder; empty where there is none."""
    path = f"{folder}/_manifest"
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def pending(spark: SparkSession, folder: str, files: DataFrame, parameters: Mapping[str, object]) -> DataFrame:
    """Inputs whose present state is not in the results with these parameters."""
    known = latest(spark, folder).where(F.col("parameters") == parameter_hash(parameters)).select(*INPUT)
    return files.join(known, INPUT, "left_anti")


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last manifest row of each input, which is what the results hold of it."""
    rows = done(spark, folder)
    last = rows.groupBy("file").agg(F.max("step").alias("step"))
    return rows.join(last, ["file", "step"], "left_semi")


def resume(spark: SparkSession, folder: str, files: DataFrame, parameters: Mapping[str, object],
           compute: Callable[[list[str]], Mapping[str, DataFrame | None]], per_step: int = 64, force: bool = False) -> int:
    """Compute the pending inputs, some at a time, and give the number of inputs computed.

    ``compute(paths)`` returns result tables with a ``traj`` column as ``files`` has it; an input is the only one of its trajectory. Each step
    replaces the partitions it computes, then enters its inputs. The driver holds the paths of one step.
    """
    mark, count = parameter_hash(parameters), 0
    step = (done(spark, folder).agg(F.max("step")).first()[0] or 0) + 1
    todo = files if force else pending(spark, folder, files, parameters)
    after = ""
    while True:
        rows = todo.where(F.col("file") > after).orderBy("file").limit(per_step).collect()
        if not rows:
            return count
        save(compute([r["file"] for r in rows]), folder)
        entered = spark.createDataFrame([(*[r[c] for c in INPUT], r["traj"], mark, step) for r in rows], SCHEMA)
        entered.coalesce(1).write.mode("append").parquet(f"{folder}/_manifest")
        after, step, count = rows[-1]["file"], step + 1, count + len(rows)


def current(spark: SparkSession, folder: str, table: DataFrame, files: DataFrame, parameters: Mapping[str, object]) -> DataFrame:
    """Rows of a result table that belong to the present inputs and parameters: nothing stale, nothing of files that are gone."""
    mine = latest(spark, folder).where(F.col("parameters") == parameter_hash(parameters)).join(files.select(*INPUT), INPUT, "left_semi")
    return table.join(mine.select("traj"), "traj", "left_semi")
