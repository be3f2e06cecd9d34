"""Intermediate results on shared storage.

A flow reuses expensive intermediate tables several times. They are written once to the cluster's
shared folder and read back, which cuts the lineage, keeps plans short, survives lost executors and
gives later steps columnar scans with sizes.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. A local master without that setting gets a folder
    of its own, which goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="mdframes-work-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``base_folder``."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and give the written table."""
    spark = df.sparkSession
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def once_per_app(fn: Callable) -> Callable:
    """Keep what ``fn(spark, sf_dir)`` returns for the rest of the application."""
    held: dict[tuple[str, str], object] = {}

    @functools.wraps(fn)
    def once(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in held:
            held[key] = fn(spark, sf_dir)
        return held[key]
    return once


def staged(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Stage what ``fn(spark, sf_dir)`` computes, once per application and directory."""
    return once_per_app(functools.wraps(fn)(lambda spark, sf_dir: stage(fn(spark, sf_dir), fn.__name__.strip("_"))))
