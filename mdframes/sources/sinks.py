"""Result tables: partitioned files, wide tables, commented CSV, fixed-format text, reuse."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def write_series(df: DataFrame, path: str, by: Sequence[str] = ("series",), fmt: str = "parquet") -> None:
    """One folder per series below one table; only the series present are replaced.

    Rows are counted, then dealt by series, a large table's series to several tasks each, so that not every task writes a file for
    every series. A costly table is best staged before.
    """
    parts, others = 1 + df.count() // ROWS_PER_FILE, [c for c in df.columns if c not in by]
    part = F.pmod(F.xxhash64(*others), F.lit(parts)) if others else F.lit(0)
    writer = df.repartition(*by, part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def wide(df: DataFrame, index: Sequence[str], names: Sequence[str], label: str = "label", value: str = "value") -> DataFrame:
    """One column per curve on the union of the index points (missing points are NULL)."""
    return df.groupBy(*index).pivot(label, list(names)).agg(F.first(value, ignorenulls=True))


def write_csv(df: DataFrame, path: str, metadata: Mapping[str, object], order: Sequence[str]) -> None:
    """A CSV table in as many sorted files as it has range partitions, each with the header line, and
    ``# key: value`` lines in ``_about``, which readers of the table skip."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
    lines = df.sparkSession.createDataFrame([(f"# {k}: {v}",) for k, v in metadata.items()], "line string")
    write_text(lines, path + "/_about")


def write_text(lines: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Text lines, one folder per ``by``."""
    writer = lines.select(*by, "line").write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def fixed_text(df: DataFrame, columns: Sequence[str], fmt: str = "%.6f", keep: Sequence[str] = ()) -> DataFrame:
    """``r g [cn]`` style lines with one fixed number format, beside the ``keep`` columns."""
    return df.select(*keep, F.format_string(" ".join([fmt] * len(columns)), *[F.col(c) for c in columns]).alias("line"))


def key_values(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``key = value`` lines of every row, one per column but the ``keep`` ones, which stay columns, and
    ``part``, the line's place."""
    shown = [c for c in df.columns if c not in keep]
    entries = F.array(*[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in shown])
    return df.select(*keep, F.posexplode(entries).alias("part", "line"))


def exists(spark: SparkSession, path: str, columns: Sequence[str] = (), fmt: str = "parquet") -> bool:
    """Whether a finished result with the needed columns is there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        return False
    have = set(spark.read.format(fmt).load(path).columns)
    return set(columns) <= have


def _state(inputs: DataFrame | None, parameters: Mapping[str, object] | None) -> str:
    """A hash of the parameters, and the number and hash of the inputs' rows."""
    mark = hashlib.sha256(json.dumps(parameters or {}, sort_keys=True, default=str).encode()).hexdigest()
    if inputs is None:
        return mark
    columns = sorted(inputs.columns)
    row = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]).cast("decimal(38,0)")
    n, rows = inputs.agg(F.count(F.lit(1)), F.sum(row)).first()
    return f"{mark} {n} {rows}"


def reuse(spark: SparkSession, path: str, compute: Callable[[], DataFrame], columns: Sequence[str] = (),
          force: bool = False, inputs: DataFrame | None = None, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """Read a finished result, or compute and write it first. A result that lacks one of
    ``columns`` is computed again, and one that was made from other ``inputs`` (a table of files with their lengths and times, say) or
    ``parameters``. What it was made from is written after the result, so a broken write counts for nothing."""
    told = inputs is not None or parameters is not None
    state, about = _state(inputs, parameters) if told else "", path + "/_made_from"
    same = not told or (exists(spark, about, fmt="text") and state == (spark.read.text(about).agg(F.max("value")).first()[0]))
    if force or not same or not exists(spark, path, columns):
        compute().write.mode("overwrite").parquet(path)
        if told:
            write_text(spark.createDataFrame([(state,)], "line string"), about)
    return spark.read.parquet(path)
