"""Ordered scans that never put one key's whole history into one task.

A plain window over ``key ORDER BY t`` sends every row of a hot key to a single task.
Here the order axis is first cut into buckets (days, frame ranges, file blocks). Each bucket
is reduced with an ordinary grouped aggregate, which combines map-side; the small table of
bucket summaries is scanned with a window, and every row gets what happened before (or after)
its bucket. Row-level windows then run per ``(key, bucket)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def tasks_for(rows: int, per_task: int, spark: SparkSession) -> int:
    """How many tasks some rows are dealt to: the session's number of partitions, or more if a task would sort too many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def _order_key(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def with_carry(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
               sums: Mapping[str, Column] | None = None,
               lasts: Mapping[str, Column] | None = None,
               nexts: Mapping[str, Column] | None = None,
               later_sums: Mapping[str, Column] | None = None,
               products: Mapping[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """Add, per row, summaries of the other buckets of its key.

    ``sums``: total over earlier buckets (0 for the first). ``lasts``: latest non-null value in
    earlier buckets. ``nexts``: earliest non-null value in later buckets. ``later_sums``: total over
    later buckets. ``products``: product over earlier buckets (1 for the first). The buckets are dealt to ``tasks``
    tasks, if given, so that windows over them sort a bounded number of rows.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    later_sums, products = later_sums or {}, products or {}
    key = _order_key(order)
    aggs = [F.sum(e).alias(n) for n, e in {**sums, **later_sums}.items()]
    aggs += [F.product(e).alias(n) for n, e in products.items()]
    aggs += [F.max_by(e, F.when(e.isNotNull(), key)).alias(n) for n, e in lasts.items()]
    aggs += [F.min_by(e, F.when(e.isNotNull(), key)).alias(n) for n, e in nexts.items()]
    summary = df.groupBy(*keys, bucket).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is looking back in descending order, which costs one pass instead of n^2.
    after = Window.partitionBy(*keys).orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys, bucket,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.last(n, ignorenulls=True).over(before).alias(n) for n in lasts],
        *[F.last(n, ignorenulls=True).over(after).alias(n) for n in nexts],
        *[F.coalesce(F.sum(n).over(after), F.lit(0)).alias(n) for n in later_sums],
        *[F.coalesce(F.product(n).over(before), F.lit(1.0)).alias(n) for n in products],
    )
    rows = df if tasks is None else df.repartition(tasks, *keys, bucket)
    return rows.join(summary, [*keys, bucket])


def running(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
            sums: Mapping[str, Column], tasks: int | None = None) -> DataFrame:
    """Inclusive running sums over ``order`` within ``keys``."""
    w = (Window.partitionBy(*keys, bucket).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = with_carry(df, keys, bucket, order, sums={f"_before_{n}": e for n, e in sums.items()}, tasks=tasks)
    out = out.withColumns({n: F.col(f"_before_{n}") + F.coalesce(F.sum(e).over(w), F.lit(0))
                           for n, e in sums.items()})
    return out.drop(*[f"_before_{n}" for n in sums])


def remaining(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
              sums: Mapping[str, Column]) -> DataFrame:
    """Sums over the rows strictly after each row within ``keys``, across buckets."""
    w = (Window.partitionBy(*keys, bucket).orderBy(*[F.desc(c) for c in order])
         .rowsBetween(Window.unboundedPreceding, -1))
    out = with_carry(df, keys, bucket, order, later_sums={f"_after_{n}": e for n, e in sums.items()})
    out = out.withColumns({n: F.col(f"_after_{n}") + F.coalesce(F.sum(e).over(w), F.lit(0))
                           for n, e in sums.items()})
    return out.drop(*[f"_after_{n}" for n in sums])


def running_product(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], name: str,
                    factor: Column) -> DataFrame:
    """Inclusive running product over ``order`` within ``keys``, as column ``name``."""
    w = (Window.partitionBy(*keys, bucket).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = with_carry(df, keys, bucket, order, products={"_before": factor})
    return out.withColumn(name, F.col("_before") * F.product(factor).over(w)).drop("_before")


def _handed(tables: Iterator[pa.RecordBatch], keys: int, step: Callable, start: object) -> Iterator[pa.RecordBatch]:
    """One state per key, handed from row to row of a sorted partition."""
    key, state = None, start
    for batch in tables:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            here = tuple(list(r.values())[:keys])
            if here != key:
                key, state = here, start
            kept, state = step(r, state)
            if kept is not None:
                out.append({**dict(zip(batch.schema.names[:keys], here)), **kept})
        yield out


def fold(summary: DataFrame, keys: Sequence[str], order: Sequence[str], start: object,
         step: Callable[[dict, object], tuple[dict | None, object]], added: str) -> DataFrame:
    """Hand a state along the rows of each key in ``order`` and keep what ``step(row, state)`` gives.

    For bucket summaries whose composition is no sum: rows are streamed, so a key's buckets may be many.
    ``added`` names the columns that ``step`` returns, as DDL.
    """
    schema = ", ".join([*[f"{k} {summary.schema[k].dataType.simpleString()}" for k in keys], added])
    n, arrow = len(keys), to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _handed(batches, n, step, start):
            yield pa.RecordBatch.from_pylist(out, arrow)

    others = [c for c in summary.columns if c not in keys]
    return (summary.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInArrow(run, schema))


def previous(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
             values: Mapping[str, Column]) -> DataFrame:
    """Latest non-null value strictly before each row, across buckets."""
    w = (Window.partitionBy(*keys, bucket).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    out = with_carry(df, keys, bucket, order, lasts={f"_carry_{n}": e for n, e in values.items()})
    out = out.withColumns({n: F.coalesce(F.last(e, ignorenulls=True).over(w), F.col(f"_carry_{n}"))
                           for n, e in values.items()})
    return out.drop(*[f"_carry_{n}" for n in values])
