"""What the operators share: tables on shared storage, runs of a sorted partition, linked groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder, which only a
    local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def staged(df: DataFrame) -> DataFrame:
    """Write a table to shared storage and read it back: cuts the lineage, so that a lost executor
    costs at most the tasks of the running stage."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def settled(df: DataFrame) -> DataFrame:
    """``staged``, compressed tightly, and the shuffle files of the job are deleted once its table is written."""
    spark = df.sparkSession
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    spark.conf.set(name, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc(column: Column | str) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit("")).cast("binary"))


def doc_crc(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text, by which labelled rows are held out."""
    return crc(F.col(doc_id).cast("string"))


def table(schema: str, columns: dict) -> pa.RecordBatch:
    """An Arrow batch of named numpy arrays or lists; ``schema`` is a DDL string of simple types."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
             "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
             "array<float>": pa.list_(pa.float32())}
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``flat``, one after the other, and where each of them ends."""
    sizes = size[at]
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0], ends
    places = np.arange(ends[-1])
    places += np.repeat(start[at] - (ends - sizes), sizes)
    return flat[places], ends


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal ``keys`` (integers) of a sorted partition, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(batch.schema.get_field_index(x)).to_numpy() for x in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(k[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For every node 0..n-1 the smallest node that links a[i]-b[i] connect it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        if np.array_equal(before, label) and not open_.any():
            break
        a, b = a[open_], b[open_]
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars around the smallest node."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[forest(at[:len(a)], at[len(a):], len(nodes))]
        far = root != nodes
        yield table("a long, b long", {"a": nodes[far], "b": root[far]})


def _all_stars(links: DataFrame) -> bool:
    """Whether different links, each from a larger to a smaller node, are stars that touch nowhere."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(links.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").count() == 0


def connected(links: DataFrame) -> DataFrame:
    """Groups of linked nodes: (node, root), root being the smallest node of the group; nodes without
    links are absent. ``links`` has two long columns.

    Links are first contracted within each partition; then large and small stars alternate until
    each group is one star, logarithmically many rounds. Minima are taken with partial aggregation, so a hub
    costs no hot task; every round is a written table.
    """
    links = links.toDF("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct()
    links = staged(links)
    while not _all_stars(links):
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m")
                 .select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionAll(low))
        links = staged(small.distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
