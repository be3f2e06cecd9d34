"""Canonical trajectory views over the star-schema tables.

``events`` becomes particle motion: every user is a particle, every event one step of a walk in a
20 A periodic box, and 100 users form one trajectory. Steps are multiples of 1/64 A, so
coordinates, squared distances and their sums are exact in binary floating point. A particle whose
events end early rests at its last position, which makes every trajectory rectangular and keeps
all events. ``orders`` becomes run logs, snapshots and a bond graph (a customer's orders form one
chain molecule).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.functions.scalars import dt_ns
from mdframes.operators.scan import previous, running

BOX = 20.0
GRID = 64.0
BOX_UNITS = 1280
ATOMS_PER_TRAJ = 100
DT_NS = dt_ns(dt_ps=200.0)

# One entry per particle kind (user_id modulo 5).
SITES = [
    # name, mass, resname, chain, atom_type, charge
    ("Li", 6.94, "LI", "L", 6, 1.0),
    ("N", 14.007, "FSA", "A", 72, -1.0),
    ("O", 15.999, "FSA", "A", 81, -1.0),
    ("S", 32.06, "FSA", "A", 164, -1.0),
    ("H", 1.008, "SOL", "S", 71, 0.0),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(index: int) -> F.Column:
    values = F.array(*[F.lit(s[index]) for s in SITES])
    return values[(F.col("atom_id") % 5).cast("int")]


def _traj(atom: str):
    return F.concat(F.lit("sys"), F.floor(F.col(atom) / ATOMS_PER_TRAJ).cast("string"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, atom_id, name, element, resname, chain, resid, icode, atom_type, mass, charge."""
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("atom_id")).distinct()
    return users.select(
        _traj("atom_id").alias("traj"), "atom_id",
        _pick(0).alias("name"), _pick(0).alias("element"), _pick(2).alias("resname"),
        _pick(3).alias("chain"), F.floor(F.col("atom_id") / 5).alias("resid"),
        F.lit("").alias("icode"), _pick(4).alias("atom_type"), _pick(1).alias("mass"),
        _pick(5).alias("charge"))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True (unwrapped) paths: traj, frame, atom_id, x, y, z."""
    ev = read(spark, sf_dir, "events").select(
        _traj("user_id").alias("traj"), F.col("user_id").alias("atom_id"), "event_id", "ts",
        F.to_date("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("v"))
    span = 385
    steps = running(ev, ["traj", "atom_id"], "day", ["ts", "event_id"], {
        "n": F.lit(1),
        "sx": F.col("v") % span - 192,
        "sy": (F.col("event_id") * 7919) % span - 192,
        "sz": (F.col("event_id") * 104729 + F.col("v")) % span - 192,
    })
    sizes = ev.groupBy("traj", "atom_id").agg(F.count(F.lit(1)).alias("n_atom"))
    length = sizes.groupBy("traj").agg(F.max("n_atom").alias("n_frames"))
    steps = steps.join(sizes.join(length, "traj"), ["traj", "atom_id"])
    last = F.col("n") == F.col("n_atom")
    until = F.when(last, F.col("n_frames")).otherwise(F.col("n")) - 1
    a = F.col("atom_id")
    return steps.select(
        "traj", F.explode(F.sequence(F.col("n") - 1, until)).alias("frame"), "atom_id",
        (((a * 811) % BOX_UNITS + F.col("sx")) / GRID).alias("x"),
        (((a * 1319) % BOX_UNITS + F.col("sy")) / GRID).alias("y"),
        (((a * 1777) % BOX_UNITS + F.col("sz")) / GRID).alias("z"))


def positions(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """The walks (or ``base``, if they are at hand) wrapped into the box."""
    return (walks(spark, sf_dir) if base is None else base).withColumns(
        {n: F.pmod(F.col(n), F.lit(BOX)) for n in "xyz"})


def in_cubic_box(df: DataFrame) -> DataFrame:
    """Attach the constant 20 A cell as literal columns: no join for a constant box."""
    terms = {"ax": BOX, "bx": 0.0, "by": BOX, "cx": 0.0, "cy": 0.0, "cz": BOX}
    return df.withColumns({n: F.lit(v) for n, v in terms.items()}).withColumn(
        "volume", F.lit(BOX ** 3))


def triclinic_frames(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """A cell per frame of the positions, with lengths and angles that drift: traj, frame, a..gamma."""
    fr = (positions(spark, sf_dir) if base is None else base).groupBy("traj", "frame").agg(F.count(F.lit(1)).alias("n_atoms"))
    f = F.col("frame")
    return fr.select("traj", "frame", (F.lit(20.0) + F.lit(0.05) * (f % 7)).alias("a"),
                     F.lit(20.0).alias("b"), F.lit(20.0).alias("c"),
                     (F.lit(90.0) - (f % 5)).alias("alpha"), F.lit(90.0).alias("beta"),
                     (F.lit(90.0) + (f % 3)).alias("gamma"))


def _stretch() -> F.Column:
    """Buckets along (date, key) that hold at most 65,536 orders each, however many a day has."""
    return F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * F.lit(1 << 40) + F.floor(F.col("o_orderkey") / 65_536)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as MD records: series, run_index and the record number rn within the run."""
    o = read(spark, sf_dir, "orders")
    series = F.concat(F.lit("T"), (F.lit(240) + 30 * F.substring("o_orderpriority", 1, 1).cast("int"))
                      .cast("string"), F.lit("K"))
    o = o.withColumns({"series": series, "run_index": (F.col("o_orderkey") % 3 + 1).cast("int"), "_b": _stretch()})
    return running(o, ["series", "run_index"], "_b", ["o_orderdate", "o_orderkey"], {"rn": F.lit(1)}).drop("_b")


def logs(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Run-log records, one per order: series, run_index, time_ps, energies."""
    return (runs(spark, sf_dir) if base is None else base).select(
        "series", "run_index", (F.col("rn") * 10.0).alias("time_ps"),
        (-F.col("o_totalprice")).alias("potential_kcal_mol"),
        F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice") / 128.0)
        .alias("kinetic_kcal_mol"))


def snapshots(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Snapshot cells, one per order, at times that straddle the log times."""
    a = F.lit(20.0) + (F.col("o_custkey") % 100) / F.lit(1024.0)
    return (runs(spark, sf_dir) if base is None else base).select(
        "series", "run_index", "o_orderkey",
        (F.col("rn") * 10.0 + F.col("o_orderkey") % 11 - 5).alias("time_ps"),
        F.when(F.col("o_orderkey") % 17 != 0, a).alias("a_A"),
        F.lit(20.0).alias("b_A"), F.lit(20.0).alias("c_A"), F.lit(90.0).alias("alpha_deg"),
        F.lit(90.0).alias("beta_deg"), F.lit(90.0).alias("gamma_deg"))


def bonded_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One atom per order, bonded to the customer's previous order.

    traj, atom_id, name, atom_type, bonds (array of bonded ids, one direction only).
    """
    o = read(spark, sf_dir, "orders").withColumn("_b", _stretch())
    o = previous(o, ["o_custkey"], "_b", ["o_orderdate", "o_orderkey"],
                 {"prev": F.col("o_orderkey")})
    kind = F.substring("o_orderpriority", 1, 1).cast("int")
    names = F.array(*[F.lit(s[0]) for s in SITES])
    return o.select(
        F.lit("box").alias("traj"), F.col("o_orderkey").alias("atom_id"),
        names[kind - 1].alias("name"),
        (kind * 10 + (F.col("o_orderkey") % 3).cast("int")).alias("atom_type"),
        F.when(F.col("prev").isNotNull(), F.array("prev"))
        .otherwise(F.array().cast("array<bigint>")).alias("bonds"))
