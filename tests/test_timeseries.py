import random
import re

import pytest
from pyspark.sql import functions as F

from mdframes.functions import scalars as X
from mdframes.functions import sites as T
from mdframes.operators import timeseries as TS


def side(spark, rows, name):
    return spark.createDataFrame([("s", 1, float(t), float(v)) for t, v in rows], f"series string, run_index int, time_ps double, {name} double")


@pytest.mark.parametrize("tolerance,width", [(None, 1e4), (3.0, 7.0), (None, 5.0)])
def test_asof_equals_brute_force(spark, tolerance, width):
    rng = random.Random(9)
    left = [(rng.randrange(0, 100), k) for k in range(60)]
    right = [(t, 100 + t) for t in rng.sample(range(0, 100), 25)]
    out = TS.asof_nearest(side(spark, left, "l"), side(spark, right, "r"), tolerance=tolerance, width=width)
    for r in out.collect():
        gap, t = min((abs(rt - r["time_ps"]), rt) for rt, _ in right)
        want = None if tolerance is not None and gap > tolerance else 100.0 + t
        assert r["r"] == want
    assert out.count() == 60


def test_asof_deals_rows_to_bounded_tasks(spark, monkeypatch):
    """No task sorts more than a few buckets, however many rows there are for the session's number of partitions."""
    monkeypatch.setattr(TS, "ROWS_PER_TASK", 400, raising=False)
    left, right = (spark.range(10_000).selectExpr("'s' AS series", "1 AS run_index", f"id + {d} AS time_ps", f"id AS {n}") for d, n in ((0.0, "l"), (0.25, "r")))
    out = TS.asof_nearest(left, right, width=50.0).withColumn("task", F.spark_partition_id())
    tasks = [r["count"] for r in out.groupBy("task").count().collect()]
    assert sum(tasks) == 10_000 and len(tasks) > 30 and max(tasks) < 800
    assert out.where("r <> l").count() == 0


def test_asof_tie_takes_the_earlier_row(spark):
    out = TS.asof_nearest(side(spark, [(10, 0)], "l"), side(spark, [(5, 1), (15, 2)], "r"), tolerance=5.0)
    assert out.first()["time_ps_log"] == 5.0


def test_stitch(spark):
    rows = [("s", 1, float(t)) for t in range(0, 50, 10)] + [("s", 2, float(t)) for t in (0, 10, 20)] + [("s", 3, 500.0)]
    out = TS.stitch(spark.createDataFrame(rows, "series string, run_index int, time_ps double"))
    assert [r["time_ps"] for r in out.where("run_index = 2").orderBy("time_ps").collect()] == [50.0, 60.0, 70.0]
    assert out.where("run_index = 3").first()["time_offset_ps"] == 0.0


def test_cumulative_mean_over_buckets(spark):
    vals = [1.0, None, 4.0, 7.0, None, 0.0]
    df = spark.createDataFrame([("s", float(k), v) for k, v in enumerate(vals)], "series string, time_ps double, a_A double")
    out = TS.cumulative_means(df, ["series"], ["time_ps"], ["a_A"], width=2.0).orderBy("time_ps").collect()
    assert [r["a_A_cumavg"] for r in out] == [1.0, 1.0, 2.5, 4.0, 4.0, 3.0]


def test_missing_mass_is_an_error(spark):
    atoms = spark.createDataFrame([("t", 1), ("t", 1), ("t", 9)], "traj string, atom_type int")
    masses = spark.createDataFrame([(1, 2.5)], "atom_type int, mass double")
    with pytest.raises(Exception, match="without a mass: 9"):
        TS.system_mass(atoms, masses).collect()
    r = TS.system_mass(atoms, masses, skip_missing=True).first()
    assert r["system_mass_g_mol"] == 5.0 and r["missing_types"] == [9]


def test_scalars(spark):
    r = spark.range(1).select(
        X.concentration_mol_dm3(F.lit(-1), F.lit(10.0)).alias("neg"), X.concentration_mol_dm3(F.lit(1), F.lit(0.0)).alias("flat"),
        X.density_g_cm3(F.lit(18.0), F.lit(0.0)).alias("none"), X.density_g_cm3(F.lit(18.015), F.lit(29.9)).alias("water")).first()
    assert r["neg"] is None and r["flat"] is None and r["none"] is None and r["water"] == pytest.approx(1.0, abs=0.01)


def test_site_rules(spark):
    names = ["LI1", "wc", "c", "CL2", "12", "O"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.site_token(F.col("n"))).collect()] == ["Li", "WC", "C", "Cl", "", "O"]
    assert [r[0] for r in df.select(T.infer_element(F.col("n"), F.lit(""))).collect()] == ["Li", "C", "C", "Cl", "C", "O"]
    nums = spark.range(1).select(T.numbers(F.lit("a -1.5D+02, .5 and 7")).alias("v")).first()["v"]
    assert nums == [-150.0, 0.5, 7.0]
    t = spark.createDataFrame([("x/T400K/run.pdb",), ("a_nvt300K_9.pdb",), ("temp_310_K.pdb",), ("none.pdb",)], "p string")
    assert [r[0] for r in t.select(T.temperature_from_name(F.col("p"))).collect()] == [400.0, 300.0, 310.0, None]
    with pytest.raises(Exception, match="no temperature"):
        t.select(T.resolve_temperature(F.col("p"))["temperature_K"]).collect()


def plain_offsets(runs):
    last, out = None, []
    for lo, hi, dt in runs:
        off = last + dt - lo if last is not None and lo <= last + 1e-9 else 0.0
        out.append(off)
        last = hi + off
    return out


@pytest.mark.parametrize("bucket", [1, 3, 1024])
def test_stitch_over_buckets(spark, bucket):
    """Runs that continue, start anew, leave gaps or lie behind, cut into buckets anywhere."""
    rng = random.Random(5)
    rows, want = [], {}
    for s in "ab":
        clock, runs = 0.0, []
        for k in range(60):
            step, n = rng.choice([1.0, 2.5, 10.0]), rng.randint(2, 5)
            lo = rng.choice([0.0, step, clock + rng.choice([-step / 2, 0.0, 1e-10, step, 50.0])])
            times = [lo + step * i for i in range(n)]
            runs.append((times[0], times[-1], step))
            rows += [(s, k, t) for t in times]
            clock += step * n if rng.random() < 0.7 else 0.0
        want.update({(s, k): off for k, off in enumerate(plain_offsets(runs))})
    df = spark.createDataFrame(rows, "series string, run_index int, time_ps double")
    got = {(r["series"], r["run_index"]): r["time_offset_ps"] for r in TS.stitch(df, bucket=bucket).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_stitch_of_fifty_thousand_runs(spark):
    """Each run starts at 0 again; the offsets grow by its length and one step."""
    df = spark.range(100_000).selectExpr("'s' AS series", "int(id div 2) AS run_index", "double(id % 2) AS time_ps")
    out = TS.stitch(df)
    assert out.where("time_offset_ps <> 2.0 * run_index").count() == 0 and out.count() == 100_000
    assert out.agg(F.max("time_ps")).first()[0] == 99_999.0


def test_words_of_a_line_are_found_in_one_pass(spark):
    """The first and the last whole number of size 2 or more among the words of a line, whatever else stands there, without
    a pattern tried on each word."""
    rng = random.Random(3)
    parts = ["7", "-12", "+3.00", "1", "0", "-1.0", "2.5", "4.", ".0", "99999999999", "N", "8x", "x8", "9.0e1", "5-6", "\t", "\u20097", "+", "--4", "007", "2147483647"]
    lines = ["", "   ", " 7", "7 ", None, *("".join(rng.choice([" ", "  ", "\t"]) + rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(400))]

    def words(line):
        found = [re.fullmatch(r"([+-]?[0-9]+)(?:\.0+)?", w) for w in re.split(r"[ \t\n\x0b\f\r]+", line or "")]
        return [int(m[1]) for m in found if m and 2 <= abs(int(m[1])) < 2 ** 31]

    df = spark.createDataFrame([(k, x, None if x is None else " " * 66 + x) for k, x in enumerate(lines)], "k int, line string, far string")
    got = df.select("k", T.atom_type(F.col("line"), "last_int").alias("last"), T.atom_type(F.col("far"), "tail").alias("first"))
    for r in got.collect():
        w = words(lines[r["k"]]) or [None]
        assert (r["first"], r["last"]) == (w[0], w[-1]), lines[r["k"]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_extract(" not in plan
