import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdframes.operators import dynamics as D
from mdframes.operators import transport as TR

POS = "traj string, frame bigint, atom_id bigint, x double, y double, z double"


def walk(spark, atoms=4, frames=50, gap=False):
    rng = random.Random(5)
    rows = []
    for a in range(atoms):
        p = [rng.randrange(-64, 64) / 64 for _ in range(3)]
        for f in range(frames):
            p = [v + rng.randrange(-64, 65) / 64 for v in p]
            if not (gap and f % 7 == a):
                rows.append(("t", f, a, *p))
    return spark.createDataFrame(rows, POS), rows


def test_unwrap_across_a_wall(spark):
    df = spark.createDataFrame([("t", f, 1, x, 0.0, 0.0) for f, x in enumerate((19.5, 0.5, 1.5))], POS)
    out = D.unwrap(df.withColumns({c: F.lit(20.0) for c in "abc"})).orderBy("frame").collect()
    assert [r["x"] for r in out] == [19.5, 20.5, 21.5]


def test_unwrap_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(D, "FRAMES_PER_BUCKET", 6)
    df, rows = walk(spark)
    wrapped = df.withColumns({c: F.pmod(F.col(c), F.lit(5.0)) for c in "xyz"}).withColumns({c: F.lit(5.0) for c in "abc"})
    got = {(r["frame"], r["atom_id"]): r["x"] for r in D.unwrap(wrapped).collect()}
    for _, f, a, x, _, _ in rows:
        first = next(r[3] for r in rows if r[2] == a and r[1] == 0)
        assert got[(f, a)] == x - first + first % 5.0


def test_unwrap_without_cell_passes_through(spark):
    df, rows = walk(spark, 2, 5)
    out = D.unwrap(df.withColumns({"a": F.lit(5.0), "b": F.lit(None).cast("double"), "c": F.lit(5.0)}))
    assert {(r["frame"], r["atom_id"], r["x"]) for r in out.collect()} == {(r[1], r[2], r[3]) for r in rows}


@pytest.mark.parametrize("lag,tile,gap,direct", [(30, 64, False, 128), (30, 8, True, 128), (49, 5, False, 128), (49, 64, True, 2)])
def test_lag_kernel_equals_self_join(spark, monkeypatch, lag, tile, gap, direct):
    monkeypatch.setattr(D, "DIRECT_LAGS", direct)
    df, _ = walk(spark, gap=gap)
    a = {r["lag"]: (r["total"], r["n"]) for r in D.lag_products(df, ["traj"], "atom_id", lag, tile=tile).collect()}
    b = {r["lag"]: (r["total"], r["n"]) for r in D.lag_join(df, ["traj"], "atom_id", lag).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][1] == b[k][1] and a[k][0] == pytest.approx(b[k][0], rel=1e-9, abs=1e-6)


def test_cross_is_polarisation(spark):
    df, _ = walk(spark, 2)
    a, b = (df.where(f"atom_id = {k}").drop("atom_id") for k in (0, 1))
    both = a.join(b.withColumnsRenamed({c: f"b{c}" for c in "xyz"}), ["traj", "frame"]).withColumn("s", F.lit(0))
    cross = {r["lag"]: r["total"] for r in D.lag_products(both, ["traj"], "s", 20, cross=True).collect()}
    total = both.select("traj", "frame", "s", *[(F.col(c) + F.col(f"b{c}")).alias(c) for c in "xyz"])
    m = lambda d: {r["lag"]: r["total"] for r in D.lag_products(d.withColumn("s", F.lit(0)), ["traj"], "s", 20).collect()}
    t, x, y = m(total), m(a), m(b)
    for k in cross:
        assert cross[k] == pytest.approx(0.5 * (t[k] - x[k] - y[k]))


def test_decomposition_adds_up(spark):
    df, _ = walk(spark, 6)
    p = df.select("traj", "frame", F.when(F.col("atom_id") % 2 == 0, "P").otherwise("M").alias("label"),
                  F.col("atom_id").alias("particle_id"), "x", "y", "z")
    species = [("P", 1.0), ("M", -1.0)]
    c = TR.onsager_curves(TR.term_sums(p, species, 20), species, 0.1)
    rows = c.groupBy("lag").agg(
        F.sum(F.when(F.col("kind") != "total", F.col("za") * F.col("zb") * F.col("mult") * F.col("value"))).alias("s"),
        F.sum(F.when(F.col("kind") == "total", F.col("value"))).alias("t")).collect()
    assert rows and all(r["s"] == pytest.approx(r["t"], abs=1e-9) for r in rows)


def test_random_walk_is_diffusive(spark):
    rng = np.random.default_rng(0)
    steps = rng.normal(size=(40, 200, 3)).cumsum(axis=1)
    rows = [("t", f, a, *map(float, steps[a, f])) for a in range(40) for f in range(200)]
    curve = D.msd(spark.createDataFrame(rows, POS), ["traj"], "atom_id", 40, 1.0)
    r = TR.fit_diffusion(curve, ["traj"]).first()
    assert r["loglog_alpha"] == pytest.approx(1.0, abs=0.1) and r["D_A2_per_ns"] == pytest.approx(0.5, rel=0.15)


def test_short_fit_window_is_an_error(spark):
    df, _ = walk(spark, 2, 20)
    with pytest.raises(Exception, match="too few points"):
        TR.fit_diffusion(D.msd(df, ["traj"], "atom_id", 10, 1.0), ["traj"], 1.0, 2.0).collect()


def test_block_error_and_transference(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3)], "k string, v double")
    r = {m: TR.block_error(df, ["k"], "v", 3, m).first() for m in ("sd", "sem", "ci95")}
    assert r["sem"]["mean"] == 2 and r["sd"]["err"] == 1
    assert r["sem"]["err"] == pytest.approx(0.5773503) and r["ci95"]["err"] == pytest.approx(1.1316065)
    from mdframes.functions import scalars as X
    t = X.transference(*[F.lit(v) for v in (1.0, 3.0, 2.0, 3.0, 0.5)])
    row = spark.range(1).select(*[c.alias(k) for k, c in t.items()]).first()
    assert (row["PFG_t_app"], row["eNMR_t0"]) == (0.25, 0.375)
    assert row["Bruce_Vincent_tss"] == pytest.approx(0.479167, abs=1e-6)
    zero = X.transference(*[F.lit(0.0)] * 5)
    assert all(v is None for k, v in spark.range(1).select(*[c.alias(k) for k, c in zero.items()]).first().asDict().items()
               if k != "sigma_reduced")


@pytest.mark.parametrize("bucket", [1, 5, 64, 4096])
def test_expanding_slope_keeps_its_digits(spark, bucket):
    """Against centred sums of each prefix, at an offset of a million, with gaps and points before the start."""
    rng = np.random.default_rng(8)
    n = 300
    t = 0.2 * np.arange(n)
    y = {"v": 1e6 + 3.0 * t + rng.normal(0, 0.01, n), "w": 1e6 - t ** 2}
    rows = [("a", k, float(t[k]), float(y["v"][k]) if k % 7 else None, float(y["w"][k])) for k in range(n)]
    df = spark.createDataFrame(rows, "traj string, lag bigint, time double, v double, w double")
    out = TR.expanding_slope(df, ["traj"], 5.0, {"sv": "v", "sw": "w"}, 8, bucket=bucket).orderBy("lag").collect()
    assert set(out[0].asDict()) == {"traj", "lag", "time", "v", "w", "sv", "sw"}
    for name, value in (("sv", "v"), ("sw", "w")):
        use = np.array([r[value] is not None and r["time"] >= 5.0 for r in out])
        for k in range(0, n, 3):
            at = np.flatnonzero(use[:k + 1])
            if len(at) < 8 or not use[k]:
                assert out[k][name] is None
                continue
            a, b = t[at] - t[at].mean(), y[value][at] - y[value][at].mean()
            assert out[k][name] == pytest.approx((a * b).sum() / (a * a).sum(), rel=1e-7)


def test_expanding_slope_has_no_window_over_a_curve(spark):
    df = spark.range(20_000).selectExpr("'a' AS traj", "id AS lag", "double(id) AS time", "2.0 * id AS value")
    out = TR.expanding_slope(df, ["traj"], 1.0, {"slope": "value"}, bucket=512)
    assert out.where("slope IS NOT NULL AND abs(slope - 2.0) > 1e-9").count() == 0 and out.where("slope IS NULL").count() == 8
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_b" in x for x in plan.splitlines() if "Window" in x)


@pytest.mark.parametrize("lag", [0, 1, 6, 200])
def test_lag_join_shuffles_rows_and_not_lags(spark, lag):
    """Negative frames, gaps, repeated and null frames; no row is multiplied by the lags before the shuffle."""
    frames = [-9, -8, -3, 0, 1, 1, 2, 6, 7, 13, None]
    df = spark.createDataFrame([(t, f, a, float(k * k), float(a), 0.5) for t in ("s", "t") for a in (1, 2) for k, f in enumerate(frames)], POS)
    got = D.lag_join(df, ["traj"], "atom_id", lag)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for t in ("s", "t"):
        for k, f in enumerate(frames):
            for m, g in enumerate(frames):
                if f is not None and g is not None and 0 <= g - f <= lag:
                    total, n = want.get((t, g - f), (0.0, 0))
                    want[t, g - f] = total + 2 * (m * m - k * k) ** 2, n + 2
    assert {(r["traj"], r["lag"]): (r["total"], r["n"]) for r in got.collect()} == want


def test_tile_sums_keep_series_apart():
    """One call gives the sums of every series, so series of many keys are worked on together."""
    import numpy as np
    rng = np.random.default_rng(3)
    rows = np.repeat(np.arange(5), 7)
    frames = np.tile(np.arange(7), 5)
    keep = rng.random(35) < 0.8
    rows, frames, a = rows[keep], frames[keep], rng.random((int(keep.sum()), 3))
    total, n = D._tile_sums(0, 5, rows, frames, a, None, 8, 0, 4)
    assert total.shape == n.shape == (5, 4)
    for s in range(5):
        at = {f: v for f, v in zip(frames[rows == s], a[rows == s])}
        for lag in range(4):
            steps = [float(((at[f + lag] - at[f]) ** 2).sum()) for f in at if f + lag in at]
            assert n[s, lag] == len(steps) and abs(total[s, lag] - sum(steps)) < 1e-9
