import math
import random

import pytest
from pyspark.sql import functions as F

from mdframes.operators import contacts as K
from mdframes.operators import relaxation as R

CAND = "traj string, i bigint, mol_id bigint, frame bigint, r2 double"


def machine(dist, r_on, r_off):
    """Frames in contact by a plain state machine."""
    on, out = False, []
    for f, d in enumerate(dist):
        on = d is not None and (d <= r_off if on else d <= r_on)
        if on:
            out.append(f)
    return out


def runs(frames):
    out = []
    for f in frames:
        if out and out[-1][1] == f - 1:
            out[-1][1] = f
        else:
            out.append([f, f])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("bucket", [3, 5, 4096])
def test_activity_equals_state_machine(spark, bucket):
    rng = random.Random(bucket)
    paths = {k: [rng.choice([2.0, 3.2, 3.2, 3.2, 4.0]) for _ in range(40)] for k in range(30)}
    rows = [("t", k, 1, f, d * d) for k, p in paths.items() for f, d in enumerate(p) if d <= 3.6]
    act = K.activity(spark.createDataFrame(rows, CAND), 3.0, bucket)
    got = {}
    for r in act.collect():
        got.setdefault(r["i"], []).append(r["frame"])
    for k, p in paths.items():
        assert sorted(got.get(k, [])) == machine(p, 3.0, 3.6)
    lengths = spark.createDataFrame([("t", 40)], "traj string, n_frames bigint")
    ev = {(r["i"], r["start_frame"], r["end_frame"]) for r in K.events(act, lengths, 1.0, bucket).collect()}
    assert ev == {(k, *r) for k, p in paths.items() for r in runs(machine(p, 3.0, 3.6))}


def events(spark, rows):
    return spark.createDataFrame([("t", *r) for r in rows], "traj string, n_observed_frames bigint, left_censored boolean, right_censored boolean")


def grid(spark, n, lag):
    return K.lag_grid(spark.createDataFrame([("t", n)], "traj string, n_frames bigint"), lag)


def test_survival(spark):
    ev = events(spark, [(1, False, False), (3, False, False)])
    got = [r["survival"] for r in K.survival_continuous(ev, grid(spark, 10, 3)).orderBy("lag").collect()]
    assert got == [1.0, 0.5, 0.25, 0.0]
    ev = events(spark, [(1, False, False), (2, False, False), (2, False, True), (3, False, False), (9, True, False)])
    km = [r["survival"] for r in K.kaplan_meier(ev, grid(spark, 10, 3)).orderBy("lag").collect()]
    assert km == pytest.approx([1.0, 0.75, 0.5, 0.0])


def test_no_events_gives_null(spark):
    ev = events(spark, [(1, True, False)]).where("false")
    assert {r["survival"] for r in K.survival_continuous(ev, grid(spark, 10, 3)).collect()} == {None}
    assert {r["survival"] for r in K.kaplan_meier(ev, grid(spark, 10, 3)).collect()} == {None}


def test_censor_bounds(spark):
    act = spark.createDataFrame([("t", 1, 1, f) for f in range(5)] + [("t", 2, 1, 2)], "traj string, i bigint, mol_id bigint, frame bigint")
    lengths = spark.createDataFrame([("t", 5)], "traj string, n_frames bigint")
    ev = {r["i"]: r for r in K.events(act, lengths, 0.5).collect()}
    assert ev[1]["left_censored"] and ev[1]["right_censored"] and ev[1]["duration_upper_bound_ns"] is None
    assert (ev[2]["duration_lower_bound_ns"], ev[2]["duration_upper_bound_ns"]) == (0.0, 1.0)


def test_curve_statistics(spark):
    c = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 0.6), ("a", 2.0, 0.2), ("b", 0.0, 0.3), ("b", 1.0, 0.1)],
                              "k string, time double, value double")
    r = {x["k"]: x for x in R.curve_statistics(c, ["k"], {"half": 0.5}).collect()}
    assert r["a"]["integral"] == pytest.approx(1.2) and r["a"]["half"] == pytest.approx(1.25)
    assert r["b"]["half"] is None


@pytest.mark.parametrize("tau,beta,p", [(3.0, 0.7, 0.0), (1.5, 1.2, 0.0), (2.0, 0.8, 0.25)])
def test_stretched_exponential_is_recovered(spark, tau, beta, p):
    pts = [("c", 0.2 * k, p + (1 - p) * math.exp(-((0.2 * k / tau) ** beta))) for k in range(100)]
    df = spark.createDataFrame(pts, "k string, time double, value double")
    r = R.fit_kww(df, ["k"], plateau=p > 0).first()
    assert (r["tau"], r["beta"], r["plateau"]) == pytest.approx((tau, beta, p), rel=2e-3, abs=2e-3)
    assert r["fit_status"] == "relaxed_within_fit_window" and r["r_squared"] > 0.9999
    assert r["tau_mean"] == pytest.approx(r["tau"] * math.gamma(1 + 1 / r["beta"]), rel=1e-9)
    short = R.fit_kww(df.where(F.col("time") < 0.9), ["k"], plateau=False).first()
    assert short["fit_status"] == "fit_failed_too_few_points" and short["tau"] is None


def test_unbroken_contact_survives_at_every_lag(spark):
    """2,600 frames of one contact that never breaks: 1 at each of the 1,299 lags."""
    active = spark.range(2600).selectExpr("'t' AS traj", "1L AS i", "1L AS mol_id", "id AS frame")
    lengths = spark.createDataFrame([("t", 2600)], "traj string, n_frames bigint")
    rows = K.survival_intermittent(active, K.lag_grid(lengths)).collect()
    assert sorted(r["lag"] for r in rows) == list(range(1300)) and all(abs(r["survival"] - 1) < 1e-9 for r in rows)


def plain_survival(events, lags):
    total = sum(n for n, _, _ in events)
    return [sum(max(n - lag, 0) for n, _, _ in events) / total for lag in lags]


def plain_kaplan_meier(events, lags):
    usable, value, out = [(n, r) for n, left, r in events if not left], 1.0, []
    for lag in lags:
        risk = sum(n >= lag for n, _ in usable)
        deaths = sum(n == lag and not r for n, r in usable)
        value *= 1 - deaths / risk if risk else 1.0
        out.append(value)
    return out


@pytest.mark.parametrize("bucket", [1, 7, 4096])
def test_survival_over_buckets(spark, bucket):
    """Against plain sums, with lengths beyond the greatest lag and every risk set emptied before the end."""
    rng = random.Random(3)
    ev = [(rng.randint(1, 60), rng.random() < 0.1, rng.random() < 0.2) for _ in range(200)]
    for lag in (40, 80):
        g = grid(spark, 100, lag)
        got = [r["survival"] for r in K.survival_continuous(events(spark, ev), g, bucket).orderBy("lag").collect()]
        assert got == pytest.approx(plain_survival(ev, range(lag + 1)))
        got = [r["survival"] for r in K.kaplan_meier(events(spark, ev), g, bucket).orderBy("lag").collect()]
        assert got == pytest.approx(plain_kaplan_meier(ev, range(lag + 1)))


def test_long_curves_are_scanned_in_buckets(spark):
    """100,000 frames with an event of every length: no more rows than lags and lengths, no window without a bucket."""
    n = 100_000
    ev = spark.range(1, n + 1).selectExpr("'t' AS traj", "id AS n_observed_frames", "false AS left_censored", "false AS right_censored")
    g = K.lag_grid(spark.createDataFrame([("t", n)], "traj string, n_frames bigint"), n - 1)
    curve = K.survival_continuous(ev, g)
    assert curve.count() == n
    r = {x["lag"]: x["survival"] for x in curve.where("lag in (0, 1000, 99999)").collect()}
    want = lambda lag: (n - lag) * (n - lag + 1) / (n * (n + 1))
    assert all(r[k] == pytest.approx(want(k), rel=1e-12) for k in r)
    km = K.kaplan_meier(ev, g)
    r = {x["lag"]: x["survival"] for x in km.where("lag in (0, 1000, 99999)").collect()}
    assert all(r[k] == pytest.approx((n - k) / n, rel=1e-9) for k in r)
    for df in (curve, km):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        rows = [x for x in plan.splitlines() if "Window" in x]
        # The few bucket summaries are scanned per trajectory, rows per bucket.
        assert rows and all("_b" in x for x in rows) and "explode(sequence(0, (len" not in plan


def test_curves_are_dealt_whole(spark, monkeypatch):
    """A curve's points, wherever they were written, come to one task, so that its sums are shuffled once; long ones come in pieces."""
    n = 40
    points = spark.createDataFrame([(k, float(x), 0.5) for x in range(n) for k in range(6)], "k int, x double, y double").repartition(16)
    ranges = points.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumns({b: F.lit(1.0) for b in R.BOUNDS})
    tasks = lambda: {r["k"]: (r["t"], r["c"]) for r in R._dealt(points, ranges, ["k"]).withColumn("t", F.spark_partition_id()).groupBy("k").agg(
        F.count_distinct("t").alias("t"), F.count(F.lit(1)).alias("c")).collect()}
    assert tasks() == {k: (1, n) for k in range(6)}
    monkeypatch.setattr(R, "DEALT", 8)
    assert all(1 < t <= 6 and c == n for t, c in tasks().values())


def shell(spark, trajs, frames=14):
    """One cation and one molecule per trajectory; the three contact atoms stand at given distances, far off in some frames."""
    from mdframes.sources.pdb import Trajectory
    kinds = [("Li", "LI", 6), ("N", "FSA", 72), ("O", "FSA", 81), ("S", "FSA", 164)]
    atoms = [(t, k, e, e, r, "A", k and 1, "", a, e) for t in trajs for k, (e, r, a) in enumerate(kinds)]
    boxes = [(t, f, 4, 20.0, 20.0, 20.0, 90.0, 90.0, 90.0) for t in trajs for f in range(frames)]
    away = {1: lambda f: f % 4 == 3, 2: lambda f: f % 4 == 3, 3: lambda f: True}
    pos = [(t, f, k, 1.0 + (0.0 if k == 0 else far if away[k](f) else near), 1.0, 1.0)
           for t, (near, far) in trajs.items() for f in range(frames) for k in range(4)]
    return Trajectory(
        spark.createDataFrame(boxes, "traj string, frame bigint, n_atoms bigint, a double, b double, c double, alpha double, beta double, gamma double"),
        spark.createDataFrame(atoms, "traj string, atom_id bigint, name string, element string, resname string, chain string, resid bigint, icode string, "
                                     "atom_type int, site string"),
        spark.createDataFrame(pos, "traj string, frame bigint, atom_id bigint, x double, y double, z double"))


def test_residence_of_others_when_one_has_no_minimum(spark):
    from mdframes.operators import selection as SEL
    from mdframes.plans import residence as P

    def run(trajs):
        return P.residence(shell(spark, trajs), "Li", SEL.Target("FSA", ("72",)), ["N", "O", "S"], 0.2, rmax=6.0, bins=60, bandwidth=0.3, hysteresis=0.5)

    good = {"a": (2.05, 4.55), "b": (2.55, 5.05)}       # a shell, and another behind a gap
    alone, out = run(good), run({**good, "flat": (3.05, 3.05), "none": (9.05, 9.05)})
    cut = {r["traj"]: (r["r_on"] is not None, r["r_off"] is not None, r["cutoff_source"]) for r in out.cutoffs.collect()}
    assert cut == {"a": (True, True, "RDF_first_minimum"), "b": (True, True, "RDF_first_minimum"),
                   "flat": (False, False, "no_separated_minimum"), "none": (False, False, "no_first_shell_peak")}
    for name in ("events", "coordination", "relaxation"):
        want, got = ([sorted(map(str, getattr(x, name).collect()))] for x in (alone, out))
        assert got == want and want[0]
    known = out.correlations.where("traj IN ('a', 'b')")
    assert sorted(map(str, known.collect())) == sorted(map(str, alone.correlations.collect()))
    assert out.correlations.where("traj NOT IN ('a', 'b') AND value IS NOT NULL").count() == 0
    assert out.summary.columns == alone.summary.columns
    assert sorted(map(str, out.summary.where("traj IN ('a', 'b')").collect())) == sorted(map(str, alone.summary.collect()))
    rest = {r["traj"]: r.asDict() for r in out.summary.where("traj NOT IN ('a', 'b')").collect()}
    assert set(rest) == {"flat", "none"}
    for traj, r in rest.items():
        r = {k: v for k, v in r.items() if v is not None}
        assert r == {"traj": traj, "n_frames": 14, "n_molecules": 1, "n_cations": 1, "cutoff_source": cut[traj][2]}
