import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mdframes.functions import cell as C
from mdframes.operators import neighbors as N
from mdframes.operators import structure as S

CELLS = [(10, 11, 12, 90, 90, 90), (14, 13, 12, 80, 95, 105), (7, 30, 9, 90, 70, 90)]


def cloud(spark, n=60, seed=1):
    rng = random.Random(seed)
    cells = [("t", k, *map(float, c)) for k, c in enumerate(CELLS)]
    frames = spark.createDataFrame(cells, "traj string, frame bigint, a double, b double, c double, alpha double, beta double, gamma double")
    rows = [("t", k, i, *(rng.uniform(-15, 30) for _ in range(3))) for k in range(len(CELLS)) for i in range(n)]
    pos = spark.createDataFrame(rows, "traj string, frame bigint, atom_id bigint, x double, y double, z double")
    return frames, pos


def brute(frames, pos, cutoff):
    mats = {r["frame"]: np.array([[r["ax"], 0, 0], [r["bx"], r["by"], 0], [r["cx"], r["cy"], r["cz"]]])
            for r in C.with_cell_matrix(frames).collect()}
    rows = pos.collect()
    out = set()
    for k, m in mats.items():
        pts = [(r["atom_id"], np.array([r["x"], r["y"], r["z"]])) for r in rows if r["frame"] == k]
        inv = np.linalg.inv(m)
        for i, p in pts:
            for j, q in pts:
                if i != j:
                    f = (q - p) @ inv
                    d = (f - np.rint(f)) @ m
                    if d @ d <= cutoff * cutoff:
                        out.add((k, i, j, round(float(d @ d), 6)))
    return out


@pytest.mark.parametrize("cutoff,copied", [(2.5, "right"), (4.0, "left"), (3.0, "right"), (3.0, "left")])
def test_pairs_equal_brute_force(spark, cutoff, copied):
    frames, pos = cloud(spark)
    p = N.attach_cell(pos, frames)
    got = N.radius_pairs(p, p, cutoff, copied=copied).collect()
    have = {(r["frame"], r["i"], r["j"], round(r["r2"], 6)) for r in got}
    assert len(got) == len(have) and have == brute(frames, pos, cutoff)


def test_wrapping_does_not_change_distribution(spark):
    frames, pos = cloud(spark, 40)
    frames, pos = frames.where("frame = 0"), pos.where("frame = 0")
    moved = pos.withColumns({"x": F.col("x") + 10.0 * (F.col("atom_id") % 3), "y": F.col("y") - 11.0 * (F.col("atom_id") % 2)})
    def curve(p):
        s = N.attach_cell(p, frames).withColumn("site", F.lit("X"))
        return [r["count"] for r in S.rdf(s, "X", "X", 4.0, 0.5).orderBy("bin").collect()]
    assert curve(pos) == curve(moved)


def test_uniform_gas_is_flat(spark):
    rng = random.Random(3)
    rows = [("t", f, i, *(rng.uniform(0, 10) for _ in range(3)), "X") for f in range(20) for i in range(120)]
    pos = spark.createDataFrame(rows, "traj string, frame bigint, atom_id bigint, x double, y double, z double, site string")
    pos = pos.withColumns({k: F.lit(v) for k, v in dict(ax=10.0, bx=0.0, by=10.0, cx=0.0, cy=0.0, cz=10.0, volume=1000.0).items()})
    g = {r["bin"]: r["g"] for r in S.rdf(pos, "X", "X", 4.0, 0.5).collect()}
    assert all(abs(v - 1.0) < 0.08 for b, v in g.items() if b >= 3)


def test_missing_cell_is_an_error(spark):
    frames, pos = cloud(spark, 10)
    s = N.attach_cell(pos, frames).withColumn("site", F.lit("X")).withColumn("volume", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no cell"):
        S.rdf(s, "X", "X", 3.0, 0.5).collect()


def test_angles_of_a_square(spark):
    pts = [(0, 5.0, 5.0, "C"), (1, 6.0, 5.0, "A"), (2, 5.0, 6.0, "A"), (3, 4.0, 5.0, "A")]
    pos = spark.createDataFrame([("t", 0, i, x, y, 5.0, s) for i, x, y, s in pts],
                                "traj string, frame bigint, atom_id bigint, x double, y double, z double, site string")
    pos = pos.withColumns({k: F.lit(v) for k, v in dict(ax=10.0, bx=0.0, by=10.0, cx=0.0, cy=0.0, cz=10.0, volume=1000.0).items()})
    tri = S.adf_triplets(pos, "A", "C", "A", 1.5, 1.5)
    assert sorted(round(r["angle_deg"]) for r in tri.collect()) == [90, 90, 90, 90, 180, 180]
    assert S.adf_triplets(pos, "A", "C", "A", 1.5, 1.5, True).count() == 3
    top = S.adf(tri, 10.0).where("count > 0").orderBy("bin").collect()
    assert [(r["bin"], r["count"]) for r in top] == [(9, 4), (17, 2)]
    assert S.adf_triplets(pos, "A", "C", "A", 1.0, 1.5).count() == 0  # strict cutoff


def test_last_bin_is_full(spark):
    """A width that does not divide the range: the last bin counts to its own outer edge."""
    frames, pos = cloud(spark, 60)
    frames, pos = frames.where("frame = 0"), pos.where("frame = 0")
    s = N.attach_cell(pos, frames).withColumn("site", F.lit("X"))
    uneven = {r["bin"]: r["count"] for r in S.rdf(s, "X", "X", 3.0, 0.7).collect()}
    even = {r["bin"]: r["count"] for r in S.rdf(s, "X", "X", 3.5, 0.7).collect()}
    assert uneven == even and sorted(uneven) == [0, 1, 2, 3, 4]


def test_missing_site_is_an_error(spark):
    frames, pos = cloud(spark, 10)
    s = N.attach_cell(pos, frames).withColumn("site", F.lit("X"))
    with pytest.raises(Exception, match="no atoms of site X or O"):
        S.rdf(s, "X", "O", 3.0, 0.5).collect()


@pytest.mark.parametrize("cutoff", [2.5, 3.0, 4.0, 6.0])
def test_like_pairs_come_once(spark, cutoff):
    """Also where an axis has one or two cells, so that a cell touches another on both sides."""
    frames, pos = cloud(spark)
    got = [(r["frame"], r["i"], r["j"], round(r["r2"], 6)) for r in N.like_pairs(N.attach_cell(pos, frames), cutoff).collect()]
    assert len(got) == len({(f, min(i, j), max(i, j)) for f, i, j, _ in got})
    assert {(f, *sorted(p), r) for f, *p, r in got} == {(f, i, j, r) for f, i, j, r in brute(frames, pos, cutoff) if i < j}


def test_points_on_faces_and_at_the_cutoff(spark):
    """A lattice whose neighbours are exactly one cutoff apart, on the faces of the cells."""
    frames = spark.createDataFrame([("t", 0, 6.0, 6.0, 6.0, 90.0, 90.0, 90.0)], "traj string, frame bigint, a double, b double, c double, alpha double, beta double, gamma double")
    rows = [("t", 0, 36 * x + 6 * y + z, float(x), float(y), float(z)) for x in range(6) for y in range(6) for z in range(6)]
    p = N.attach_cell(spark.createDataFrame(rows, "traj string, frame bigint, atom_id bigint, x double, y double, z double"), frames)
    assert N.like_pairs(p, 1.0).count() == 3 * 216 and N.radius_pairs(p, p, 1.0).count() == 6 * 216
    assert N.radius_pairs(p, p, 1.0, copied="left").count() == 6 * 216 and N.like_pairs(p, 1.0, strict=True).count() == 0


def test_fewer_copies(spark):
    """Rows sent to cells: all 27 without a bound, 14 for like pairs, fewer where faces are far."""
    frames, pos = cloud(spark, 200)
    p = N.attach_cell(pos, frames).where("frame = 1")
    sent = lambda cutoff: N._touching(N._gridded(p, cutoff, [*N.POINT, *N.C.MATRIX])).count()
    plan = N.like_pairs(p, 2.0)
    grid = N._gridded(p, 2.0, [*N.POINT, *N.C.MATRIX]).selectExpr("*", N.CELL_ID.replace(" AS cell", " AS home"))
    half = N._touching(grid).selectExpr("*", N.CELL_ID).where("cell >= home").count()
    assert sent(2.0) < 27 * 200 and half < 14.5 / 27 * (27 * 200) and half < 0.6 * sent(2.0) and plan.count() > 0


def test_pairs_do_not_pass_the_driver(spark):
    """Sides that look small in shuffle files are not broadcast, which would build them in the driver's memory."""
    frames, pos = cloud(spark)
    p = N.attach_cell(pos, frames)
    for pairs in (N.radius_pairs(p, p, 3.0), N.like_pairs(p, 3.0)):
        assert pairs.count() > 0
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "Join" in x and "cell#" in x]
        assert joins and all("SortMergeJoin" in x for x in joins)


def test_thin_frames_get_few_cells(spark):
    """Cells of a thin frame hold some atoms each instead of being a cutoff thick, and the pairs are the same."""
    from mdframes import views as V
    rng = random.Random(5)
    rows = [("t", f, i, *[rng.random() * 20.0 for _ in "xyz"]) for f in range(2) for i in range(60)]
    p = V.in_cubic_box(spark.createDataFrame(rows, "traj string, frame bigint, atom_id bigint, x double, y double, z double"))
    assert N._most_cells(p) == 2 and N._most_cells(p.where("atom_id < 31")) == 1 and N._most_cells(p.where("atom_id < 0")) == 1
    got = sorted((r["frame"], min(r["i"], r["j"]), max(r["i"], r["j"])) for r in N.like_pairs(p, 3.0).collect())
    near = lambda a, b: sum(min(abs(u - v), 20.0 - abs(u - v)) ** 2 for u, v in zip(a[3:], b[3:])) <= 9.0
    assert got == sorted((a[1], a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] and near(a, b))
