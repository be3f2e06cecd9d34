"""Radial and angular distributions, coordination numbers and first-shell analysis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdframes.functions import cell as C
from mdframes.operators.neighbors import KEYS, like_pairs, radius_pairs
from mdframes.staging import stage

ERR_NO_BOX = "no cell for a frame: periodic distances need one"


def n_bins(rmax: float, bin_width: float) -> int:
    return int(math.ceil(rmax / bin_width - 1.0e-9))


def histogram(values: DataFrame, column: Column, bin_width: float, bins: int,
              keys: list[str]) -> DataFrame:
    """keys, bin, count. Bins are left-closed; the last one also takes its right edge."""
    index = F.least(F.floor(column / F.lit(float(bin_width))), F.lit(bins - 1)).cast("int")
    return values.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def _dense(norms: DataFrame, hist: DataFrame, bins: int) -> DataFrame:
    """One row per (traj, bin), with zero counts where nothing fell."""
    grid = norms.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(hist, ["traj", "bin"], "left").fillna(0, ["count"])


def rdf(sites: DataFrame, site1: str, site2: str, rmax: float, bin_width: float,
        volume: str = "frame") -> DataFrame:
    """g(r) and running coordination number per trajectory.

    ``volume='frame'`` normalises every frame with its own volume; ``'mean'`` uses the mean volume
    and drops coincident like pairs (d <= 1e-8). The last bin is a full one and may end beyond ``rmax``.
    A trajectory without atoms of either site is an error. Output: traj, bin, r, g, count, cn.
    """
    if volume not in ("frame", "mean"):
        raise ValueError("volume must be 'frame' or 'mean'")
    if rmax <= 0 or bin_width <= 0:
        raise ValueError("rmax and bin_width must be positive")
    bins = n_bins(rmax, bin_width)
    like = site1 == site2
    left = sites.where(F.col("site") == site1).drop("site")
    right = left if like else sites.where(F.col("site") == site2).drop("site")
    per_frame = sites.groupBy(*KEYS).agg(
        F.count_if(F.col("site") == site1).alias("n1"),
        F.count_if(F.col("site") == site2).alias("n2"), F.first("volume").alias("v"))
    v = F.when(F.col("v").isNull(), F.raise_error(F.lit(ERR_NO_BOX)).cast("double")).otherwise(F.col("v"))
    n2 = F.col("n2") - (1 if like else 0)
    norms = per_frame.groupBy("traj").agg(
        F.sum(F.col("n1") * n2 / v).alias("per_frame"), F.sum("n1").alias("tn1"),
        F.sum("n2").alias("tn2"), F.avg(n2).alias("n2"), F.avg(v).alias("mean_v"))
    norms = norms.withColumn("tn1", F.when((F.col("tn1") > 0) & (F.col("tn2") > 0), F.col("tn1")).otherwise(
        F.raise_error(F.concat(F.lit(f"no atoms of site {site1} or {site2} in "), "traj")).cast("long")))
    # Pairs reach to the outer edge of the last bin, also where the width doesn't divide rmax.
    reach = max(rmax, bins * bin_width)
    pairs = like_pairs(left, reach) if like else radius_pairs(left, right, reach)
    if like and volume == "mean":
        pairs = pairs.where(F.sqrt("r2") > 1.0e-8)
    hist = histogram(pairs, F.sqrt("r2"), bin_width, bins, ["traj"])
    if like:        # each pair counts for both of its atoms
        hist = hist.withColumn("count", F.col("count") * 2)
    out = _dense(norms, hist, bins)
    lo = F.col("bin") * F.lit(float(bin_width))
    hi = (F.col("bin") + 1) * F.lit(float(bin_width))
    shell = F.lit(4.0 / 3.0 * math.pi) * (hi * hi * hi - lo * lo * lo)
    weight = F.col("per_frame") if volume == "frame" else F.col("tn1") * F.col("n2") / F.col("mean_v")
    upto = Window.partitionBy("traj").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        "traj", "bin", ((lo + hi) * 0.5).alias("r"),
        F.when(weight * shell > 0, F.col("count") / (weight * shell)).otherwise(F.lit(0.0)).alias("g"),
        "count", F.try_divide(F.sum("count").over(upto).cast("double"), F.col("tn1")).alias("cn"))


def even_frames(frames: DataFrame, samples: int) -> DataFrame:
    """At most ``samples`` evenly spaced frames per trajectory (frames count from 0)."""
    n = F.col("_n")
    k = F.least(F.lit(samples), n)
    step = (n - 1) / F.greatest(k - 1, F.lit(1)).cast("double")
    spans = frames.groupBy("traj").agg((F.max("frame") + 1).alias("_n"))
    i = F.col("_i")
    pick = F.when(i == k - 1, F.when(k > 1, n - 1).otherwise(F.lit(0))).otherwise(F.floor(i * step))
    return (spans.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), (k - 1).cast("long"))))
            .select("traj", pick.cast("long").alias("frame")).distinct())


def rdf_sampled(sites: DataFrame, site1: str, site2: str, rmax: float, bins: int,
                samples: int) -> DataFrame:
    """g(r) over evenly spaced frames only."""
    chosen = even_frames(sites.select("traj", "frame"), samples)
    return rdf(sites.join(chosen, KEYS, "left_semi"), site1, site2, rmax, rmax / bins)


def adf_triplets(sites: DataFrame, site1: str, site2: str, site3: str, rcut12: float,
                 rcut23: float, unique_terminals: bool = False) -> DataFrame:
    """Angles at ``site2`` between one neighbour of each kind: traj, frame, centre, angle_deg.

    All arms come from one neighbour join, written once; the angles are a join of that table with itself.
    """
    centre = sites.where(F.col("site") == site2).drop("site")
    ends = sites.where(F.col("site").isin(site1, site3))
    arms = radius_pairs(centre, ends, max(rcut12, rcut23), strict=True, copied="left").where(F.col("r2") > 1.0e-24)
    arms = stage(arms.select("traj", "frame", F.col("i").alias("centre"), F.col("j").alias("end"), "dx", "dy", "dz", "r2",
                             F.col("r_site").alias("site")), "arms")

    def side(site: str, cut: float, tag: str) -> DataFrame:
        hit = arms.where((F.col("site") == site) & (F.col("r2") < float(cut) * float(cut)))
        return hit.select("traj", "frame", "centre", F.col("end").alias(f"end{tag}"),
                          *[F.col(f"d{n}").alias(f"{tag}{n}") for n in "xyz"], F.sqrt("r2").alias(f"{tag}r"))

    both = side(site1, rcut12, "p").join(side(site3, rcut23, "q"), ["traj", "frame", "centre"])
    keep = F.col("endp") != F.col("endq")
    if unique_terminals and site1 == site3:
        keep = F.col("endp") < F.col("endq")
    norm = F.col("pr") * F.col("qr")
    angle = F.expr(f"degrees(acos(greatest(-1D, least(1D, {C.dot('p', 'q')}/(pr*qr)))))")
    return both.where(keep & (norm > 1.0e-14)).select("traj", "frame", "centre",
                                                      angle.alias("angle_deg"))


def adf(triplets: DataFrame, bin_width: float, trajs: DataFrame | None = None) -> DataFrame:
    """Angle histogram per trajectory: bin, angle_deg, density_per_degree, probability, count.

    ``trajs`` lists trajectories that must appear even when no angle was found.
    """
    bins = n_bins(180.0, bin_width)
    hist = histogram(triplets, F.col("angle_deg"), bin_width, bins, ["traj"])
    base = (trajs if trajs is not None else hist).select("traj").distinct()
    out = _dense(base, hist, bins)
    total = F.sum("count").over(Window.partitionBy("traj"))
    hi = F.least((F.col("bin") + 1) * F.lit(float(bin_width)), F.lit(180.0))
    return out.select(
        "traj", "bin", ((F.col("bin") * F.lit(float(bin_width)) + hi) * 0.5).alias("angle_deg"),
        F.when(total > 0, F.col("count") / (total * F.lit(float(bin_width)))).otherwise(0.0)
        .alias("density_per_degree"),
        F.when(total > 0, F.col("count") / total).otherwise(0.0).alias("probability_per_bin"), "count")


def adf_counters(triplets: DataFrame) -> DataFrame:
    """Frames and centres with at least one angle, and the number of angles, per trajectory."""
    per_centre = triplets.groupBy("traj", "frame", "centre").agg(F.count(F.lit(1)).alias("n"))
    per_frame = per_centre.groupBy("traj", "frame").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    return per_frame.groupBy("traj").agg(F.count(F.lit(1)).alias("n_frames_with_angles"),
                                         F.sum("c").alias("n_centers_with_angles"),
                                         F.sum("n").alias("n_angles_total"))


def smooth(curve: DataFrame, keys: list[str], value: str, bandwidth: float, dr: float, bins: int,
           edge: str = "nearest") -> DataFrame:
    """Gaussian smoothing along ``bin``; ``edge`` is 'nearest' or 'reflect'. Adds ``smoothed``."""
    sigma = max(bandwidth / dr, 0.5)
    radius = int(4.0 * sigma + 0.5)
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    total = sum(weights)
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w / total).alias("w"))
                       for o, w in zip(range(-radius, radius + 1), weights)])
    taps = curve.select(*keys, "bin", F.explode(kernel).alias("t"))
    at = F.col("bin") + F.col("t.o")
    if edge == "nearest":
        at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), at))
    elif edge == "reflect":
        m = F.pmod(at, F.lit(2 * bins))
        at = F.when(m < bins, m).otherwise(2 * bins - 1 - m)
    else:
        raise ValueError("edge must be 'nearest' or 'reflect'")
    taps = taps.select(*keys, F.col("bin").alias("_out"), F.col("t.w").alias("_w"),
                       at.cast("int").alias("bin"))
    out = (taps.join(curve.select(*keys, "bin", F.col(value).alias("_v")), [*keys, "bin"])
           .groupBy(*keys, F.col("_out").alias("bin")).agg(F.sum(F.col("_w") * F.col("_v"))
                                                           .alias("smoothed")))
    return curve.join(out, [*keys, "bin"])


def extrema(curve: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Strict local extrema of a curve; the middle index stands for a plateau.

    One row per curve: keys, and ``marks``, an array of (bin, height, kind) in bin order with kind
    'max' or 'min'. A curve is bounded by its bins.
    """
    w = Window.partitionBy(*keys).orderBy("bin")
    df = curve.select(*keys, "bin", F.col(value).alias("v"))
    df = df.withColumn("_new", F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = df.groupBy(*keys, "_run").agg(F.min("bin").alias("s"), F.max("bin").alias("e"), F.max("v").alias("h"))
    r = Window.partitionBy(*keys).orderBy("_run")
    runs = runs.withColumns({"_l": F.lag("h").over(r), "_r": F.lead("h").over(r)})
    mark = F.expr("""CASE WHEN h > _l AND h > _r THEN struct(int((s + e) div 2) AS bin, h AS height, 'max' AS kind)
                          WHEN h < _l AND h < _r THEN struct(int((s + e) div 2) AS bin, h AS height, 'min' AS kind) END""")
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(mark)).alias("marks"))


def first_minimum(curve: DataFrame, keys: list[str], value: str, dr: float,
                  min_peak_r: float = 1.2) -> DataFrame:
    """First-shell radius of each smoothed g(r): keys, r_peak, r_min, status.

    The peak is the first maximum at r >= ``min_peak_r`` of at least 10 % of the highest such
    maximum; the minimum is the first one at least max(2 dr, 0.10) beyond it.
    """
    gap = max(2.0 * dr, 0.10)
    df = extrema(curve, keys, value)
    r = f"((m.bin + 0.5D)*{float(dr)}D)"
    df = df.selectExpr(*keys, "marks", f"filter(marks, m -> m.kind = 'max' AND {r} >= {min_peak_r}D) AS peaks")
    df = df.selectExpr(*keys, "marks", "peaks", "array_max(transform(peaks, m -> m.height)) AS top")
    df = df.selectExpr(*keys, "marks", f"""get(transform(coalesce(
        nullif(filter(peaks, m -> m.height >= 0.10D*top), cast(array() AS array<struct<bin:int,height:double,kind:string>>)),
        peaks), m -> {r}), 0) AS r_peak""")
    df = df.selectExpr(*keys, "r_peak", f"""get(transform(filter(marks,
        m -> m.kind = 'min' AND {r} - r_peak >= {gap}D - 1e-9D), m -> {r}), 0) AS r_min""")
    return df.selectExpr(*keys, "r_peak", "r_min", """CASE WHEN r_peak IS NULL THEN 'no_first_shell_peak'
        WHEN r_min IS NULL THEN 'no_separated_minimum' ELSE 'ok' END AS status""")
