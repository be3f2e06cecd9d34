"""Displacement correlations by species, conductivity decomposition and transference numbers.

Particles are rows traj, frame, label, charge, particle_id, x, y, z. ``keys`` may add columns,
such as a reference frame or a block number, that are analysed independently.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdframes import schema as S
from mdframes.functions import scalars as X
from mdframes.operators.dynamics import FRAMES_PER_BUCKET, lag_products
from mdframes.schema import XYZ

Species = Sequence[tuple[str, float]]


def term_sums(particles: DataFrame, species: Species, max_lag: int, keys: Sequence[str] = ("traj",),
              tile: int = 8192) -> DataFrame:
    """Raw lag sums: keys, term, lag, total, n.

    Terms are ``self:A`` (single particles), ``coll:A`` (summed positions), ``cross:A-B`` and
    ``total`` (charge-weighted sum over all species).
    """
    keys = list(keys)
    labels = [s[0] for s in species]
    if len(set(labels)) != len(labels):
        raise ValueError("species labels must be unique")
    mine = particles.where(F.col("label").isin(labels))
    single = mine.select(*keys, F.concat(F.lit("self:"), "label").alias("term"), "particle_id",
                         "frame", *XYZ)
    self_part = lag_products(single, [*keys, "term"], "particle_id", max_lag, tile=tile)
    wide = mine.groupBy(*keys, "frame").agg(
        *[F.sum(F.when(F.col("label") == lab, F.col(n))).alias(f"{n}_{i}")
          for i, lab in enumerate(labels) for n in XYZ])

    def vector(i: int) -> list[Column]:
        return [F.col(f"{n}_{i}") for n in XYZ]

    def entry(term: str, a: list[Column], b: list[Column]) -> Column:
        return F.struct(F.lit(term).alias("term"), *[c.alias(n) for n, c in zip(XYZ, a)],
                        *[c.alias(f"b{n}") for n, c in zip(XYZ, b)])

    entries = [entry(f"coll:{lab}", vector(i), vector(i)) for i, lab in enumerate(labels)]
    entries += [entry(f"cross:{labels[i]}-{labels[j]}", vector(i), vector(j))
                for i, j in combinations(range(len(labels)), 2)]
    charge = [sum((F.lit(float(z)) * F.col(f"{n}_{i}") for i, (_, z) in enumerate(species)), F.lit(0.0))
              for n in XYZ]
    entries.append(entry("total", charge, charge))
    coll = wide.select(*keys, "frame", F.explode(F.array(*entries)).alias("e")).select(
        *keys, "frame", "e.*").withColumn("particle_id", F.lit(0))
    coll_part = lag_products(coll, [*keys, "term"], "particle_id", max_lag, cross=True, tile=tile)
    return self_part.unionByName(coll_part)


def onsager_curves(sums: DataFrame, species: Species, dt: float, keys: Sequence[str] = ("traj",)) -> DataFrame:
    """Decomposed displacement correlations per term and lag.

    Output: keys, term, kind, za, zb, mult, lag, time, value, tracer. ``self:A`` is N times the
    single-particle MSD, ``distinct:A-A`` the collective minus the self part, ``distinct:A-B`` the
    cross correlation and ``total:charge`` the direct total. ``tracer`` is the plain MSD (self
    terms only).
    """
    keys = list(keys)
    z = {lab: float(c) for lab, c in species}
    charges = F.create_map(*[F.lit(v) for lab in z for v in (lab, z[lab])])
    head, tail = F.split("term", ":")[0], F.split("term", ":")[1]
    df = sums.withColumns({"part": head, "name": tail})
    mean = F.col("total") / F.col("n")
    selfs = df.where("part = 'self'").select(*keys, "lag", "name", F.col("total").alias("st"), mean.alias("tracer"))
    colls = df.where("part = 'coll'").select(*keys, "lag", "name", F.col("n").alias("cn"), mean.alias("cv"))
    both = selfs.join(colls, [*keys, "lag", "name"])
    q = charges[F.col("name")]
    none = F.lit(None).cast("double")
    self_sum = F.col("st") / F.col("cn")

    def row(term: Column, kind: str, za: Column, zb: Column, mult: float, value: Column, tracer: Column):
        return F.struct(term.alias("term"), F.lit(kind).alias("kind"), za.alias("za"), zb.alias("zb"),
                        F.lit(mult).alias("mult"), value.alias("value"), tracer.alias("tracer"))

    like = both.select(*keys, "lag", F.explode(F.array(
        row(F.concat(F.lit("self:"), "name"), "self", q, q, 1.0, self_sum, F.col("tracer")),
        row(F.concat(F.lit("distinct:"), "name", F.lit("-"), "name"), "same distinct", q, q, 1.0,
            F.col("cv") - self_sum, none))).alias("e")).select(*keys, "lag", "e.*")
    a, b = F.split("name", "-")[0], F.split("name", "-")[1]
    cross = df.where("part = 'cross'").select(*keys, "lag", row(
        F.concat(F.lit("distinct:"), "name"), "cross distinct", charges[a], charges[b], 2.0, mean,
        none).alias("e")).select(*keys, "lag", "e.*")
    total = df.where("part = 'total'").select(*keys, "lag", row(
        F.lit("total:charge"), "total", F.lit(1.0), F.lit(1.0), 1.0, mean, none).alias("e")).select(
        *keys, "lag", "e.*")
    out = like.unionByName(cross).unionByName(total)
    zero = F.when(F.col("lag") == 0, F.lit(0.0))
    return out.withColumns({"value": F.coalesce(zero, F.col("value")),
                            "time": F.col("lag") * F.lit(float(dt))})


# --- fits -------------------------------------------------------------------------------------


def fit_slope(curve: DataFrame, keys: Sequence[str], start: float | Column, end: float | Column,
              time: str = "time", value: str = "value") -> DataFrame:
    """Straight-line fit within [start, end]: keys, n, slope, intercept, r2.

    NULL with fewer than three points; r2 is NULL for a constant curve.
    """
    t, y = F.col(time), F.col(value)
    inside = (t >= start) & (t <= end) & X.finite(y).isNotNull()
    yy, tt = F.when(inside, y), F.when(inside, t)
    out = curve.groupBy(*keys).agg(
        F.count(yy).alias("n"), F.regr_slope(yy, tt).alias("slope"),
        F.regr_intercept(yy, tt).alias("intercept"), F.regr_r2(yy, tt).alias("r2"),
        F.min(yy).alias("_lo"), F.max(yy).alias("_hi"))
    ok = F.col("n") >= 3
    return out.select(*keys, "n", F.when(ok, F.col("slope")).alias("slope"),
                      F.when(ok, F.col("intercept")).alias("intercept"),
                      F.when(ok & (F.col("_lo") < F.col("_hi")), F.col("r2")).alias("r2"))


def expanding_slope(curve: DataFrame, keys: Sequence[str], start: float, values: Mapping[str, str], min_points: int = 8,
                    time: str = "time", order: str = "lag", bucket: int = FRAMES_PER_BUCKET) -> DataFrame:
    """Add the slope over all points from ``start`` up to each point; ``values`` maps new columns to the columns fitted.

    Within a bucket of ``order`` moments about the bucket's means are taken; those of earlier buckets are merged from their
    counts, means and centred moments, with means counted from the first bucket's, so that neither a long curve nor a large offset
    costs digits or makes one task.
    """
    keys = list(keys)
    pb = [*keys, "_b"]
    df = curve.withColumn("_b", F.floor(F.col(order) / bucket))
    here = Window.partitionBy(*pb).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    all_so_far = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    moments = {"n": lambda y, t: F.count(y), "t": lambda y, t: F.avg(t), "y": lambda y, t: F.avg(y),
               "tt": lambda y, t: F.regr_sxx(y, t), "ty": lambda y, t: F.regr_sxy(y, t)}
    for k, (name, value) in enumerate(values.items()):
        y = F.when((F.col(time) >= start) & X.finite(F.col(value)).isNotNull(), F.col(value))
        t = F.when(y.isNotNull(), F.col(time))
        df = df.withColumns({f"_{m}{k}": f(y, t).over(here) for m, f in moments.items()}).withColumn(f"_y_{k}", y)
        ends = curve.withColumn("_b", F.floor(F.col(order) / bucket)).groupBy(*pb).agg(*[f(y, t).alias(m) for m, f in moments.items()])
        first = {m: F.first(m, ignorenulls=True).over(all_so_far) for m in ("t", "y")}
        ends = ends.withColumns({f"{m}0": c for m, c in first.items()}).withColumns({
            "dt": F.coalesce(F.col("t") - F.col("t0"), F.lit(0.0)), "dy": F.coalesce(F.col("y") - F.col("y0"), F.lit(0.0))})
        parts = {"n": F.col("n"), "t": F.col("n") * F.col("dt"), "y": F.col("n") * F.col("dy"),
                 "tt": F.coalesce("tt", F.lit(0.0)) + F.col("n") * F.col("dt") * F.col("dt"),
                 "ty": F.coalesce("ty", F.lit(0.0)) + F.col("n") * F.col("dt") * F.col("dy")}
        ends = ends.withColumns({f"s{m}": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for m, c in parts.items()})
        ends = ends.select(*pb, *[F.col(c).alias(f"_{c}_{k}") for c in ("t0", "y0", "sn", "st", "sy", "stt", "sty")])
        df = df.join(ends, pb)
    for k, name in enumerate(values):
        c = lambda m, k=k: F.col(f"_{m}_{k}")
        own = lambda m, k=k: F.col(f"_{m}{k}")
        some, both = c("sn") > 0, (c("sn") > 0) & (own("n") > 0)
        mt, my = c("st") / c("sn"), c("sy") / c("sn")                   # means of the earlier buckets, from the first one's
        weight = c("sn") * own("n") / (c("sn") + own("n"))
        gap_t, gap_y = own("t") - c("t0") - mt, own("y") - c("y0") - my
        tt = (F.when(some, c("stt") - c("st") * mt).otherwise(0.0) + F.coalesce(own("tt"), F.lit(0.0))
              + F.when(both, weight * gap_t * gap_t).otherwise(0.0))
        ty = (F.when(some, c("sty") - c("st") * my).otherwise(0.0) + F.coalesce(own("ty"), F.lit(0.0))
              + F.when(both, weight * gap_t * gap_y).otherwise(0.0))
        enough = (c("sn") + own("n") >= max(min_points, 2)) & c("y").isNotNull() & (tt > 0)
        df = df.withColumn(name, F.when(enough, ty / tt))
    return df.drop("_b", *[f"_{m}{k}" for k in range(len(values)) for m in moments],
                   *[f"_{m}_{k}" for k in range(len(values)) for m in ("y", "t0", "y0", "sn", "st", "sy", "stt", "sty")])


def sigma_table(curves: DataFrame, system: DataFrame, start: float, end: float,
                keys: Sequence[str] = ("traj",), dimension: int = 3) -> DataFrame:
    """Conductivity of each term. ``system``: traj, volume_A3, temperature_K."""
    keys = list(keys)
    names = [*keys, "term", "kind", "za", "zb", "mult"]
    ends = curves.groupBy(*keys, "term").agg(F.least(F.lit(float(end)), F.max("time")).alias("fit_end_ns"))
    fit = fit_slope(curves, names, start, end).join(ends, [*keys, "term"]).join(system, "traj")
    pair = X.slope_to_sigma(F.col("slope"), F.col("za"), F.col("zb"), F.col("volume_A3"),
                            F.col("temperature_K"), dimension)
    return fit.select(*names, F.lit(float(start)).alias("fit_start_ns"), "fit_end_ns",
                      F.col("slope").alias("slope_A2_per_ns"), F.col("r2").alias("fit_R2"),
                      pair.alias("sigma_pair_S_per_m"),
                      (pair * F.col("mult")).alias("sigma_contribution_S_per_m"),
                      (pair * F.col("mult") * 10.0).alias("sigma_contribution_mS_per_cm"))


def sigma_check(table: DataFrame, keys: Sequence[str] = ("traj",)) -> DataFrame:
    """Sum of the decomposed terms next to the direct total, in mS/cm."""
    direct = F.col("term") == "total:charge"
    c = F.col("sigma_contribution_mS_per_cm")
    return table.groupBy(*keys).agg(F.sum(F.when(~direct, c)).alias("sigma_decomposed_mS_cm"),
                                    F.sum(F.when(direct, c)).alias("sigma_direct_total_mS_cm"))


def running_sigma(curves: DataFrame, system: DataFrame, start: float, min_points: int = 8,
                  keys: Sequence[str] = ("traj",), dimension: int = 3) -> DataFrame:
    """Conductivity (mS/cm) of each term as the fit window grows."""
    df = expanding_slope(curves, [*keys, "term"], start, {"slope": "value"}, min_points).join(system, "traj")
    sigma = X.slope_to_sigma(F.col("slope"), F.col("za"), F.col("zb"), F.col("volume_A3"),
                             F.col("temperature_K"), dimension) * F.col("mult") * 10.0
    return df.select(*keys, "term", "lag", "time", "value", sigma.alias("sigma_mS_cm"))


# --- transference numbers ---------------------------------------------------------------------

PAIR = ["Dplus", "Dminus", "Lpp", "Lmm", "Lpm"]


def pair_curves(sums: DataFrame, plus: str, minus: str, dt: float) -> DataFrame:
    """The five curves of a binary salt, renamed: keys, name, lag, time, value."""
    names = {f"self:{plus}": "Dplus", f"self:{minus}": "Dminus", f"coll:{plus}": "Lpp",
             f"coll:{minus}": "Lmm", f"cross:{plus}-{minus}": "Lpm", f"cross:{minus}-{plus}": "Lpm"}
    mapping = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return (sums.withColumn("name", F.try_element_at(mapping, F.col("term"))).where(F.col("name").isNotNull())
            .withColumns({"time": F.col("lag") * F.lit(float(dt)),
                          "value": F.when(F.col("lag") == 0, 0.0).otherwise(F.col("total") / F.col("n"))})
            .drop("term", "total", "n"))


def _spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col(value))).alias(n) for n in PAIR])


def transference_fit(curves: DataFrame, keys: Sequence[str], start: float, end: float,
                     zplus: float = 1.0, zminus: float = -1.0) -> DataFrame:
    """Transference numbers from one fit window per key."""
    slopes = fit_slope(curves, [*keys, "name"], start, end)
    wide = _spread(slopes, keys, "slope")
    return wide.withColumns(X.transference(*[F.col(n) for n in PAIR], zplus, zminus))


def transference_running(curves: DataFrame, keys: Sequence[str], start: float, min_points: int = 8,
                         zplus: float = 1.0, zminus: float = -1.0) -> DataFrame:
    """Transference numbers as the fit window grows: keys, lag, time, slopes and numbers."""
    df = expanding_slope(curves, [*keys, "name"], start, {"slope": "value"}, min_points)
    wide = _spread(df, [*keys, "lag", "time"], "slope")
    return wide.withColumns(X.transference(*[F.col(n) for n in PAIR], zplus, zminus))


def into_blocks(df: DataFrame, n_blocks: int, min_frames: int = 4) -> DataFrame:
    """Cut each trajectory into equal contiguous blocks with frames counted from 0.

    Left-over frames are dropped; trajectories whose blocks would be shorter than ``min_frames``
    give no rows.
    """
    if n_blocks < 2:
        raise ValueError("at least two blocks are needed")
    size = df.groupBy("traj").agg(F.floor((F.max("frame") + 1) / n_blocks).alias("_len"))
    out = df.join(size.where(F.col("_len") >= min_frames), "traj")
    out = out.withColumn("block", F.floor(F.col("frame") / F.col("_len")).cast("int"))
    return (out.where(F.col("block") < n_blocks)
            .withColumn("frame", F.col("frame") - F.col("block") * F.col("_len")).drop("_len"))


def block_error(df: DataFrame, keys: Sequence[str], value: str, n_blocks: int,
                mode: str = "sem") -> DataFrame:
    """Mean over blocks and its error: keys, mean, err.

    Missing values are skipped, but the error is divided by the number of blocks.
    """
    v = X.finite(F.col(value))
    root = n_blocks ** 0.5
    scale = {"sd": 1.0, "sem": 1.0 / root, "ci95": 1.96 / root}[mode]
    err = F.when(F.count(v) >= 2, F.stddev_samp(v) * scale) if n_blocks >= 2 else F.lit(None).cast("double")
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), err.alias("err"))


def running_block_error(running: DataFrame, n_blocks: int, mode: str = "sem") -> DataFrame:
    """Mean and error over blocks of the three running transference numbers at each lag:
    traj, ref, quantity, lag, time, mean, err. ``running`` has a ``block`` column."""
    names = ["PFG_t_app", "eNMR_t0", "Bruce_Vincent_tss"]
    long = running.select("traj", "ref", "lag", "time", F.explode(F.array(*[
        F.struct(F.lit(n).alias("quantity"), F.col(n).alias("v")) for n in names])).alias("e")).select("traj", "ref", "lag", "time", "e.*")
    return block_error(long, ["traj", "ref", "quantity", "lag", "time"], "v", n_blocks, mode)


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """N, mean, SD, SEM and CI95 of each column, missing values dropped."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("quantity"), F.col(c).alias("v"))
                                         for c in columns])).alias("e")).select("e.*")
    long = long.withColumn("v", X.finite(F.col("v"))).where(F.col("v").isNotNull())
    sd = F.when(F.count("v") >= 2, F.stddev_samp("v"))
    n = F.sqrt(F.count("v").cast("double"))
    return long.groupBy("quantity").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), sd.alias("sd"),
                                        (sd / n).alias("sem"), (F.lit(1.96) * sd / n).alias("ci95"))


def block_msd(sums: DataFrame, species: Species, dt: float, n_blocks: int, mode: str = "sem") -> DataFrame:
    """Block mean and error of self MSD, charge-weighted distinct terms and the direct total.

    ``sums`` come from ``term_sums`` with keys traj and block.
    """
    c = onsager_curves(sums, species, dt, ["traj", "block"])
    shown = F.when(F.col("kind") == "self", F.coalesce(F.col("tracer"), F.lit(0.0))).otherwise(
        F.col("mult") * F.col("za") * F.col("zb") * F.col("value"))
    return block_error(c.withColumn("shown", shown), ["traj", "term", "lag", "time"], "shown", n_blocks, mode)


# --- diffusion and temperature dependence -----------------------------------------------------


def fit_diffusion(curve: DataFrame, keys: Sequence[str], start: float | None = None,
                  end: float | None = None) -> DataFrame:
    """Diffusion coefficients from an MSD curve (keys, lag, time, msd).

    The default window runs from the point at 20 % to the point at 80 % of the curve. Fewer than
    three points in the window is an error.
    """
    n = F.count(F.lit(1))
    at = curve.groupBy(*keys).agg(n.alias("_n"), F.max("time").alias("_tmax"), F.max("lag").alias("_lmax"))
    dt = F.col("_tmax") / F.greatest(F.col("_lmax"), F.lit(1))
    lo = F.lit(float(start)) if start is not None else F.floor(F.lit(0.2) * F.col("_n")) * dt
    hi = F.lit(float(end)) if end is not None else F.floor(F.lit(0.8) * F.col("_n")) * dt
    window = at.select(*keys, lo.alias("fit_start_ns"), hi.alias("fit_end_ns"))
    df = curve.join(window, list(keys))
    eps = 1.0e-9
    df = df.where((F.col("time") > 0) & (F.col("time") >= F.col("fit_start_ns") - eps)
                  & (F.col("time") <= F.col("fit_end_ns") + eps))
    pos = F.col("msd") > 0
    ly, lt = F.when(pos, F.log10("msd")), F.when(pos, F.log10("time"))
    fit = df.groupBy(*keys, "fit_start_ns", "fit_end_ns").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("msd", "time").alias("s"),
        F.regr_intercept("msd", "time").alias("intercept_A2"), F.regr_r2("msd", "time").alias("_r2"),
        F.min("msd").alias("_lo"), F.max("msd").alias("_hi"), F.count(ly).alias("_ln"),
        F.regr_slope(ly, lt).alias("_alpha"))
    few = F.raise_error(F.lit("too few points in the fit window")).cast("double")
    s = F.when(F.col("n") < 3, few).otherwise(F.col("s"))
    d = s / 6.0
    return fit.select(*keys, "fit_start_ns", "fit_end_ns", s.alias("slope_A2_per_ns"), "intercept_A2",
                      d.alias("D_A2_per_ns"), (d * 1.0e-11).alias("D_m2_per_s"),
                      (d * 1.0e-7).alias("D_cm2_per_s"), (d * 1.0e-7 / 1.0e-5).alias("D_1e5_cm2_per_s"),
                      F.when(F.col("_ln") >= 3, F.col("_alpha")).alias("loglog_alpha"),
                      F.when(F.col("_lo") < F.col("_hi"), F.col("_r2")).alias("r2"))


def system_sigma(rows: DataFrame) -> DataFrame:
    """Total Nernst-Einstein conductivity per system; missing species count as 0."""
    return rows.groupBy("traj").agg(
        F.coalesce(F.sum("sigma_NE_S_m"), F.lit(0.0)).alias("sigma_total_NE_S_m"),
        (F.coalesce(F.sum("sigma_NE_S_m"), F.lit(0.0)) * 10.0).alias("sigma_total_NE_mS_cm"),
        F.array_join(F.array_sort(F.collect_set("label")), "+").alias("species_included"))


def arrhenius(rows: DataFrame, sigma: str, keys: Sequence[str] = ()) -> DataFrame:
    """Activation energy (eV) from log10(sigma T) against 1000/T; needs two usable points."""
    ok = (F.col("temperature_K") > 0) & (F.col(sigma) > 0)
    x = F.when(ok, F.lit(1000.0) / F.col("temperature_K"))
    y = F.when(ok, F.log10(F.col(sigma) * F.col("temperature_K")))
    out = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.regr_slope(y, x).alias("_s"),
                                  F.regr_intercept(y, x).alias("_i"))
    good = F.col("n") >= 2
    ea = F.lit(-1000.0) * F.log(F.lit(10.0)) * F.lit(S.K_B_EV_PER_K) * F.col("_s")
    return out.select(*keys, "n", F.when(good, F.col("_s")).alias("slope"),
                      F.when(good, F.col("_i")).alias("intercept"), F.when(good, ea).alias("Ea_eV"))


def axis_range(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Common plotting range over curves with errors, padded by 5 %."""
    e = F.coalesce(F.col("err"), F.lit(0.0))
    lo, hi = F.min(F.col("mean") - e), F.max(F.col("mean") + e)
    return stats.groupBy(*keys).agg((lo - (hi - lo) * 0.05).alias("lo"), (hi + (hi - lo) * 0.05).alias("hi"))


def solvent_curves(particles: DataFrame, solvent: str, max_lag: int, dt: float,
                   keys: Sequence[str] = ("traj",)) -> DataFrame:
    """Self MSD and mean-position MSD of the solvent, N times the latter, and their ratio."""
    keys = list(keys)
    mine = particles.where(F.col("label") == solvent)
    mean = mine.groupBy(*keys, "frame").agg(*[F.avg(n).alias(n) for n in XYZ]).withColumn("particle_id", F.lit(0).cast("long"))
    self_sum = lag_products(mine, keys, "particle_id", max_lag).withColumnsRenamed({"total": "st", "n": "sn"})
    com_sum = lag_products(mean, keys, "particle_id", max_lag).withColumnsRenamed({"total": "ct", "n": "cn"})
    z = F.col("lag") == 0
    n_solv = F.col("sn") / F.col("cn")
    s = F.when(z, 0.0).otherwise(F.col("st") / F.col("sn"))
    c = F.when(z, 0.0).otherwise(F.col("ct") / F.col("cn"))
    return self_sum.join(com_sum, [*keys, "lag"]).select(
        *keys, "lag", (F.col("lag") * F.lit(float(dt))).alias("time"), n_solv.cast("long").alias("n_solvent"),
        s.alias("self_msd"), c.alias("com_msd"), (n_solv * c).alias("n_com_msd"),
        F.when(F.abs(s) > 0, n_solv * c / s).alias("ratio"))


def solvent_diffusion(curves: DataFrame, keys: Sequence[str], start: float, end: float,
                      dimension: int = 3) -> DataFrame:
    """Diffusion fits of the self, mean-position and N-scaled curves."""
    long = curves.select(*keys, "time", "n_solvent", F.explode(F.array(
        F.struct(F.lit("self").alias("quantity"), F.col("self_msd").alias("value")),
        F.struct(F.lit("mean_com").alias("quantity"), F.col("com_msd").alias("value")),
        F.struct(F.lit("n_times_mean_com").alias("quantity"), F.col("n_com_msd").alias("value")))).alias("e"))
    fit = fit_slope(long.select(*keys, "time", "n_solvent", "e.*"), [*keys, "quantity", "n_solvent"], start, end)
    return fit.select(*keys, "quantity", "n_solvent", F.col("slope").alias("slope_A2_per_ns"),
                      X.slope_to_diffusion_cm2_s(F.col("slope"), dimension).alias("D_cm2_per_s"),
                      F.col("r2").alias("fit_R2"))


def solvent_running(curves: DataFrame, keys: Sequence[str], start: float, min_points: int = 8,
                    dimension: int = 3) -> DataFrame:
    """Running diffusion estimates of the self and N-scaled mean-position curves."""
    out = expanding_slope(curves, keys, start, {"s": "self_msd", "c": "n_com_msd"}, min_points)
    return out.select(*keys, "lag", "time",
                      X.slope_to_diffusion_cm2_s(F.col("s"), dimension).alias("D_self_cm2_per_s"),
                      X.slope_to_diffusion_cm2_s(F.col("c"), dimension).alias("D_n_com_cm2_per_s"))
