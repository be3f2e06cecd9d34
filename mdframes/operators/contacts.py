"""Contact lifetimes with two-radius hysteresis, survival functions and coordination states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdframes.functions import scalars as X
from mdframes.operators.dynamics import FRAMES_PER_BUCKET, lag_products
from mdframes.operators.scan import remaining, running, running_product

PAIR = ["traj", "i", "mol_id"]


def activity(candidates: DataFrame, r_on: float | Column, bucket: int = FRAMES_PER_BUCKET) -> DataFrame:
    """Frames in which each pair is in contact: traj, i, mol_id, frame.

    ``candidates`` are the frames with distance <= r_off (columns r2). A contact starts when the
    distance falls to r_on (a number, or a column of the candidates) and lasts while the pair stays a candidate in consecutive frames.

    Frames are cut into buckets so that no pair's history is one task's work: within a bucket
    contacts follow from runs of consecutive frames; one bit per bucket says whether a contact
    crosses its border.
    """
    pb = [*PAIR, "_b"]
    df = candidates.withColumn("_b", F.floor(F.col("frame") / bucket))
    w = Window.partitionBy(*pb).orderBy("frame")
    df = df.withColumn("_run", F.col("frame") - F.row_number().over(w))
    run = Window.partitionBy(*pb, "_run").orderBy("frame")
    close = F.col("r2") <= (r_on * r_on if isinstance(r_on, Column) else F.lit(float(r_on) * float(r_on)))
    df = df.withColumns({
        "_on": F.max(close).over(run.rowsBetween(Window.unboundedPreceding, 0)),
        "_head": F.min("frame").over(Window.partitionBy(*pb, "_run")) == F.col("_b") * bucket})
    # Out-state of a bucket given its in-state: a OR (b AND in). No row at the border: broken.
    at_end = F.col("frame") == (F.col("_b") + 1) * bucket - 1
    ends = df.groupBy(*pb).agg(F.coalesce(F.bool_or(at_end & F.col("_on")), F.lit(False)).alias("a"),
                               F.coalesce(F.bool_or(at_end & F.col("_head")), F.lit(False)).alias("b"))
    by = Window.partitionBy(*PAIR).orderBy("_b")
    ends = ends.withColumn("_chain", F.col("_b") - F.row_number().over(by))
    before = (Window.partitionBy(*PAIR, "_chain").orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    decided = F.when(F.col("a") | ~F.col("b"), F.col("a"))
    ends = ends.withColumn("_in", F.coalesce(F.last(decided, ignorenulls=True).over(before), F.lit(False)))
    out = df.join(ends.select(*pb, "_in"), pb)
    return out.where(F.col("_on") | (F.col("_head") & F.col("_in"))).select(*PAIR, "frame")


def events(active: DataFrame, lengths: DataFrame, dt: float, bucket: int = FRAMES_PER_BUCKET) -> DataFrame:
    """Contact events from active frames. ``lengths``: traj, n_frames.

    Output: traj, i, mol_id, start_frame, end_frame, n_observed_frames, duration_*, *_censored.
    """
    pb = [*PAIR, "_b"]
    df = active.withColumn("_b", F.floor(F.col("frame") / bucket))
    run = F.col("frame") - F.row_number().over(Window.partitionBy(*pb).orderBy("frame"))
    seg = df.withColumn("_run", run).groupBy(*pb, "_run").agg(F.min("frame").alias("s"), F.max("frame").alias("e"))
    border = (F.col("s") == F.col("_b") * bucket) | (F.col("e") == (F.col("_b") + 1) * bucket - 1)
    inner = seg.where(~border).select(*PAIR, "s", "e")
    w = Window.partitionBy(*PAIR).orderBy("s")
    cut = F.coalesce((F.lag("e").over(w) + 1 != F.col("s")).cast("int"), F.lit(1))
    outer = (seg.where(border).withColumn("_cut", cut)
             .withColumn("_ev", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy(*PAIR, "_ev").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_ev"))
    ev = inner.unionByName(outer).join(lengths.select("traj", "n_frames"), "traj")
    left, right = F.col("s") == 0, F.col("e") == F.col("n_frames") - 1
    n = F.col("e") - F.col("s") + 1
    return ev.select(*PAIR, F.col("s").alias("start_frame"), F.col("e").alias("end_frame"),
                     n.alias("n_observed_frames"),
                     *[c.alias(k) for k, c in X.duration_bounds(n, dt, left, right).items()],
                     left.alias("left_censored"), right.alias("right_censored"))


def lag_grid(lengths: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Dense lags per trajectory; half the trajectory unless ``max_lag`` says otherwise."""
    top = F.greatest(F.lit(1), F.floor((F.col("n_frames") - 1) / 2)) if max_lag is None else \
        F.least(F.lit(max_lag), F.col("n_frames") - 1)
    return lengths.select("traj", "n_frames",
                          F.explode(F.sequence(F.lit(0).cast("long"), top.cast("long"))).alias("lag"))


def _durations(ev: DataFrame) -> DataFrame:
    return ev.groupBy("traj", F.col("n_observed_frames").alias("len")).agg(F.count(F.lit(1)).alias("cnt"))


def survival_continuous(ev: DataFrame, grid: DataFrame, bucket: int = FRAMES_PER_BUCKET) -> DataFrame:
    """sum(max(L - lag, 0)) / sum(L) over events of length L; NULL without events.

    With S0 and S1 the number and the summed length of events longer than the lag, the sum is S1 - lag S0: one backward scan
    over lags and distinct lengths, in buckets.
    """
    hist = _durations(ev)
    total = hist.groupBy("traj").agg(F.sum(F.col("cnt") * F.col("len")).alias("_total"))
    points = (grid.select("traj", "lag", F.lit(True).alias("_asked"))
              .join(hist.withColumnRenamed("len", "lag"), ["traj", "lag"], "full").withColumn("_b", F.floor(F.col("lag") / bucket)))
    n = F.coalesce("cnt", F.lit(0))
    out = remaining(points, ["traj"], "_b", ["lag"], {"_s0": n, "_s1": n * F.col("lag")}).where("_asked").join(total, "traj", "left")
    value = F.when(F.col("_total") > 0, (F.col("_s1") - F.col("lag") * F.col("_s0")) / F.col("_total"))
    return out.select("traj", "lag", value.alias("survival"))


def survival_intermittent(active: DataFrame, grid: DataFrame) -> DataFrame:
    """Probability of contact at f + lag given contact at f, whatever happens between.

    The lag counts come from the tiled lag kernel, for every lag of ``grid`` (its greatest lag is the one
    number the driver sees): active frames are present, others are gaps.
    """
    max_lag = grid.agg(F.max("lag")).first()[0] or 0
    presence = active.select("traj", "frame", F.concat_ws("|", "i", "mol_id").alias("pair"))
    num = lag_products(presence, ["traj"], "pair", max_lag, counts_only=True).select("traj", "lag", F.col("n").alias("_num"))
    on = active.groupBy("traj").agg(F.count(F.lit(1)).alias("_on"))
    out = grid.join(on, "traj", "left").join(num, ["traj", "lag"], "left")
    value = F.when(F.col("_on") > 0, F.coalesce(F.col("_num"), F.lit(0)) * F.col("n_frames")
                   / ((F.col("n_frames") - F.col("lag")) * F.col("_on")))
    return out.select("traj", "lag", value.alias("survival"))


def kaplan_meier(ev: DataFrame, grid: DataFrame, bucket: int = FRAMES_PER_BUCKET) -> DataFrame:
    """Kaplan-Meier survival: left-censored events dropped, right-censored ones only at risk.

    The number at risk is a running sum and the curve a running product, both over buckets of lags.
    """
    usable = ev.where(~F.col("left_censored"))
    hist = usable.groupBy("traj", F.col("n_observed_frames").alias("lag")).agg(
        F.count(F.lit(1)).alias("_ended"), F.count_if(~F.col("right_censored")).alias("_deaths"))
    total = usable.groupBy("traj").agg(F.count(F.lit(1)).alias("_total"))
    out = grid.select("traj", "lag").join(total, "traj", "left").join(hist, ["traj", "lag"], "left")
    out = out.fillna(0, ["_ended", "_deaths"]).withColumn("_b", F.floor(F.col("lag") / bucket))
    out = running(out, ["traj"], "_b", ["lag"], {"_gone": F.col("_ended")})
    risk = F.col("_total") - F.col("_gone") + F.col("_ended")
    out = out.withColumn("_step", F.when(risk > 0, F.lit(1.0) - F.col("_deaths") / risk).otherwise(1.0))
    out = running_product(out, ["traj"], "_b", ["lag"], "_left", F.col("_step"))
    return out.select("traj", "lag", F.when(F.col("_total") > 0, F.col("_left")).alias("survival"))


def coordination(active: DataFrame, cations: DataFrame, name: str = "n") -> DataFrame:
    """Contacts per (traj, frame, cation), zero included. ``cations``: traj, frame, i."""
    n = active.groupBy("traj", "frame", "i").agg(F.count(F.lit(1)).alias(name))
    return cations.join(n, ["traj", "frame", "i"], "left").fillna(0, [name])


def joint_states(anion: DataFrame, solvent: DataFrame) -> DataFrame:
    """Probability of each (n_anion, n_solvent) coordination state per trajectory."""
    both = anion.withColumnRenamed("n", "n_anion").join(
        solvent.withColumnRenamed("n", "n_solvent"), ["traj", "frame", "i"])
    c = both.groupBy("traj", "n_anion", "n_solvent").agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("traj")))


def summary(ev: DataFrame, active: DataFrame, coord: DataFrame, sizes: DataFrame) -> DataFrame:
    """Residence summary per trajectory. ``sizes``: traj, n_frames, n_cations, n_molecules."""
    done = ~F.col("left_censored") & ~F.col("right_censored")
    d = F.when(done, F.col("duration_grid_ns"))
    # The histogram of durations is exact for the median and small whatever the event count.
    hist = ev.groupBy("traj", d.alias("d")).agg(
        F.count(F.lit(1)).alias("k"), F.count_if("left_censored").alias("lc"),
        F.count_if("right_censored").alias("rc"))
    e = hist.groupBy("traj").agg(
        F.sum("k").alias("n_events"), F.sum(F.when(F.col("d").isNotNull(), F.col("k"))).alias("n_complete_events"),
        F.sum("lc").alias("n_left_censored"), F.sum("rc").alias("n_right_censored"),
        F.expr("percentile(d, 0.5, k)").alias("median_complete_duration_grid_ns"),
        (F.sum(F.col("d") * F.col("k")) / F.sum(F.when(F.col("d").isNotNull(), F.col("k"))))
        .alias("mean_complete_duration_grid_ns"))
    on = active.groupBy("traj").agg(F.count(F.lit(1)).alias("occupied_pair_frames"))
    mean = coord.groupBy("traj").agg(F.avg("n").alias("mean_coordination"))
    out = sizes.join(e, "traj", "left").join(on, "traj", "left").join(mean, "traj", "left")
    out = out.fillna(0, ["n_events", "n_complete_events", "n_left_censored", "n_right_censored", "occupied_pair_frames"])
    cells = F.col("n_frames") * F.col("n_cations") * F.col("n_molecules")
    return out.withColumns({
        "contact_occupancy_fraction": F.try_divide(F.col("occupied_pair_frames").cast("double"), cells),
        "formed_transitions": F.col("n_events"),
        "broken_transitions": F.col("n_events") - F.col("n_right_censored")})
