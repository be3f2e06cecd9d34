"""Run logs and snapshots on a time axis: nearest as-of join, stitching, running means, summaries."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdframes.functions import cell as C
from mdframes.functions import scalars as X
from mdframes.operators.scan import fold, previous, running, tasks_for, with_carry
from mdframes.staging import stage

RUN = ["series", "run_index"]
MEASURES = ["potential_kcal_mol", "kinetic_kcal_mol", "total_energy_kcal_mol", "temperature_K",
            "pressure_atm", "a_A", "b_A", "c_A", "alpha_deg", "beta_deg", "gamma_deg", "volume_A3",
            "density_g_cm3"]
CELL_A = ["a_A", "b_A", "c_A", "alpha_deg", "beta_deg", "gamma_deg"]
ROWS_PER_TASK = 200_000     # rows that a task of the as-of join sorts


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str] = RUN, time: str = "time_ps",
                 tolerance: float | None = None, width: float = 10_000.0, suffix: str = "_log",
                 right_order: Sequence[str] = ()) -> DataFrame:
    """Each left row with the right row nearest in time; ties take the earlier right row.

    Among equal right times the last (by ``right_order``) wins looking back, the first looking
    ahead. Rows without a time are removed; ``tolerance`` is inclusive. Columns of both sides
    other than keys and time get ``suffix`` on the right; ``time + suffix`` is the matched time.

    Both sides are unioned and scanned once per time bucket of ``width``; the nearest rows outside
    a bucket arrive as bucket summaries, so a long run is not one task. Buckets are dealt to as many tasks as the
    rows ask for: a task sorts the same number of rows, however many there are.
    """
    values = [c for c in right.columns if c not in {*keys, time}]
    lcols = [c for c in left.columns if c not in {*keys, time}]
    left = left.where(F.col(time).isNotNull() & ~F.isnan(time))
    right = right.where(F.col(time).isNotNull() & ~F.isnan(time))
    payload = F.struct(F.col(time).alias("t"), *[F.col(c) for c in values])
    # Rights sort before lefts of the same time, so "ahead" means strictly later.
    order = F.struct(*[F.col(c) for c in right_order]) if right_order else F.lit(0)
    lpart = left.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).cast(
        right.select(order.alias("o")).schema["o"].dataType).alias("_o"),
        F.struct(*[F.col(c) for c in lcols]).alias("_l") if lcols else F.struct(F.lit(0).alias("_")).alias("_l"))
    rpart = right.select(*keys, time, F.lit(0).alias("_side"), order.alias("_o"), payload.alias("_r"))
    both = lpart.unionByName(rpart, allowMissingColumns=True).withColumn("_b", F.floor(F.col(time) / width))
    both = with_carry(both, keys, "_b", [time, "_side", "_o"], lasts={"_before": F.col("_r")},
                      nexts={"_after": F.col("_r")}, tasks=tasks_for(left.count() + right.count(), ROWS_PER_TASK, left.sparkSession))
    w = Window.partitionBy(*keys, "_b").orderBy(time, "_side", "_o")
    back = F.coalesce(F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                      F.col("_before"))
    desc = Window.partitionBy(*keys, "_b").orderBy(F.desc(time), F.desc("_side"), F.desc("_o"))
    ahead = F.coalesce(F.last("_r", ignorenulls=True).over(desc.rowsBetween(Window.unboundedPreceding, -1)),
                       F.col("_after"))
    both = both.withColumns({"_back": back, "_ahead": ahead}).where(F.col("_side") == 1)
    db, da = F.col(time) - F.col("_back.t"), F.col("_ahead.t") - F.col(time)
    pick = F.when(F.col("_ahead").isNull() | (db <= da), F.col("_back")).otherwise(F.col("_ahead"))
    both = both.withColumn("_m", pick)
    if tolerance is not None:
        both = both.withColumn("_m", F.when(F.abs(F.col("_m.t") - F.col(time)) <= tolerance, F.col("_m")))
    return both.select(*keys, time, *[F.col(f"_l.{c}").alias(c) for c in lcols],
                       F.col("_m.t").alias(f"{time}{suffix}"),
                       *[F.col(f"_m.{c}").alias(f"{c}{suffix}" if c in lcols else c) for c in values])


def fill_cell(df: DataFrame, suffix: str, columns: Sequence[str] = CELL_A) -> DataFrame:
    """Left values win; the matched side fills the gaps."""
    have = [c for c in columns if f"{c}{suffix}" in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}{suffix}")) for c in have}).drop(
        *[f"{c}{suffix}" for c in have])


def merge_log_onto_frames(frames: DataFrame, log: DataFrame, tolerance: float | None,
                          keys: Sequence[str] = RUN) -> DataFrame:
    return fill_cell(asof_nearest(frames, log, keys, tolerance=tolerance, suffix="_log"), "_log")


def merge_frames_onto_log(log: DataFrame, frames: DataFrame, keys: Sequence[str] = RUN,
                          right_order: Sequence[str] = ()) -> DataFrame:
    """The older direction: one row per log record, no tolerance, frames fill missing cells.

    A run that has only one of the two sides passes through.
    """
    out = fill_cell(asof_nearest(log, frames, keys, suffix="_snap", right_order=right_order), "_snap")
    only = frames.join(log.select(*keys).distinct(), list(keys), "left_anti")
    return out.unionByName(only, allowMissingColumns=True)


def merge_by_position(log: DataFrame, frames: DataFrame, keys: Sequence[str], log_order: Sequence[str],
                      frame_order: Sequence[str], width: float = 10_000.0) -> DataFrame:
    """Without a common time axis: n-th log record next to the n-th frame of the run.

    Positions are counted bucket by bucket of the first (numeric) order column.
    """
    def positioned(df: DataFrame, order: Sequence[str]) -> DataFrame:
        df = df.withColumn("_b", F.floor(F.col(order[0]) / width))
        return running(df, keys, "_b", order, {"_n": F.lit(1).cast("long")}).drop("_b")
    return positioned(log, log_order).join(positioned(frames, frame_order), [*keys, "_n"], "full").drop("_n")


def time_step(df: DataFrame, keys: Sequence[str], time: str = "time_ps", fallback: float = 50.0,
              threshold: float = 1.0e-12, width: float = 10_000.0) -> DataFrame:
    """Median of the positive differences between distinct times, else the fallback: keys, dt."""
    t = df.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n"))
    t = t.withColumn("_b", F.floor(F.col(time) / width))
    t = previous(t, keys, "_b", [time], {"_p": F.col(time)})
    diffs = t.groupBy(*keys, (F.col(time) - F.col("_p")).alias("_d")).agg(F.count(F.lit(1)).alias("_k"))
    good = F.when(F.col("_d") > threshold, F.col("_d"))
    return (diffs.withColumn("_d", good).groupBy(*keys)
            .agg(F.coalesce(F.expr("percentile(_d, 0.5, _k)"), F.lit(float(fallback))).alias("dt")))


RUNS_PER_BUCKET = 1024


class _Clock:
    """How the last time of a series moves over some runs, for any last time T before them: a constant below the first
    threshold, further constants below later ones, and T + shift from the last threshold on."""

    def __init__(self):
        self.cuts, self.values = np.array([-np.inf]), np.zeros(0)
        self.shift = 0.0

    def run(self, low: float, high: float, step: float) -> None:
        """Add a run behind: it starts at T + step where it would not start later than T."""
        least, shift = low - 1.0e-9, step + (high - low)
        self.values = np.where(self.values >= least, self.values + shift, high)
        at = least - self.shift
        if at > self.cuts[-1]:                      # part of the shifted range becomes a constant
            self.cuts, self.values = np.append(self.cuts, at), np.append(self.values, high)
        self.shift += shift
        keep = np.append(np.ones(min(1, len(self.values)), bool), self.values[1:] != self.values[:-1])
        if not keep.all():                          # neighbours that became equal are one piece
            self.cuts, self.values = np.append(self.cuts[:-1][keep], self.cuts[-1]), self.values[keep]


def _last_time(cuts: list[float], values: list[float], shift: float, last: float) -> float:
    k = bisect.bisect_right(cuts, last) - 1
    return last + shift if k == len(values) else values[k]


def _clocks(runs: pa.Table) -> pa.Table:
    clock = _Clock()
    for r in runs.sort_by("run").select(["lo", "hi", "dt"]).to_pylist():
        clock.run(r["lo"], r["hi"], r["dt"])
    return pa.table({"series": runs["series"][:1], "part": runs["part"][:1], "cuts": [clock.cuts.tolist()],
                     "vals": [clock.values.tolist()], "shift": [clock.shift]})


def _offsets(runs: pa.Table) -> pa.Table:
    runs = runs.sort_by("run")
    last, out = runs["last"][0].as_py(), []
    for r in runs.select(["lo", "hi", "dt"]).to_pylist():
        off = last + r["dt"] - r["lo"] if r["lo"] <= last + 1.0e-9 else 0.0
        last = r["hi"] + off
        out.append(off)
    return pa.table({"series": runs["series"], "run": runs["run"], "off": out})


def stitch(df: DataFrame, series: str = "series", run: str = "run_index", time: str = "time_ps",
           fallback: float = 50.0, join_time: bool = True, bucket: int = RUNS_PER_BUCKET) -> DataFrame:
    """Shift continuation runs so that time keeps growing.

    A run that would start at or before the end of the previous one begins one of its own time
    steps later. Adds time_ps_local and time_offset_ps. What a bucket of runs does to any earlier end is a piecewise map;
    the maps are followed bucket by bucket, and the runs of each bucket are then placed by themselves.
    """
    if not join_time:
        return df.withColumns({"time_ps_local": F.col(time), "time_offset_ps": F.lit(0.0)})
    spans = (df.groupBy(series, run).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
             .join(time_step(df, [series, run], time, fallback), [series, run]).where("lo IS NOT NULL")
             .select(F.col(series).alias("series"), F.col(run).alias("run"), F.floor(F.col(run) / bucket).alias("part"), "lo", "hi", "dt"))
    spans = stage(spans, "spans")           # a row a run, looked at twice
    kinds = {c: spans.schema[c].dataType.simpleString() for c in ("series", "run")}
    clocks = spans.groupBy("series", "part").applyInArrow(
        _clocks, f"series {kinds['series']}, part bigint, cuts array<double>, vals array<double>, shift double")

    def follow(r: dict, last: float) -> tuple[dict, float]:
        return {"part": r["part"], "last": last}, _last_time(r["cuts"], r["vals"], r["shift"], last)

    ends = fold(clocks, ["series"], ["part"], float("-inf"), follow, "part bigint, last double")
    offsets = (spans.join(ends, ["series", "part"]).groupBy("series", "part")
               .applyInArrow(_offsets, f"series {kinds['series']}, run {kinds['run']}, off double").toDF(series, run, "time_offset_ps"))
    return df.join(offsets, [series, run]).withColumns({
        "time_ps_local": F.col(time), time: F.col(time) + F.col("time_offset_ps")})


def refresh(df: DataFrame, mass_g_mol: Column | None = None,
            counts: dict[str, Column] | None = None) -> DataFrame:
    """Volume from the cell, then density and one concentration per entity count."""
    out = df.withColumn("volume_A3", F.expr(C.cell_volume(*CELL_A)))
    for token, n in (counts or {}).items():
        out = out.withColumns({f"count_{token}": n, f"concentration_{token}_mol_dm3":
                               X.concentration_mol_dm3(n, F.col("volume_A3"))})
    if mass_g_mol is not None:
        out = out.withColumns({"system_mass_g_mol": mass_g_mol,
                               "density_g_cm3": X.density_g_cm3(mass_g_mol, F.col("volume_A3"))})
    return out


def cumulative_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                     time: str = "time_ps", width: float = 10_000.0) -> DataFrame:
    """Expanding, NULL-skipping mean of each column as ``<column>_cumavg``, bucket by bucket."""
    have = [c for c in columns if c in df.columns]
    out = df.withColumn("_b", F.floor(F.col(time) / width))
    sums = {f"_s_{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in have}
    sums |= {f"_n_{c}": F.col(c).isNotNull().cast("long") for c in have}
    out = with_carry(out, keys, "_b", order, sums=sums)
    w = (Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cum = {}
    for c in have:
        total = F.col(f"_s_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0.0))
        n = F.col(f"_n_{c}") + F.count(c).over(w)
        cum[f"{c}_cumavg"] = F.when(n > 0, total / n)
    return out.withColumns(cum).drop("_b", *sums)


def summary(df: DataFrame, series: str, order: Sequence[str], measures: Sequence[str],
            counts: Sequence[str] = (), time: str = "time_ps") -> DataFrame:
    """Per series: points, time range, and mean, std and last running mean of each measure."""
    key = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("n_points"), F.min(time).alias("time_min_ps"),
            F.max(time).alias("time_max_ps")]
    for c in counts:
        aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"{c}_first"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    for c in measures:
        if c in df.columns:
            aggs += [F.avg(c).alias(f"{c}_mean"),
                     F.when(F.count(c) >= 2, F.stddev_samp(c)).alias(f"{c}_std")]
            if f"{c}_cumavg" in df.columns:
                v = F.col(f"{c}_cumavg")
                aggs.append(F.max_by(v, F.when(v.isNotNull(), key)).alias(f"{c}_last_cumavg"))
    return df.groupBy(series).agg(*aggs)


def inconsistent_counts(counts: DataFrame, series: str = "series") -> DataFrame:
    """Series whose continuation runs disagree on an entity count (series, token, n_values)."""
    return (counts.groupBy(series, "token").agg(F.count_distinct("n").alias("n_values"))
            .where(F.col("n_values") > 1))


def system_mass(atoms: DataFrame, masses: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Mass per trajectory from an (atom_type, mass) table.

    A type without a mass is an error, or is left out with ``skip_missing`` and listed in
    ``missing_types``.
    """
    per_type = atoms.groupBy("traj", "atom_type").agg(F.count(F.lit(1)).alias("n"))
    j = per_type.join(masses.select("atom_type", "mass"), "atom_type", "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("mass").isNull(), F.col("atom_type"))))
    out = j.groupBy("traj").agg(F.sum(F.col("mass") * F.col("n")).alias("system_mass_g_mol"),
                                F.sum("n").alias("n_atoms"), missing.alias("missing_types"))
    if skip_missing:
        return out
    bad = F.raise_error(F.concat(F.lit("atom types without a mass: "), F.array_join(
        F.transform("missing_types", lambda t: t.cast("string")), ","))).cast("double")
    return out.withColumn("system_mass_g_mol", F.when(F.size("missing_types") > 0, bad)
                          .otherwise(F.col("system_mass_g_mol")))
