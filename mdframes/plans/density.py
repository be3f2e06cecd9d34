"""Density and concentration flow: snapshots and logs of stitched continuation runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.operators import molecules as M
from mdframes.operators import timeseries as TS
from mdframes.operators.selection import EntitySelection
from mdframes.staging import stage


@dataclass(frozen=True)
class Density:
    series: DataFrame
    summary: DataFrame
    inventory: DataFrame
    selections: DataFrame
    inconsistent: DataFrame


def density(frames: DataFrame, log: DataFrame, atoms: DataFrame, selections: Sequence[EntitySelection],
            masses: DataFrame | None = None, interval_ps: float = 50.0, tolerance_ps: float | None = None,
            join_time: bool = True) -> Density:
    """One row per snapshot with the nearest log record, volume, density and concentrations.

    ``frames``: series, run_index, time_ps and cell (``a_A`` .. ``gamma_deg``); ``log``: series,
    run_index, time_ps and measures; ``atoms``: the topology of each series and run with columns
    traj (``series/run_index``), atom_id, name, atom_type, bonds. Types asked for must exist, and
    entity counts must agree between the runs of a series.
    """
    tol = interval_ps / 2.0 + 1.0e-9 if tolerance_ps is None else tolerance_ps
    lacking = M.missing_types(atoms, selections).limit(1).collect()
    if lacking:
        raise ValueError(f"selection {lacking[0]['token']!r} asks for missing atom type {lacking[0]['atom_type']}")
    mols = stage(atoms.join(M.components(atoms, M.bond_edges(atoms)), ["traj", "atom_id"]), "mols")
    run = F.split("traj", "/")
    counts = M.entity_counts(mols, selections).select(
        run[0].alias("series"), run[1].cast("int").alias("run_index"), "token", "n")
    inconsistent = TS.inconsistent_counts(counts)
    tokens = [s.token for s in selections]
    wide = counts.groupBy("series", "run_index").pivot("token", tokens).agg(F.first("n"))
    merged = stage(TS.merge_log_onto_frames(frames, log, tol), "merged")
    df = TS.stitch(merged, fallback=interval_ps, join_time=join_time)
    df = df.join(wide.withColumnsRenamed({t: f"_n_{t}" for t in tokens}), TS.RUN, "left")
    mass = None
    if masses is not None:
        system = TS.system_mass(mols, masses).select(run[0].alias("series"), run[1].cast("int").alias("run_index"),
                                                     F.col("system_mass_g_mol").alias("_mass"))
        df = df.join(system, TS.RUN, "left")
        mass = F.col("_mass")
    df = TS.refresh(df, mass, {t: F.col(f"_n_{t}") for t in tokens}).drop("_mass", *[f"_n_{t}" for t in tokens])
    df = stage(df, "df")
    measures = [*TS.MEASURES, *[f"concentration_{t}_mol_dm3" for t in tokens]]
    out = TS.cumulative_means(df, ["series"], ["time_ps", "run_index"], measures)
    summary = TS.summary(out, "series", ["time_ps", "run_index"], measures, [f"count_{t}" for t in tokens])
    meta = F.array(*[F.struct(F.lit(s.label).alias("label"), F.lit(s.token).alias("token"), F.lit(s.mode).alias("count_mode"),
                              F.lit(",".join(map(str, s.atom_types))).alias("atom_types"), F.lit(s.match).alias("molecule_match"))
                     for s in selections])
    listed = (counts.select("series", "run_index").distinct().withColumn("m", F.explode(meta)).select("series", "run_index", "m.*")
              .join(counts.withColumnRenamed("n", "entity_count"), ["series", "run_index", "token"], "left"))
    return Density(out, summary, M.type_inventory(mols), listed, inconsistent)
