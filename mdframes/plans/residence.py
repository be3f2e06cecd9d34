"""Residence-time flow: cutoffs from g(r), contact events, survival curves, relaxation fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.operators import contacts as K
from mdframes.operators import relaxation as R
from mdframes.operators import selection as SEL
from mdframes.operators import structure as S
from mdframes.operators.neighbors import attach_cell, molecule_distances, radius_pairs
from mdframes.sources.pdb import Trajectory
from mdframes.staging import stage


@dataclass(frozen=True)
class Residence:
    """All result tables of one target."""
    cutoffs: DataFrame
    rdf: DataFrame
    events: DataFrame
    coordination: DataFrame
    correlations: DataFrame
    relaxation: DataFrame
    summary: DataFrame


def residence(t: Trajectory, cation: str, target: SEL.Target, contact_elements: Sequence[str], dt: float,
              r_on: float | None = None, r_off: float | None = None, hysteresis: float = 0.30,
              rmax: float = 8.0, bins: int = 180, bandwidth: float = 0.08, samples: int = 200,
              max_lag: int | None = None, anchor_field: str = "atom_type") -> Residence:
    """Contacts of ``cation`` atoms with the molecules of ``target``, whose first value stands in an
    anchor atom's ``anchor_field``. A trajectory without cations or anchors is an error.

    Without ``r_on`` every trajectory gets its own, the first minimum of its smoothed g(r). One whose g(r) has none
    stands in ``cutoffs`` and ``summary`` with the reason as ``cutoff_source`` and NULL for what a cutoff decides; the
    others do not depend on it.
    """
    if r_on is not None and r_off is not None and r_off < r_on:
        raise ValueError("r_off must not be below r_on")
    mols = SEL.molecules_by_anchor(t.atoms, target.values[0], contact_elements, anchor_field)
    chosen = SEL.lacking(SEL.by_key(t.atoms, cation), t.atoms.select("traj").distinct(), ["traj"],
                         f"cation selector {cation!r} matched no atoms in", "traj")
    role = (chosen.select("traj", "atom_id", F.lit("cation").alias("site"),
                                               F.lit(None).cast("bigint").alias("mol_id"))
            .unionByName(mols.select("traj", "atom_id", F.lit("contact").alias("site"), "mol_id")))
    pos = stage(attach_cell(t.positions.join(role, ["traj", "atom_id"]), t.frames), "pos")
    plain = pos.drop("mol_id")
    dr = rmax / bins
    g = S.rdf_sampled(plain, "cation", "contact", rmax, bins, samples).select("traj", "bin", "r", "g")
    auto = r_on is None
    rdf = stage(S.smooth(g, ["traj"], "g", bandwidth, dr, bins, "nearest" if auto else "reflect"), "rdf")
    lengths = t.frames.groupBy("traj").agg((F.max("frame") + 1).alias("n_frames"))
    if auto:
        found = S.first_minimum(rdf, ["traj"], "smoothed", dr)
        source = F.when(F.col("status") == "ok", "RDF_first_minimum").otherwise(F.col("status"))
        cut = found.select("traj", F.col("r_min").alias("r_on"), source.alias("cutoff_source"))
        reach = rmax + hysteresis if r_off is None else r_off
    else:
        cut = lengths.select("traj", F.lit(float(r_on)).alias("r_on"), F.lit("user").alias("cutoff_source"))
        reach = r_on + hysteresis if r_off is None else r_off
    off = F.col("r_on") + hysteresis if r_off is None else F.lit(float(r_off))
    cut = stage(cut.withColumn("r_off", off), "cut")
    known = cut.where("r_on IS NOT NULL")
    left = plain.where("site = 'cation'").drop("site")
    right = pos.where("site = 'contact'").drop("site")
    cand = molecule_distances(radius_pairs(left, right, reach, copied="left")).join(known, "traj")
    active = stage(K.activity(cand.where("r2 <= r_off*r_off"), F.col("r_on")), "active")
    events = stage(K.events(active, lengths, dt), "events")
    cations = left.join(known, "traj", "left_semi").select("traj", "frame", F.col("atom_id").alias("i"))
    coord = stage(K.coordination(active, cations), "coord")
    grid = K.lag_grid(lengths, max_lag)
    cont = K.survival_continuous(events, grid)
    inter = K.survival_intermittent(active, grid)
    km = K.kaplan_meier(events, grid)
    tables = [d.withColumn("correlation", F.lit(n)) for n, d in
              (("continuous", cont), ("intermittent", inter), ("kaplan_meier", km))]
    corr = tables[0].unionByName(tables[1]).unionByName(tables[2]).select(
        "traj", "correlation", (F.col("lag") * F.lit(float(dt))).alias("time"), F.col("survival").alias("value"))
    corr = stage(corr, "correlations")
    keys = ["traj", "correlation"]
    fits = R.fit_kww(corr.where("correlation <> 'kaplan_meier'"), keys, plateau=F.col("correlation") == "intermittent")
    mean = R.restricted_mean(corr.where("correlation = 'kaplan_meier'"), keys).select(
        *keys, F.col("status").alias("fit_status"), F.col("rmst").alias("restricted_integral"),
        F.col("survival_at_end").alias("remaining"), F.col("t_median").alias("t_half_observed"),
        F.col("t_1e").alias("t_1e_observed"))
    relax = fits.unionByName(mean, allowMissingColumns=True)
    sizes = lengths.join(mols.groupBy("traj").agg(F.count_distinct("mol_id").alias("n_molecules")), "traj").join(
        SEL.by_key(t.atoms, cation).groupBy("traj").agg(F.count(F.lit(1)).alias("n_cations")), "traj")
    areas = R.integral(corr.where("correlation <> 'kaplan_meier'"), keys)
    raw = areas.groupBy("traj").agg(
        F.max(F.when(F.col("correlation") == "continuous", F.col("integral"))).alias("continuous_integral_ns"),
        F.max(F.when(F.col("correlation") == "intermittent", F.col("integral"))).alias("intermittent_integral_raw_ns"))
    relax = stage(relax, "relaxation")
    counted = K.summary(events, active, coord, sizes.join(known, "traj", "left_semi")).drop(*[c for c in sizes.columns if c != "traj"])
    summary = sizes.join(counted, "traj", "left").join(raw, "traj", "left").join(cut, "traj").join(_fitted(relax), "traj", "left")
    return Residence(cut, rdf, events, coord, corr, relax, summary)


def _fitted(relax: DataFrame) -> DataFrame:
    """The fits and the restricted mean of each trajectory in one row, for the summary."""
    def of(kind: str, column: str, name: str):
        return F.max(F.when(F.col("correlation") == kind, F.col(column))).alias(name)

    fits = [of(k, c, f"{k}_{n}") for k in ("continuous", "intermittent")
            for c, n in (("fit_status", "fit_status"), ("tau", "tau_ns"), ("beta", "beta"), ("plateau", "plateau"), ("tau_mean", "kww_mean_ns"))]
    return relax.groupBy("traj").agg(*fits, of("kaplan_meier", "fit_status", "km_status"),
                                     of("kaplan_meier", "restricted_integral", "km_rmst_ns"))


@dataclass(frozen=True)
class TwoTargets:
    """Both targets of one cation, and how often each pair of coordination numbers occurs."""
    anion: Residence
    solvent: Residence
    states: DataFrame


def two_targets(t: Trajectory, cation: str, anion: SEL.Target, solvent: SEL.Target, contact_elements: Sequence[str], dt: float,
                **options) -> TwoTargets:
    """``residence`` of an anion and a solvent with the same options, and their joint coordination states."""
    a = residence(t, cation, anion, contact_elements, dt, **options)
    s = residence(t, cation, solvent, contact_elements, dt, **options)
    return TwoTargets(a, s, K.joint_states(a.coordination, s.coordination))
