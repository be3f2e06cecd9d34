"""Transport flow: unwrap, drift, centres of mass, conductivity decomposition, transference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.functions import cell as C
from mdframes.operators import dynamics as D
from mdframes.operators import selection as SEL
from mdframes.operators import transport as TR
from mdframes.sources.pdb import Trajectory
from mdframes.staging import stage


MIN_FRAMES = 10


@dataclass(frozen=True)
class Transport:
    particles: DataFrame
    curves: DataFrame
    sigma: DataFrame
    check: DataFrame
    running: DataFrame
    transference: DataFrame
    blocks: DataFrame | None
    block_running: DataFrame | None
    solvent: DataFrame | None


def transport(t: Trajectory, targets: Sequence[SEL.Target], temperature: DataFrame, dt: float, max_lag: int,
              fit: tuple[float, float], solvent: SEL.Target | None = None, drift: str = "all",
              mass_weighted: bool = True, unwrap: bool = True, discard: int = 0, stride: int = 1,
              n_blocks: int = 5, min_points: int = 8) -> Transport:
    """Full analysis of charged species. ``temperature``: traj, temperature_K.

    ``drift`` removes the motion of all atoms, of the ``selected`` ones, or of ``none``.
    """
    if drift not in ("all", "selected", "none"):
        raise ValueError("drift is all, selected or none")
    charged = {sign: next((x for x in targets if (x.charge or 0.0) * sign > 0), None) for sign in (1, -1)}
    if None in charged.values():
        raise ValueError("one species with a positive and one with a negative charge are needed")
    frames = D.select_frames(t.frames, discard, stride)
    pos = D.select_frames(t.positions, discard, stride)
    frames = SEL.require(frames, frames.groupBy("traj").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < MIN_FRAMES),
                         "too few frames left in", "traj")
    members = SEL.build_species(t.atoms, targets)
    every = members if solvent is None else members.unionByName(SEL.build_species(t.atoms, [solvent], minimum=1))
    if drift != "all":
        pos = pos.join(every.select("traj", "atom_id").distinct(), ["traj", "atom_id"], "left_semi")
    pos = pos.join(frames.select("traj", "frame", "a", "b", "c"), ["traj", "frame"])
    if unwrap:
        pos = D.unwrap(pos)
    pos = stage(pos.select("traj", "frame", "atom_id", "x", "y", "z"), "pos")
    parts = SEL.particles(pos, every)
    if drift != "none":
        heavy = pos.join(t.atoms.select("traj", "atom_id", "mass"), ["traj", "atom_id"])
        parts = D.remove_drift(parts, heavy, F.col("mass") if mass_weighted else None)
    parts = stage(parts, "parts")
    volume = frames.groupBy("traj").agg(F.expr(f"avg({C.orthorhombic_volume()})").alias("volume_A3"))
    need = F.raise_error(F.lit("a valid cell is required for conductivity")).cast("double")
    system = volume.withColumn("volume_A3", F.when(F.col("volume_A3").isNull(), need).otherwise(F.col("volume_A3"))).join(
        temperature, "traj")
    species = [(x.label, float(x.charge or 0.0)) for x in targets]
    dt_eff = dt * stride
    curves = stage(TR.onsager_curves(TR.term_sums(parts, species, max_lag), species, dt_eff), "curves")
    sigma = TR.sigma_table(curves, system, *fit)
    running = TR.running_sigma(curves, system, fit[0], min_points)
    plus, minus = ((charged[s].label, float(charged[s].charge)) for s in (1, -1))
    ions = parts.where(F.col("label").isin(plus[0], minus[0]))
    refs = ions.withColumn("ref", F.lit("barycentric"))
    sol = None
    if solvent is not None:
        shift = D.mean_position(parts.where(F.col("label") == solvent.label))
        refs = refs.unionByName(D.subtract(ions, shift).withColumn("ref", F.lit("solvent_fixed")))
        sol = TR.solvent_curves(parts, solvent.label, max_lag, dt_eff)
    refs = stage(refs, "refs")
    both = [plus, minus]
    pair = stage(TR.pair_curves(TR.term_sums(refs, both, max_lag, ["traj", "ref"]), plus[0], minus[0], dt_eff), "pair")
    tn = TR.transference_running(pair, ["traj", "ref"], fit[0], min_points, plus[1], minus[1])
    blocks = block_running = None
    if n_blocks >= 2:
        cut = TR.into_blocks(refs, n_blocks, max(10, min_points + 2))
        s = TR.term_sums(cut, both, max_lag, ["traj", "ref", "block"])
        in_block = stage(TR.pair_curves(s, plus[0], minus[0], dt_eff), "in_block")
        per = ["traj", "ref", "block"]
        blocks = TR.transference_fit(in_block, per, *fit, plus[1], minus[1])
        block_running = TR.running_block_error(
            TR.transference_running(in_block, per, fit[0], min_points, plus[1], minus[1]), n_blocks)
    return Transport(parts, curves, sigma, TR.sigma_check(sigma), running, tn, blocks, block_running, sol)


def diffusion(t: Trajectory, targets: Sequence[SEL.Target], temperature: DataFrame, dt: float, max_lag: int,
              fit: tuple[float | None, float | None] = (None, None)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Species MSD curves, diffusion and Nernst-Einstein rows, and system totals."""
    from mdframes.functions import scalars as X
    pos = D.unwrap(t.positions.join(t.frames.select("traj", "frame", "a", "b", "c"), ["traj", "frame"]))
    parts = stage(SEL.particles(pos, SEL.build_species(t.atoms, targets, minimum=1)), "parts")
    rows = parts.select("traj", "label", "particle_id", "frame", "x", "y", "z")
    curve = D.msd(rows, ["traj", "label"], "particle_id", max_lag, dt, clamp=True)
    n = parts.where("frame = 0").groupBy("traj", "label", "charge").agg(F.count(F.lit(1)).alias("n_particles"))
    volume = t.frames.groupBy("traj").agg(F.expr(f"avg({C.orthorhombic_volume()})").alias("volume_A3"))
    out = TR.fit_diffusion(curve, ["traj", "label"], *fit).join(n, ["traj", "label"]).join(volume, "traj", "left").join(temperature, "traj")
    out = out.withColumns(X.nernst_einstein(F.col("n_particles"), F.col("volume_A3"), F.col("D_m2_per_s"),
                                            F.col("charge"), F.col("temperature_K")))
    return D.diffusion_from_origin(curve), out, TR.system_sigma(out)
