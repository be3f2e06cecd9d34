"""Every operator as a query over the star-schema tables: name -> (spark, sf_dir) -> DataFrame.

Floating-point results are rounded at the end only, so that equal results compare equal whatever
the summation order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mdframes import views as V
from mdframes.functions import cell as C
from mdframes.functions import scalars as X
from mdframes.functions import sites as T
from mdframes.operators import contacts as K
from mdframes.operators import dynamics as D
from mdframes.operators import molecules as M
from mdframes.operators import neighbors as N
from mdframes.operators import relaxation as R
from mdframes.operators import selection as SEL
from mdframes.operators import structure as S
from mdframes.operators import timeseries as TS
from mdframes.operators import transport as TR
from mdframes.operators.scan import previous
from mdframes.plans import manifest, outputs
from mdframes.sources import logs as sources_logs
from mdframes.sources import pdb as sources_pdb
from mdframes.sources import sinks as sources_sinks
from mdframes.sources import text as sources_text
from mdframes.sources import xyz as sources_xyz
from mdframes.staging import once_per_app, stage, staged, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, **scale: float) -> DataFrame:
    """Round every double column; ``scale`` multiplies named columns first."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            # Adding 0.0 turns -0.0 into 0.0.
            c = (F.round(c * F.lit(scale.get(name, 1.0)), digits) + F.lit(0.0)).alias(name)
        cols.append(c)
    return df.select(*cols)


# Views that start from another view take it from storage.
BASE = {"positions": "walks", "triclinic_frames": "positions", "logs": "runs", "snapshots": "runs"}


def _view(name: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = [shared(spark, sf_dir, BASE[name])] if name in BASE else []
        return getattr(V, name)(spark, sf_dir, *base)
    build.__name__ = name
    return staged(build)


_VIEWS = {n: _view(n) for n in
          ("walks", "positions", "atoms", "runs", "logs", "snapshots", "bonded_atoms", "triclinic_frames")}


def shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical view as an ingested table, written once per application."""
    return _VIEWS[name](spark, sf_dir)


def cubic_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.in_cubic_box(shared(spark, sf_dir, "positions").withColumn("site", V._pick(0)))


# --- structure ----------------------------------------------------------------------------------

RMAX, RDF_BW = 6.0, 0.5
ANGLE_CUT = 5.0


@query
def rdf_frame_volume(spark, sf):
    sites = shared(spark, sf, "positions").withColumn("site", V._pick(0))
    sites = N.attach_cell(sites, shared(spark, sf, "triclinic_frames"))
    return rounded(S.rdf(sites, "Li", "O", RMAX, RDF_BW).drop("cn"))


@query
def rdf_mean_volume(spark, sf):
    return rounded(S.rdf(cubic_sites(spark, sf), "Li", "Li", RMAX, RDF_BW, "mean").drop("cn"))


@query
def rdf_cn(spark, sf):
    return rounded(S.rdf(cubic_sites(spark, sf), "Li", "O", RMAX, RDF_BW, "mean"))


@query
def rdf_uneven_frame(spark, sf):
    """A bin width that does not divide the range, with per-frame volumes."""
    sites = shared(spark, sf, "positions").withColumn("site", V._pick(0))
    sites = N.attach_cell(sites, shared(spark, sf, "triclinic_frames"))
    return rounded(S.rdf(sites, "Li", "O", RMAX, 0.7))


@query
def rdf_uneven_mean(spark, sf):
    return rounded(S.rdf(cubic_sites(spark, sf), "Li", "Li", RMAX, 0.7, "mean"))


@query
def neighbor_pairs(spark, sf):
    s = cubic_sites(spark, sf)
    p = N.radius_pairs(s.where("site = 'Li'"), s.where("site in ('N', 'O', 'S')"), 3.5)
    return rounded(p.select("traj", "frame", "i", "j", "dx", "dy", "dz", F.sqrt("r2").alias("distance")))


@query
def neighbor_pairs_fine(spark, sf):
    """A cutoff that leaves ten cells along each axis, so that most of the box is never looked at."""
    s = cubic_sites(spark, sf)
    p = N.radius_pairs(s.where("site in ('Li', 'H')"), s.where("site in ('N', 'O')"), 1.95)
    return rounded(p.select("traj", "frame", "i", "j", F.sqrt("r2").alias("distance")))


@query
def neighbor_pairs_rhombic(spark, sf):
    """Pairs in a cell whose angles are all 60 degrees."""
    fr = shared(spark, sf, "triclinic_frames").withColumns({n: F.lit(v) for n, v in
                                                          [*((c, 20.0) for c in "abc"), *((c, 60.0) for c in ("alpha", "beta", "gamma"))]})
    s = N.attach_cell(shared(spark, sf, "positions").withColumn("site", V._pick(0)), fr)
    p = N.radius_pairs(s.where("site = 'Li'"), s.where("site in ('N', 'O', 'S')"), 3.5, copied="left")
    return rounded(p.select("traj", "frame", "i", "j", "dx", "dy", "dz", F.sqrt("r2").alias("distance")))


def _contact_pairs(spark, sf, radius):
    s = cubic_sites(spark, sf)
    mol = F.floor(F.col("atom_id") / 5) * 5 + 1
    contact = s.where("site in ('N', 'O', 'S')").withColumn("mol_id", mol)
    return N.molecule_distances(N.radius_pairs(s.where("site = 'Li'"), contact, radius, copied="left"))


@query
def contact_min_distance(spark, sf):
    return rounded(_contact_pairs(spark, sf, 5.0).select("traj", "frame", "i", "mol_id", F.sqrt("r2").alias("distance")))


@query
def overlap_topk(spark, sf):
    s = cubic_sites(spark, sf).withColumn("mol_id", F.floor(F.col("atom_id") / 5)).drop("site")
    return rounded(N.short_contacts(s, 1.5, 20))


def _triplets(spark, sf, third="N", unique=False):
    return S.adf_triplets(cubic_sites(spark, sf), "O", "Li", third, ANGLE_CUT, ANGLE_CUT, unique)


@query
def adf(spark, sf):
    return rounded(S.adf(_triplets(spark, sf), 10.0, shared(spark, sf, "atoms").select("traj")))


@query
def adf_unique_terminals(spark, sf):
    return rounded(S.adf(_triplets(spark, sf, "O", True), 10.0, shared(spark, sf, "atoms").select("traj")))


@query
def adf_counters(spark, sf):
    return S.adf_counters(_triplets(spark, sf))


@query
def rdf_sampled(spark, sf):
    return rounded(S.rdf_sampled(cubic_sites(spark, sf), "Li", "O", RMAX, 30, 25).select("traj", "bin", "r", "g", "count"))


def _smoothed(spark, sf):
    g = S.rdf(cubic_sites(spark, sf), "Li", "O", RMAX, 0.2, "mean").select("traj", "bin", "r", "g")
    return S.smooth(g, ["traj"], "g", 0.4, 0.2, 30)


@query
def rdf_smooth(spark, sf):
    return rounded(_smoothed(spark, sf))


@query
def rdf_smooth_reflect(spark, sf):
    g = S.rdf(cubic_sites(spark, sf), "Li", "O", RMAX, 0.2, "mean").select("traj", "bin", "r", "g")
    return rounded(S.smooth(g, ["traj"], "g", 0.4, 0.2, 30, edge="reflect"))


@query
def first_minimum(spark, sf):
    return rounded(S.first_minimum(_smoothed(spark, sf), ["traj"], "smoothed", 0.2))


@query
def minimum_image_triclinic(spark, sf):
    """Minimum-image step of every particle between consecutive frames, in that frame's cell."""
    p = N.attach_cell(shared(spark, sf, "positions"), shared(spark, sf, "triclinic_frames"))
    nxt = shared(spark, sf, "positions").select("traj", (F.col("frame") - 1).alias("frame"), "atom_id",
                                                *[F.col(n).alias(f"t{n}") for n in "xyz"])
    j = p.join(nxt, ["traj", "frame", "atom_id"])
    out = C.minimum_image(j, "tx - x", "ty - y", "tz - z", ("dx", "dy", "dz"))
    return rounded(out.select("traj", "frame", "atom_id", "dx", "dy", "dz"))


@query
def cell_volume(spark, sf):
    fr = shared(spark, sf, "triclinic_frames").withColumn("orthorhombic", F.expr(C.is_orthorhombic()))
    return rounded(C.with_cell_matrix(fr).select("traj", "frame", "volume", *C.MATRIX, "orthorhombic"))


# --- dynamics and transport ---------------------------------------------------------------------

MAX_LAG = 60
FIT = (1.0, 8.0)
SPECIES = [("Li", 1.0), ("FSA", -1.0)]
TARGETS = [SEL.Target("Li", ("Li",), 1.0, "element"), SEL.Target("FSA", ("FSA",), -1.0, "residues"),
           SEL.Target("SOL", ("SOL",), 0.0, "residues")]


@query
def unwrap(spark, sf):
    p = shared(spark, sf, "positions").withColumns({n: F.lit(V.BOX) for n in "abc"})
    return rounded(D.unwrap(p).select("traj", "frame", "atom_id", "x", "y", "z"))


@staged
def particles(spark, sf):
    return SEL.particles(shared(spark, sf, "walks"), SEL.build_species(shared(spark, sf, "atoms"), TARGETS))


@query
def com(spark, sf):
    return rounded(particles(spark, sf).where("label = 'FSA'").select("traj", "frame", "particle_id", "x", "y", "z"))


def _drifted(spark, sf):
    walks = shared(spark, sf, "walks").join(shared(spark, sf, "atoms").select("traj", "atom_id", "mass"), ["traj", "atom_id"])
    return D.remove_drift(particles(spark, sf), walks, F.col("mass"))


@query
def drift_removed(spark, sf):
    return rounded(_drifted(spark, sf).select("traj", "frame", "label", "particle_id", "x", "y", "z"))


@query
def msd_species(spark, sf):
    p = particles(spark, sf).select("traj", "label", "particle_id", "frame", "x", "y", "z")
    return rounded(D.diffusion_from_origin(D.msd(p, ["traj", "label"], "particle_id", MAX_LAG, V.DT_NS, clamp=True))
                   .select("traj", "label", "lag", "time", "msd", "n", "D_A2_per_ns", "D_1e5_cm2_per_s"), 5)


@query
def msd_lag_join(spark, sf):
    """The declarative lag self join, over the true paths of single atoms."""
    out = D.lag_join(shared(spark, sf, "walks"), ["traj"], "atom_id", MAX_LAG)
    return rounded(out.select("traj", "lag", (F.col("total") / F.col("n")).alias("msd"), "n"))


def sums(spark, sf):
    return TR.term_sums(particles(spark, sf), SPECIES, MAX_LAG)


def curves(spark, sf):
    return TR.onsager_curves(sums(spark, sf), SPECIES, V.DT_NS)


def system(spark, sf):
    """Mean valid volume and temperature of each trajectory."""
    v = shared(spark, sf, "triclinic_frames").groupBy("traj").agg(
        F.expr(f"avg({C.orthorhombic_volume()})").alias("volume_A3"))
    g = F.regexp_extract("traj", r"(\d+)", 1).cast("int")
    return v.withColumn("temperature_K", F.lit(300.0) + 30.0 * g)


@query
def mean_volume(spark, sf):
    return rounded(system(spark, sf), 5)


def _coll(spark, sf):
    s = TR.term_sums(particles(spark, sf), SPECIES, MAX_LAG)
    return s.select("traj", "term", "lag", (F.col("total") / F.col("n")).alias("value"))


@query
def msd_collective(spark, sf):
    return rounded(_coll(spark, sf).where("term like 'coll:%'"), 3)


@query
def cross_displacement(spark, sf):
    return rounded(_coll(spark, sf).where("term like 'cross:%'"), 3)


@query
def onsager_terms(spark, sf):
    return rounded(curves(spark, sf).select("traj", "term", "kind", "za", "zb", "mult", "lag", "time", "value"), 3)


def _sigma(spark, sf):
    return TR.sigma_table(curves(spark, sf), system(spark, sf), *FIT)


@query
def onsager_sigma(spark, sf):
    return rounded(_sigma(spark, sf), 5)


@query
def onsager_check(spark, sf):
    return rounded(TR.sigma_check(_sigma(spark, sf)), 4)


@query
def running_sigma(spark, sf):
    return rounded(TR.running_sigma(curves(spark, sf), system(spark, sf), FIT[0]).select(
        "traj", "term", "lag", "time", "sigma_mS_cm"), 4)


def _msd(spark, sf):
    p = particles(spark, sf).select("traj", "label", "particle_id", "frame", "x", "y", "z")
    return D.msd(p, ["traj", "label"], "particle_id", MAX_LAG, V.DT_NS, clamp=True)


@query
def diffusion_fit(spark, sf):
    return rounded(TR.fit_diffusion(_msd(spark, sf), ["traj", "label"]), 5, D_m2_per_s=1e11, D_cm2_per_s=1e7)


def _ne(spark, sf):
    fit = TR.fit_diffusion(_msd(spark, sf), ["traj", "label"])
    n = particles(spark, sf).where("frame = 0").groupBy("traj", "label", "charge").agg(F.count(F.lit(1)).alias("n_particles"))
    df = fit.join(n, ["traj", "label"]).join(system(spark, sf), "traj")
    ne = X.nernst_einstein(F.col("n_particles"), F.col("volume_A3"), F.col("D_m2_per_s"), F.col("charge"), F.col("temperature_K"))
    return df.withColumns(ne)


@query
def ne_conductivity(spark, sf):
    return rounded(_ne(spark, sf).select("traj", "label", "n_particles", "number_density_m3", "concentration_mol_L",
                                         "sigma_NE_S_m", "sigma_NE_mS_cm"), 5, number_density_m3=1e-24)


@query
def system_sigma(spark, sf):
    return rounded(TR.system_sigma(_ne(spark, sf)), 5)


@query
def diffusion_vs_temperature(spark, sf):
    """Points of the D(T), sigma(T) and log10 D against 1000/T plots, ordered by temperature."""
    df = _ne(spark, sf)
    return rounded(df.select("traj", "label", "temperature_K", (F.lit(1000.0) / F.col("temperature_K")).alias("inv_T"),
                             F.when(F.col("D_cm2_per_s") > 0, F.log10("D_cm2_per_s")).alias("log10_D"),
                             "sigma_NE_mS_cm"), 5)


@query
def arrhenius(spark, sf):
    s = _sigma(spark, sf).where("kind = 'self'").groupBy("traj").agg(F.sum("sigma_contribution_mS_per_cm").alias("sigma"))
    return rounded(TR.arrhenius(s.join(system(spark, sf), "traj"), "sigma"), 5)


def _frames_of_reference(spark, sf):
    p = particles(spark, sf)
    solvent = D.mean_position(p.where("label = 'SOL'"))
    bary = p.where("label <> 'SOL'").withColumn("ref", F.lit("barycentric"))
    fixed = D.subtract(p.where("label <> 'SOL'"), solvent).withColumn("ref", F.lit("solvent_fixed"))
    return bary.unionByName(fixed)


@query
def transference_running(spark, sf):
    s = TR.term_sums(_frames_of_reference(spark, sf), SPECIES, MAX_LAG, ["traj", "ref"])
    c = stage(TR.pair_curves(s, "Li", "FSA", V.DT_NS), "pair")
    out = TR.transference_running(c, ["traj", "ref"], FIT[0])
    return rounded(out.select("traj", "ref", "lag", "Dplus", "PFG_t_app", "eNMR_t0", "Bruce_Vincent_tss", "sigma_reduced"), 4)


N_BLOCKS = 4


def _block_estimates(spark, sf):
    b = TR.into_blocks(_frames_of_reference(spark, sf), N_BLOCKS, 10)
    s = TR.term_sums(b, SPECIES, MAX_LAG, ["traj", "ref", "block"])
    c = TR.pair_curves(s, "Li", "FSA", V.DT_NS)
    return TR.transference_fit(c, ["traj", "ref", "block"], 0.4, 3.0)


@query
def transference_blocks(spark, sf):
    return rounded(_block_estimates(spark, sf), 4)


@query
def transference_block_error(spark, sf):
    """Block mean and error of the reduced conductivity and the two diffusion slopes."""
    e = _block_estimates(spark, sf)
    parts = [TR.block_error(e, ["traj", "ref"], c, N_BLOCKS, m).select(
        "traj", "ref", F.lit(c).alias("quantity"), F.lit(m).alias("mode"), "mean", "err")
        for c, m in (("Dplus", "sem"), ("Dminus", "sd"), ("Lpp", "ci95"))]
    return rounded(functools.reduce(DataFrame.unionByName, parts), 4)


@query
def block_estimate_stats(spark, sf):
    e = _block_estimates(spark, sf).where("ref = 'solvent_fixed'")
    return rounded(TR.column_statistics(e, ["PFG_t_app", "Dplus", "Dminus"]), 4)


def _block_msd(spark, sf):
    b = TR.into_blocks(particles(spark, sf), N_BLOCKS)
    return TR.block_msd(TR.term_sums(b, SPECIES, 15, ["traj", "block"]), SPECIES, V.DT_NS, N_BLOCKS)


@query
def block_msd(spark, sf):
    return rounded(_block_msd(spark, sf), 3)


@query
def axis_range(spark, sf):
    return rounded(TR.axis_range(_block_msd(spark, sf), ["term"]), 3)


@query
def solvent_diagnostics(spark, sf):
    return rounded(TR.solvent_curves(particles(spark, sf), "SOL", MAX_LAG, V.DT_NS), 5)


@query
def solvent_diffusion(spark, sf):
    c = TR.solvent_curves(particles(spark, sf), "SOL", MAX_LAG, V.DT_NS)
    return rounded(TR.solvent_diffusion(c, ["traj"], *FIT), 5, D_cm2_per_s=1e7)


@query
def solvent_running(spark, sf):
    c = stage(TR.solvent_curves(particles(spark, sf), "SOL", MAX_LAG, V.DT_NS), "solvent")
    return rounded(TR.solvent_running(c, ["traj"], FIT[0]), 5, D_self_cm2_per_s=1e7, D_n_com_cm2_per_s=1e7)


@query
def solvent_blocks(spark, sf):
    b = TR.into_blocks(particles(spark, sf), N_BLOCKS)
    c = TR.solvent_curves(b, "SOL", 15, V.DT_NS, ["traj", "block"])
    a = TR.block_error(c, ["traj", "lag"], "self_msd", N_BLOCKS).withColumnsRenamed({"mean": "self_mean", "err": "self_err"})
    m = TR.block_error(c, ["traj", "lag"], "com_msd", N_BLOCKS).withColumnsRenamed({"mean": "com_mean", "err": "com_err"})
    return rounded(a.join(m, ["traj", "lag"]), 4)


# --- contacts -----------------------------------------------------------------------------------

R_ON, R_OFF = 6.0, 8.0


def lengths(spark, sf):
    return shared(spark, sf, "positions").groupBy("traj").agg((F.max("frame") + 1).alias("n_frames"))


@staged
def active(spark, sf):
    return K.activity(_contact_pairs(spark, sf, R_OFF), R_ON)


@staged
def contacts(spark, sf):
    return K.events(active(spark, sf), lengths(spark, sf), V.DT_NS)


@query
def contact_events(spark, sf):
    return rounded(contacts(spark, sf))


def _solvent_active(spark, sf):
    s = cubic_sites(spark, sf)
    sol = s.where("site = 'H'").withColumn("mol_id", F.col("atom_id"))
    return K.activity(N.molecule_distances(N.radius_pairs(s.where("site = 'Li'"), sol, R_OFF)), R_ON)


def _cations(spark, sf):
    return shared(spark, sf, "positions").where(F.col("atom_id") % 5 == 0).select("traj", "frame", F.col("atom_id").alias("i"))


@query
def coordination_states(spark, sf):
    cat = _cations(spark, sf)
    return rounded(K.joint_states(K.coordination(active(spark, sf), cat), K.coordination(_solvent_active(spark, sf), cat)))


@query
def residence_summary(spark, sf):
    kinds = shared(spark, sf, "atoms").groupBy("traj").agg(
        F.count_if(F.col("element") == "Li").alias("n_cations"),
        F.count_distinct(F.when(F.col("resname") == "FSA", F.col("resid"))).alias("n_molecules"))
    sizes = lengths(spark, sf).join(kinds, "traj")
    coord = K.coordination(active(spark, sf), _cations(spark, sf))
    return rounded(K.summary(contacts(spark, sf), active(spark, sf), coord, sizes))


@query
def survival_continuous(spark, sf):
    return rounded(K.survival_continuous(contacts(spark, sf), K.lag_grid(lengths(spark, sf))))


@query
def survival_intermittent(spark, sf):
    return rounded(K.survival_intermittent(active(spark, sf), K.lag_grid(lengths(spark, sf))))


def _km(spark, sf):
    return K.kaplan_meier(contacts(spark, sf), K.lag_grid(lengths(spark, sf)))


@query
def survival_km(spark, sf):
    return rounded(_km(spark, sf))


def _timed(df):
    return df.select("traj", (F.col("lag") * V.DT_NS).alias("time"), F.col("survival").alias("value"))


@query
def km_rmst(spark, sf):
    return rounded(R.restricted_mean(_timed(_km(spark, sf)), ["traj"]))


@query
def correlation_integrals(spark, sf):
    """Trapezoid integral of the continuous and of the intermittent survival curve."""
    g = K.lag_grid(lengths(spark, sf))
    a = _timed(K.survival_continuous(contacts(spark, sf), g)).withColumn("curve", F.lit("continuous"))
    b = _timed(K.survival_intermittent(active(spark, sf), g)).withColumn("curve", F.lit("intermittent"))
    return rounded(R.integral(a.unionByName(b), ["traj", "curve"]))


@query
def kww_fit(spark, sf):
    """Stretched-exponential fit of the continuous and the intermittent curve."""
    g = K.lag_grid(lengths(spark, sf))
    a = _timed(K.survival_continuous(contacts(spark, sf), g)).withColumn("curve", F.lit("continuous"))
    b = _timed(K.survival_intermittent(active(spark, sf), g)).withColumn("curve", F.lit("intermittent"))
    return rounded(R.fit_kww(a.unionByName(b), ["traj", "curve"], plateau=F.col("curve") == "intermittent"), 4)


# --- run logs and time series ---------------------------------------------------------------------

ENTITIES = [SEL.EntitySelection("Li", (10, 11)), SEL.EntitySelection("chains", (20, 31), "molecule", "all"),
            SEL.EntitySelection("any chain", (20, 31), "molecule", "any")]
MASS_G_MOL = 4800.0


@staged
def _merged(spark, sf):
    return TS.merge_log_onto_frames(shared(spark, sf, "snapshots"), shared(spark, sf, "logs"), tolerance=3.0)


@query
def log_asof(spark, sf):
    return rounded(_merged(spark, sf).select("series", "run_index", "o_orderkey", "time_ps", "time_ps_log", "a_A",
                                             "potential_kcal_mol", "kinetic_kcal_mol"), 4)


@query
def log_asof_left_log(spark, sf):
    log = shared(spark, sf, "logs")
    out = TS.merge_frames_onto_log(log, shared(spark, sf, "snapshots").withColumnRenamed("o_orderkey", "snap_key"),
                                   right_order=["snap_key"])
    return rounded(out.select("series", "run_index", "time_ps", "time_ps_snap", "snap_key", "a_A", "kinetic_kcal_mol"), 4)


@query
def merge_by_position(spark, sf):
    log = shared(spark, sf, "logs").select("series", "run_index", F.col("time_ps").alias("log_time"))
    snap = (shared(spark, sf, "snapshots").where("a_A is not null")
            .select("series", "run_index", "o_orderkey", F.col("time_ps").alias("snap_time")))
    return TS.merge_by_position(log, snap, TS.RUN, ["log_time"], ["snap_time", "o_orderkey"])


def _stitched(spark, sf):
    return TS.stitch(_merged(spark, sf))


@query
def stitched_series(spark, sf):
    return rounded(_stitched(spark, sf).select("series", "run_index", "o_orderkey", "time_ps_local", "time_offset_ps", "time_ps"))


@staged
def _derived(spark, sf):
    return TS.refresh(_stitched(spark, sf), F.lit(MASS_G_MOL), {"Li": F.lit(12)})


@query
def density_concentration(spark, sf):
    return rounded(_derived(spark, sf).select("series", "run_index", "o_orderkey", "volume_A3", "density_g_cm3",
                                              "count_Li", "concentration_Li_mol_dm3"))


SERIES_ORDER = ["time_ps", "run_index", "o_orderkey"]


def _means(spark, sf):
    return TS.cumulative_means(_derived(spark, sf), ["series"], SERIES_ORDER,
                               [*TS.MEASURES, "concentration_Li_mol_dm3"])


@query
def cumulative_means(spark, sf):
    return rounded(_means(spark, sf).select("series", "run_index", "o_orderkey", "kinetic_kcal_mol_cumavg", "a_A_cumavg",
                                            "volume_A3_cumavg", "density_g_cm3_cumavg",
                                            "concentration_Li_mol_dm3_cumavg"), 4)


@query
def series_summary(spark, sf):
    out = TS.summary(_means(spark, sf), "series", SERIES_ORDER,
                     ["kinetic_kcal_mol", "a_A", "volume_A3", "density_g_cm3"], ["count_Li"])
    return rounded(out.withColumn("target_temperature_K", T.series_temperature(F.col("series"))), 4)


@query
def time_step(spark, sf):
    return rounded(TS.time_step(shared(spark, sf, "snapshots"), TS.RUN))


@query
def kinetic_temperature(spark, sf):
    log = shared(spark, sf, "logs").where("kinetic_kcal_mol is not null")
    return rounded(log.select("series", "run_index", "time_ps", X.kinetic_temperature(
        F.col("kinetic_kcal_mol"), F.lit(3 * 400 - 3)).alias("temperature_K")))


@query
def system_mass(spark, sf):
    masses = spark.createDataFrame([(s[4], s[1]) for s in V.SITES], "atom_type int, mass double")
    return rounded(TS.system_mass(shared(spark, sf, "atoms"), masses).drop("missing_types"))


@query
def system_mass_skip(spark, sf):
    masses = spark.createDataFrame([(s[4], s[1]) for s in V.SITES[:4]], "atom_type int, mass double")
    out = TS.system_mass(shared(spark, sf, "atoms"), masses, skip_missing=True)
    return rounded(out.withColumn("missing_types", F.array_join(F.col("missing_types").cast("array<string>"), ",")))


@query
def box_length(spark, sf):
    """Cubic box edge that holds each trajectory's mass at 1.2 g/cm3."""
    m = shared(spark, sf, "atoms").groupBy("traj").agg(F.sum("mass").alias("mass"))
    return rounded(m.select("traj", X.box_length(F.col("mass"), F.lit(1.2)).alias("box_A")), 5)


# --- molecules and topology -------------------------------------------------------------------------


@staged
def molecule_atoms(spark, sf):
    a = shared(spark, sf, "bonded_atoms")
    return a.join(M.components(a, M.bond_edges(a)), ["traj", "atom_id"])


@query
def bond_edges(spark, sf):
    return M.bond_edges(shared(spark, sf, "bonded_atoms")).drop("traj")


@query
def invalid_bonds(spark, sf):
    """Bonds to atoms that are not there, after every seventh atom got one."""
    a = shared(spark, sf, "bonded_atoms")
    bad = a.withColumn("bonds", F.when(F.col("atom_id") % 7 == 0, F.array_append("bonds", -F.col("atom_id") - 1)).otherwise(F.col("bonds")))
    return M.invalid_bonds(bad).select("atom_id", "other")


@query
def components(spark, sf):
    return molecule_atoms(spark, sf).select("atom_id", "mol_id")


@query
def entity_counts(spark, sf):
    return M.entity_counts(molecule_atoms(spark, sf), ENTITIES).drop("traj")


@query
def count_consistency(spark, sf):
    """Entity counts per run; series whose runs disagree."""
    runs = shared(spark, sf, "runs")
    o = runs.groupBy("series", "run_index").agg(F.count_distinct("o_orderstatus").alias("n"))
    agree = o.select("series", "run_index", F.lit("status").alias("token"), "n")
    m = runs.groupBy("series", "run_index").agg(F.count(F.lit(1)).alias("n"))
    return TS.inconsistent_counts(agree.unionByName(m.select("series", "run_index", F.lit("orders").alias("token"), "n")))


@query
def type_inventory(spark, sf):
    return M.type_inventory(molecule_atoms(spark, sf)).drop("traj")


@query
def missing_types(spark, sf):
    sel = [SEL.EntitySelection("odd", (10, 99, 53)), SEL.EntitySelection("fine", (20,))]
    return M.missing_types(shared(spark, sf, "bonded_atoms"), sel).drop("traj")


@query
def topology_check(spark, sf):
    """Frames whose atoms or bonds differ from the first frame: one order year is one frame.

    The same atoms are replayed in every frame; a frame in which a customer's order changed status
    has one atom type changed.
    """
    o = V.read(spark, sf, "orders")
    base = shared(spark, sf, "bonded_atoms")
    frames = o.select(F.year("o_orderdate").cast("bigint").alias("frame")).distinct()
    top = o.groupBy(F.year("o_orderdate").cast("bigint").alias("frame")).agg(F.max("o_orderkey").alias("k"))
    odd = top.where(F.col("frame") % 2 == 0)
    replay = base.withColumn("frame", F.explode(F.expr("sequence(1990L, 2010L)")))
    replay = replay.join(F.broadcast(frames.where("frame between 1990 and 2010")), "frame")       # at most 21 years
    flip = replay.join(F.broadcast(odd.where("frame between 1990 and 2010").withColumnRenamed("k", "atom_id").withColumn("_x", F.lit(1))), ["frame", "atom_id"], "left")
    flip = flip.withColumn("atom_type", F.col("atom_type") + F.coalesce("_x", F.lit(0))).drop("_x")
    return M.changed_frames(flip).select("frame", "n_atoms", "n_atoms_first")


@query
def retag(spark, sf):
    """New types by molecule formula and bonded element."""
    a = molecule_atoms(spark, sf).withColumnRenamed("name", "element")
    rules = [("Li1", "Li", None, 906), ("N1S1", "N", "S", 972), ("N1S1", "N", None, 973), ("N1S1", "S", None, 974),
             ("H1Li1", "H", "Li", 971)]
    r = spark.createDataFrame(rules, "formula string, element string, neighbour string, new_type int")
    edges = M.bond_edges(shared(spark, sf, "bonded_atoms"))
    return M.retag(a, edges, r).drop("traj")


@query
def topology_summary(spark, sf):
    return M.topology_summary(shared(spark, sf, "atoms"))


@query
def residue_summary(spark, sf):
    return M.residue_summary(shared(spark, sf, "atoms"))


# --- selection ------------------------------------------------------------------------------------


@query
def select_species(spark, sf):
    return SEL.build_species(shared(spark, sf, "atoms"), TARGETS).drop("mass", "single")


@query
def select_species_by_type(spark, sf):
    t = SEL.parse_species(["Li:6:1", "NO:72;81:-1"], "types") + SEL.parse_species(["mol:164:-1"], "marker")
    return SEL.build_species(shared(spark, sf, "atoms"), t).drop("mass", "single")


@query
def select_molecules(spark, sf):
    a = shared(spark, sf, "atoms")
    one = SEL.molecules_by_anchor(a, 72, ["O", "S"]).withColumn("target", F.lit("anion"))
    two = SEL.molecules_by_anchor(a, 71, ["Xe"]).withColumn("target", F.lit("solvent"))
    return one.unionByName(two)


@query
def select_atoms(spark, sf):
    """Equality on any name, ion lists, element with name fallback, anion groups."""
    a = shared(spark, sf, "atoms")
    parts = {"key": SEL.by_key(a, "fsa"), "ion": SEL.ions(a, "Li", names=["H"], resnames=["none"]),
             "element": SEL.element_or_prefix(a, "O"), "group": SEL.anion_groups(a, ["XXX"], ("S", "N", "O"))}
    out = [d.select(F.lit(k).alias("rule"), "traj", "atom_id") for k, d in parts.items()]
    return functools.reduce(DataFrame.unionByName, out)


@query
def frame_range(spark, sf):
    fr = shared(spark, sf, "positions").select("traj", "frame").distinct()
    a = SEL.frame_range(fr, start_ratio=0.25, stride=3).withColumn("rule", F.lit("ratio"))
    b = SEL.frame_range(fr, start_frame=-20, stop=-2, stride=4).withColumn("rule", F.lit("negative"))
    return a.unionByName(b)


@query
def even_frames(spark, sf):
    return S.even_frames(shared(spark, sf, "positions").select("traj", "frame"), 25)


@query
def select_frames(spark, sf):
    p = D.select_frames(shared(spark, sf, "positions"), discard=10, stride=3)
    return p.groupBy("traj", "frame").agg(F.sum("x").alias("sx"), F.count(F.lit(1)).alias("n"))


@query
def site_tokens(spark, sf):
    """Site tokens and inferred elements of all part names."""
    p = V.read(spark, sf, "part")
    e = T.infer_element(F.col("p_name"), F.col("p_type"))
    return p.select("p_partkey", T.site_token(F.col("p_name")).alias("site"), e.alias("element"),
                    T.infer_element(F.col("p_name"), F.lit(""), fallback=None).alias("element_upper"),
                    T.element_mass(e).alias("mass"),
                    T.safe_label(F.concat(F.col("p_type"), F.lit(": "), F.col("p_name"))).alias("label"))


@query
def temperature_from_name(spark, sf):
    """Temperatures read from file names built over all orders."""
    o = V.read(spark, sf, "orders")
    t = (F.lit(240) + F.col("o_orderkey") % 200).cast("string")
    stem = F.concat(F.lit("run"), F.col("o_custkey").cast("string"))
    k = F.col("o_orderkey") % 4
    name = (F.when(k == 0, F.concat(F.lit("T"), t, F.lit("K/"), stem, F.lit(".pdb")))
            .when(k == 1, F.concat(stem, F.lit("_nvt"), t, F.lit("K_120ns.pdb")))
            .when(k == 2, F.concat(stem, F.lit("_"), t, F.lit("_K.pdb")))
            .otherwise(F.concat(stem, F.lit(".pdb"))))
    df = o.select("o_orderkey", name.alias("path"), F.when(F.col("o_orderkey") % 10 == 0, F.lit(273.0)).alias("m"))
    df = df.withColumns(T.resolve_temperature(F.col("path"), F.col("m"), 298.0))
    return df.select("o_orderkey", "temperature_K", "temperature_source")


@query
def temperature_map(spark, sf):
    """Temperatures looked up by path, file name or stem, over paths built from all orders."""
    o = V.read(spark, sf, "orders")
    path = F.concat(F.lit("/d"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/r"), (F.col("o_custkey") % 7).cast("string"),
                    F.when(F.col("o_orderkey") % 2 == 0, ".pdb").otherwise(".pdb.gz"))
    table = {"/d0/r1.pdb": 250.0, "r1.pdb": 260.0, "r2.pdb.gz": 270.0, "r2": 280.0, "r3": 290.0, "/d1/r3.pdb.gz": 295.5}
    return o.select("o_orderkey", path.alias("path")).withColumns(T.mapped_temperature(F.col("path"), table))


@query
def run_names(spark, sf):
    """Series label, temperature and run number of directory names built over all orders."""
    r = shared(spark, sf, "runs")
    d = F.when(F.col("run_index") == 1, F.col("series")).otherwise(
        F.concat(F.lower("series"), F.format_string("_run_%03d", F.col("run_index"))))
    return r.select("o_orderkey", T.series_label(d).alias("label"), T.series_temperature(d).alias("temperature_K"),
                    T.run_number(d).alias("run"))


# --- files ------------------------------------------------------------------------------------------

CHUNK = 25


def _chunked(spark, sf):
    """Positions cut into files of at most 25 frames, with atom order and topology columns."""
    p = shared(spark, sf, "positions").withColumn("chunk", F.expr(f"frame div {CHUNK}"))
    return p.join(shared(spark, sf, "atoms"), ["traj", "atom_id"])


def _write_lines(df: DataFrame, by: list[str], order: list[str], folder: str) -> None:
    """One text file per ``by`` group, lines in ``order``."""
    (df.repartition(*by).sortWithinPartitions(*by, *order).select(*by, "line")
     .write.partitionBy(*by).text(folder))


def _tag(name: str):
    return F.regexp_extract("file", rf"{name}=([^/]+)/", 1)


@once_per_app
def _pdb_folder(spark, sf):
    df = _chunked(spark, sf)
    atom = df.select("traj", "chunk", "frame", F.lit(2).alias("k"), "atom_id", F.format_string(
        "ATOM  %5d %-4s %-3s %s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", (F.col("atom_id") % 100000).cast("int"),
        "name", "resname", "chain", (F.col("resid") % 10000).cast("int"), "x", "y", "z", F.lit(1.0),
        F.col("atom_type").cast("double"), "element").alias("line"))
    fr = df.select("traj", "chunk", "frame").distinct()
    edge = lambda k, text: fr.select("traj", "chunk", "frame", F.lit(k).alias("k"), F.lit(0).cast("long").alias("atom_id"), text.alias("line"))
    lines = (atom.unionByName(edge(0, F.format_string("MODEL     %4d", F.col("frame") + 1)))
             .unionByName(edge(1, F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1",
                                                  F.lit(V.BOX), F.lit(V.BOX), F.lit(V.BOX), F.lit(90.0), F.lit(90.0), F.lit(90.0))))
             .unionByName(edge(3, F.lit("ENDMDL"))).unionByName(edge(4, F.lit("CONECT    1    2"))))
    folder = work_folder(spark, "pdb")
    _write_lines(lines, ["traj", "chunk"], ["frame", "k", "atom_id"], folder)
    return folder


def _pdb(spark, sf):
    folder = _pdb_folder(spark, sf)
    return sources_pdb.read_pdb(spark, folder, traj=F.concat_ws("/", _tag("traj"), _tag("chunk")))


def _unchunk(df: DataFrame) -> DataFrame:
    part = F.split("traj", "/")
    return df.withColumns({"frame": part[1].cast("bigint") * CHUNK + F.col("frame"), "traj": part[0]})


@query
def ingest_pdb(spark, sf):
    """Positions written as PDB text and read back; atoms count from 0 in each frame."""
    return _unchunk(_pdb(spark, sf).positions)


@query
def ingest_pdb_frames(spark, sf):
    return _unchunk(_pdb(spark, sf).frames)


@query
def ingest_pdb_strict(spark, sf):
    """The strict reader, which wants a cell, on the same files."""
    t = sources_pdb.read_pdb(spark, _pdb_folder(spark, sf), traj=F.concat_ws("/", _tag("traj"), _tag("chunk")), strict=True)
    return _unchunk(t.frames)


@query
def ingest_pdb_atoms(spark, sf):
    """The atoms of every file, which are the same in all files of a trajectory."""
    a = _pdb(spark, sf).atoms.withColumns({"chunk": F.split("traj", "/")[1].cast("int"), "traj": F.split("traj", "/")[0]})
    return a.drop("serial")


def _archives(spark, sf, name, boxed=None):
    """Positions written as multi-frame XYZ archives; ``boxed`` tells which frames have a cell line."""
    df = _chunked(spark, sf)
    atom = df.select("traj", "chunk", "frame", F.lit(2).alias("k"), "atom_id", F.format_string(
        "%6d %-3s %12.6f %12.6f %12.6f %5d", F.col("atom_id") + 1, "name", "x", "y", "z", "atom_type").alias("line"))
    n = df.groupBy("traj", "chunk", "frame").agg(F.count(F.lit(1)).alias("n"))
    head = n.select("traj", "chunk", "frame", F.lit(0).alias("k"), F.lit(0).cast("long").alias("atom_id"),
                    F.format_string("%6d frame of %s", "n", "traj").alias("line"))
    box = n.select("traj", "chunk", "frame", F.lit(1).alias("k"), F.lit(0).cast("long").alias("atom_id"),
                   F.lit("  20.000000 20.000000 20.000000 90.0 90.0 90.0").alias("line"))
    folder = work_folder(spark, name)
    _write_lines(atom.unionByName(head).unionByName(box if boxed is None else box.where(boxed)), ["traj", "chunk"], ["frame", "k", "atom_id"], folder)
    return folder


@query
def ingest_xyz(spark, sf):
    """Positions written as multi-frame XYZ archives and read back."""
    t = sources_xyz.read_xyz(spark, _archives(spark, sf, "xyz"), traj=F.concat_ws("/", _tag("traj"), _tag("chunk")))
    out = t.positions.join(t.frames.select("traj", "frame", "n_atoms", "a", "title"), ["traj", "frame"])
    return _unchunk(out)


@query
def ingest_xyz_mixed(spark, sf):
    """Archives in which two frames of five have no cell line, their frames found over many buckets of lines."""
    folder = _archives(spark, sf, "mixed", F.col("frame") % 5 < 3)
    t = sources_xyz.read_xyz(spark, folder, traj=F.concat_ws("/", _tag("traj"), _tag("chunk")), width=64)
    out = t.positions.join(t.frames.select("traj", "frame", "n_atoms", "a", "title"), ["traj", "frame"])
    return _unchunk(out)


@query
def flow_resumed(spark, sf):
    """Centres of PDB files, computed for the first file of each trajectory, then for all, then with another parameter:
    a call computes what it has not, which the step tells that wrote a row."""
    folder, out = _pdb_folder(spark, sf), work_folder(spark, "resumed")
    files = manifest.inputs(spark, folder, "*.txt", F.concat_ws("-", _tag("traj"), _tag("chunk")))
    found, calls = [], 0

    def centres(weight: float, call: int):
        def compute(paths: list[str]):
            p = sources_pdb.read_pdb(spark, paths, traj=F.concat_ws("-", _tag("traj"), _tag("chunk"))).positions
            return {"centres": p.groupBy("traj", "frame").agg(F.count(F.lit(1)).alias("n"), (F.avg("x") * weight).alias("x")).withColumn("call", F.lit(call))}
        return compute

    for chosen, weight in ((files.where(F.col("traj").endswith("-0")), 1.0), (files, 1.0), (files, 2.0)):
        calls += 1
        manifest.resume(spark, out, chosen, {"weight": weight}, centres(weight, calls), per_step=1000)
        if calls > 1:
            table = spark.read.schema("frame bigint, n bigint, x double, call int, traj string").parquet(f"{out}/centres")
            found.append(stage(manifest.current(spark, out, table, chosen, {"weight": weight}).withColumn("weight", F.lit(weight)), "found"))
    part = F.split("traj", "-")
    both = found[0].unionByName(found[1])
    return rounded(both.select(part[0].alias("traj"), (part[1].cast("bigint") * CHUNK + F.col("frame")).alias("frame"), "n", "x", "call", "weight"), 5)


@query
def snapshot_cells(spark, sf):
    """Numbered snapshots of every run as lines of text, some without a cell, of which the scan looks at the second line."""
    cell = F.when(F.col("a_A").isNull(), "  1 O 0.0 0.0 0.0 1").otherwise(F.format_string("%.6f %.6f %.6f 90.0 90.0 90.0", "a_A", "b_A", "c_A"))
    s = shared(spark, sf, "snapshots").withColumn("lines", F.array(F.lit("3 water"), cell, F.lit("  2 O 20.0 20.0 20.0 90")))
    read = s.select(F.concat_ws("/", "series", "run_index", F.format_string("snap.%03d", "o_orderkey")).alias("file"), F.lit(0).cast("long").alias("block"),
                    F.posexplode("lines").alias("seq", "line"))
    cells = sources_xyz.cells_of(read.withColumn("seq", F.col("seq").cast("long")), 50.0)
    return rounded(cells.withColumns({"series": F.split("file", "/")[0], "run_index": F.split("file", "/")[1].cast("int")})
                   .select("series", "run_index", "frame", "time_ps", *sources_xyz.CELL))


@once_per_app
def _log_folder(spark, sf):
    log = shared(spark, sf, "logs").withColumn("dir", F.when(F.col("run_index") == 1, F.col("series")).otherwise(
        F.concat("series", F.format_string("_run_%03d", "run_index"))))
    log = log.withColumn("part", F.floor(F.col("time_ps") / 20000.0))
    text = F.array(F.struct(F.lit(0).alias("k"), F.format_string(" Current Time %15.4f Picosecond", "time_ps").alias("line")),
                   F.struct(F.lit(1).alias("k"), F.format_string(" Current Potential %18.4f Kcal/mole", "potential_kcal_mol").alias("line")),
                   F.struct(F.lit(2).alias("k"), F.when(F.col("kinetic_kcal_mol").isNotNull(), F.format_string(
                       " Current Kinetic %18.7f Kcal/mole", "kinetic_kcal_mol")).alias("line")),
                   F.struct(F.lit(3).alias("k"), F.lit(" Periodic Box Dimensions").alias("line")),
                   F.struct(F.lit(4).alias("k"), F.format_string("   %9.4f 20.0 20.0", F.lit(20.0)).alias("line")),
                   F.struct(F.lit(5).alias("k"), F.lit("   90.0 90.0 90.0").alias("line")))
    lines = log.select("dir", "part", "time_ps", F.explode(text).alias("t")).select("dir", "part", "time_ps", "t.*")
    folder = work_folder(spark, "log")
    _write_lines(lines.where("line IS NOT NULL"), ["dir", "part"], ["time_ps", "k"], folder)
    return folder


@query
def ingest_log(spark, sf):
    """Run logs written as text and read back."""
    folder = _log_folder(spark, sf)
    out = sources_logs.read_logs(spark, folder, ".txt", _tag("dir"))
    return rounded(out.select("series", "run_index", "time_ps", "potential_kcal_mol", "kinetic_kcal_mol", "a_A", "gamma_deg"), 4)


@query
def kinetic_log(spark, sf):
    """Temperatures from the kinetic-energy lines of the same text."""
    folder = _log_folder(spark, sf)
    out = sources_logs.kinetic_log(sources_text.read_lines(spark, folder), 3 * 400 - 3)
    return rounded(sources_logs.run_columns(out, _tag("dir")).select("series", "run_index", "time_ps", "temperature_K", "dof_used"))


@query
def ingest_masses(spark, sf):
    """Force-field mass records built from all parts."""
    p = V.read(spark, sf, "part")
    lines = p.select(F.lit("ff").alias("file"), F.lit(0).alias("block"), F.col("p_partkey").alias("seq"), F.format_string(
        'atom %6d %4d  %s  "%s" %4d %12.4f %2d', F.col("p_partkey"), "p_size", F.substring("p_type", 1, 2), "p_name",
        F.lit(8), "p_retailprice", F.lit(2)).alias("line"))
    return sources_logs.parse_masses(lines)


def _order_files(spark, sf):
    r = shared(spark, sf, "runs")
    d = F.when(F.col("run_index") == 1, F.col("series")).otherwise(
        F.concat("series", F.format_string("_run_%03d", "run_index")))
    return r.select("o_orderkey", F.concat(F.lit("file:/data/"), d, F.lit("/snap"), "o_orderstatus",
                                           F.format_string(".%03d", "rn")).alias("file"))


@query
def snapshot_discovery(spark, sf):
    """The numbered series each run directory uses, among names built over all orders."""
    out = sources_text.numbered_series(_order_files(spark, sf).select("file"))
    return out.select("directory", "prefix", "index")


@query
def source_discovery(spark, sf):
    """Trajectory sources per directory: numbered series first, else archives by pattern."""
    files = _order_files(spark, sf)
    plain = F.col("file").contains("T270K")
    name = F.when(plain, F.concat(F.regexp_replace("file", r"\.\d+$", ""), F.col("o_orderkey").cast("string"),
                                  F.when(F.col("o_orderkey") % 2 == 0, ".arc").otherwise(".xyz.gz"))).otherwise(F.col("file"))
    return sources_text.trajectory_files(files.select(name.alias("file"))).groupBy("directory").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("file", "rank").alias("first"))


@query
def atom_type_field(spark, sf):
    """Atom types read from ATOM lines built over all line items."""
    li = V.read(spark, sf, "lineitem")
    k = F.col("l_linenumber") % 3
    line = F.format_string("ATOM  %5d  N   XXX A   1       1.000   2.000   3.000%6.2f%6.2f      %s", F.col("l_orderkey") % 100000,
                           F.when(k == 0, F.col("l_quantity")).otherwise(1.0), F.when(k == 1, F.col("l_quantity")).otherwise(0.0),
                           F.when(k == 2, F.concat(F.lit("  "), F.col("l_quantity").cast("int").cast("string"))).otherwise(F.lit("  N ")))
    df = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("line"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                     T.atom_type(F.col("line"), "auto").alias("auto"), T.atom_type(F.col("line"), "bfactor").alias("bfactor"),
                     T.atom_type(F.col("line"), "tail").alias("tail"))


@query
def atom_type_modes(spark, sf):
    """Every place an ATOM line can hide an atom type in, over all line items."""
    k = F.col("l_linenumber") % 3
    line = F.format_string("ATOM  %5d  N   %-4dA   1       1.000   2.000   3.000%6.2f%6.2f      %s", F.col("l_orderkey") % 100000, F.col("l_suppkey") % 1000,
                           F.when(k == 0, F.col("l_quantity")).otherwise(1.0), F.when(k == 1, F.col("l_quantity")).otherwise(0.0),
                           F.when(k == 2, F.concat(F.lit("  "), F.col("l_quantity").cast("int").cast("string"))).otherwise(F.lit("  N ")))
    li = V.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[T.atom_type(F.col("line"), m).alias(f"type_{m}")
                                                     for m in ("auto", "occupancy", "bfactor", "resname", "tail", "last_int", "none")])


@query
def ingest_xyz_bonds(spark, sf):
    """Archives with bonded ids, written as text and read back: zeros and trailing words are no bonds. An archive holds a
    stretch of atom numbers, as the task that writes it sorts its lines."""
    a = shared(spark, sf, "bonded_atoms").withColumn("part", F.floor(F.col("atom_id") / 100_000))
    line = F.concat_ws(" ", F.format_string("%7d %-3s 0.0 1.0D0 2.5 %5d", F.col("atom_id") + 1, "name", "atom_type"),
                       F.array_join(F.transform("bonds", lambda b: (b + 1).cast("string")), " "),
                       F.when(F.col("atom_id") % 3 == 0, "0").when(F.col("atom_id") % 3 == 1, "# 77").otherwise(""))
    head = a.groupBy("traj", "part").agg(F.format_string("%d box of orders", F.count(F.lit(1))).alias("line")).select("traj", "part", F.lit(-1).cast("long").alias("atom_id"), "line")
    folder = work_folder(spark, "bonds")
    _write_lines(a.select("traj", "part", "atom_id", line.alias("line")).unionByName(head), ["traj", "part"], ["atom_id"], folder)
    out = sources_xyz.topology_rows(sources_text.read_lines(spark, folder).withColumn("line", F.regexp_replace("line", " # .*| 0$", "")), _tag("traj"))
    read = sources_xyz.read_xyz(spark, folder, traj=_tag("traj")).atoms
    ids = lambda c: F.array_join(F.transform(F.filter(c, lambda b: b > 0), lambda b: (b - 1).cast("string")), ",")
    same = out.select("traj", "atom_id", ids(F.col("bonds")).alias("strict_bonds"))
    return read.join(same, ["traj", "atom_id"]).select(F.col("atom_id") - 1, "name", "atom_type", ids(F.col("bonds")).alias("bonds"), "strict_bonds").toDF(
        "atom_id", "name", "atom_type", "bonds", "strict_bonds")


@query
def ingest_log_fields(spark, sf):
    """Records with lattice lines, plain fields that only fill gaps, exponents and times repeated in a later file."""
    log = shared(spark, sf, "logs")
    text = F.array(F.struct(F.lit(0).alias("k"), F.format_string(" Current Time %.4f Picosecond", F.floor(F.col("time_ps") / 20) * 20.0).alias("line")),
                   F.struct(F.lit(1).alias("k"), F.when(F.col("kinetic_kcal_mol").isNotNull(), F.format_string(" Current Kinetic %.7f Kcal/mole", "kinetic_kcal_mol")).alias("line")),
                   F.struct(F.lit(2).alias("k"), F.lit(" Kinetic Energy 1.5D+01 Kcal/mole").alias("line")),
                   F.struct(F.lit(3).alias("k"), F.format_string(" Potential Energy %.4f Kcal/mole", "potential_kcal_mol").alias("line")),
                   F.struct(F.lit(4).alias("k"), F.lit(" Lattice Lengths 21.0 22.0 23.0").alias("line")),
                   F.struct(F.lit(5).alias("k"), F.lit(" Lattice Angles 90.0 91.0 92.0").alias("line")))
    lines = log.select(F.concat_ws("/", "series", F.col("run_index").cast("string")).alias("dir"), "time_ps", F.explode(text).alias("t"))
    lines = lines.select(F.concat(F.col("dir"), F.lit("/"), (F.col("time_ps").cast("long") % 20).cast("string")).alias("file"),
                         F.floor(F.col("time_ps") / 1000).alias("block"), (F.col("time_ps") * 10 + F.col("t.k")).cast("long").alias("seq"), "t.line").where("line is not null")
    rec = sources_logs.parse_logs(lines).withColumn("run", F.regexp_extract("file", "^(.*)/", 1))
    out = sources_logs.clean_logs(rec, ["run"])
    return rounded(out.select("run", "time_ps", "potential_kcal_mol", "kinetic_kcal_mol", "a_A", "c_A", "beta_deg"), 4)


@query
def ingest_curves(spark, sf):
    """Reference curves as text over all parts, and for each wanted pair the curve under either order of its sites."""
    p = V.read(spark, sf, "part")
    pair = F.element_at(F.array(*[F.lit(x) for x in ("Li_O", "O_Li", "N_Li", "S_H")]), (F.col("p_size") % 4 + 1).cast("int"))
    lines = p.select(F.concat(F.lit("/ref/reference_rdf_"), pair, F.lit(".txt")).alias("file"), F.lit(0).alias("block"), F.col("p_partkey").alias("seq"),
                     F.when(F.col("p_partkey") % 9 == 0, "# note").otherwise(F.format_string("%d, %.2f", "p_partkey", "p_retailprice")).alias("line"))
    wanted = spark.createDataFrame([("Li", "O"), ("Li", "N"), ("H", "Li")], "a string, b string")
    return sources_logs.curve_for_pair(sources_logs.read_curves(lines, ("r", "g_ref")), wanted).select("a", "b", "pair", "r", "g_ref")


@query
def combined_curves(spark, sf):
    """Wide table: one g(r) column per site pair."""
    s = cubic_sites(spark, sf)
    parts = [S.rdf(s, "Li", b, RMAX, RDF_BW).select("traj", "bin", F.lit(f"Li_{b}").alias("label"), F.col("g").alias("value"))
             for b in ("N", "O", "S")]
    return rounded(sources_sinks.wide(functools.reduce(DataFrame.unionByName, parts), ["traj", "bin"], ["Li_N", "Li_O", "Li_S"]))


@query
def sink_roundtrip(spark, sf):
    """Series written to one folder each and read back; the second call reuses what the first wrote."""
    folder = work_folder(spark, "series")
    df = _derived(spark, sf).select("series", "run_index", "o_orderkey", "time_ps", "volume_A3")
    sources_sinks.write_series(df, folder)
    back = spark.read.parquet(folder).withColumn("series", F.col("series").cast("string"))

    def again():
        raise AssertionError("computed although the result is there")

    sources_sinks.reuse(spark, folder + "-copy", lambda: back.drop("time_ps"), ["volume_A3"])
    kept = sources_sinks.reuse(spark, folder + "-copy", again, ["volume_A3"])
    return rounded(kept.select("series", "run_index", "o_orderkey", "volume_A3"))


@query
def csv_roundtrip(spark, sf):
    """A CSV with metadata written and read back."""
    folder = work_folder(spark, "csv")
    df = S.adf(_triplets(spark, sf), 10.0).select("traj", "bin", F.col("density_per_degree").alias("density"), "count")
    sources_sinks.write_csv(df, folder, {"rcut12_A": ANGLE_CUT, "site2": "Li"}, ["traj", "bin"])
    return rounded(sources_logs.read_result_csv(spark, folder))


@query
def text_lines(spark, sf):
    """Fixed-format ``r cn`` lines of each trajectory, written and read back."""
    g = S.rdf(cubic_sites(spark, sf), "Li", "O", RMAX, RDF_BW, "mean").sortWithinPartitions("traj", "bin")
    folder = work_folder(spark, "lines")
    sources_sinks.write_text(sources_sinks.fixed_text(g, ["r", "cn"], "%.4f", ["traj"]), folder, ["traj"])
    return spark.read.schema("line string, traj string").text(folder)


def _saved(spark, df, name, by=("traj",), fmt="parquet"):
    """A result table as its reader finds it, computed once and written in two goes of which the second leaves the first alone."""
    folder, df = work_folder(spark, "out"), stage(df, name)
    half = F.pmod(F.xxhash64(by[0]), F.lit(2))
    for part in (0, 1):
        outputs.save({name: df.where(half == part)}, folder, by, fmt)
    return outputs.load(spark, folder, name, df, fmt)


@query
def out_lags(spark, sf):
    """The decomposition as one row per lag, written and read back."""
    return rounded(_saved(spark, outputs.lag_table(curves(spark, sf), [s for s, _ in SPECIES]), "lags"), 3)


@query
def out_decomposition(spark, sf):
    return rounded(_saved(spark, _sigma(spark, sf), "decomposition"), 5)


@query
def out_transference(spark, sf):
    """Running transference numbers, one column per method and reference frame, written and read back."""
    s = TR.term_sums(_frames_of_reference(spark, sf), SPECIES, MAX_LAG, ["traj", "ref"])
    running = TR.transference_running(stage(TR.pair_curves(s, "Li", "FSA", V.DT_NS), "pair"), ["traj", "ref"], FIT[0])
    return rounded(_saved(spark, outputs.transference_table(running), "transference").drop("time"), 4)


@query
def out_blocks(spark, sf):
    return rounded(_saved(spark, _block_estimates(spark, sf), "blocks", ["ref"]), 4)


@query
def transference_running_blocks(spark, sf):
    """Running transference numbers of each block: mean and error over the blocks at every lag."""
    b = TR.into_blocks(_frames_of_reference(spark, sf), N_BLOCKS, 10)
    s = TR.term_sums(b, SPECIES, 15, ["traj", "ref", "block"])
    running = TR.transference_running(stage(TR.pair_curves(s, "Li", "FSA", V.DT_NS), "pair"), ["traj", "ref", "block"], 0.2, 4)
    return rounded(TR.running_block_error(running, N_BLOCKS).drop("time"), 4)


@query
def out_species_msd(spark, sf):
    """The MSD table of each species as CSV, written and read back."""
    curve = D.diffusion_from_origin(_msd(spark, sf)).select("traj", "label", "lag", "time", "msd", "n", "D_A2_per_ns", "D_1e5_cm2_per_s")
    return rounded(_saved(spark, curve, "msd", ["traj", "label"], "csv"), 5)


@query
def out_summary_lines(spark, sf):
    """``key = value`` lines per species, written and read back."""
    rows = _ne(spark, sf).select("traj", "label", "n_particles", F.format_string("%.3f", "concentration_mol_L").alias("concentration_mol_L"))
    return _saved(spark, sources_sinks.key_values(rows, ["traj", "label"]), "lines", ["traj", "label"])


@query
def out_kinetic(spark, sf):
    """Kinetic temperatures as CSV per series, written and read back."""
    log = sources_logs.kinetic_log(sources_text.read_lines(spark, _log_folder(spark, sf)), 3 * 400 - 3)
    log = sources_logs.run_columns(log, _tag("dir")).select("series", "run_index", "time_ps", "temperature_K", "dof_used")
    return rounded(_saved(spark, log, "kinetic", ["series"], "csv"))


@query
def out_solvent(spark, sf):
    """Solvent curves, written with their fits and read back."""
    folder = work_folder(spark, "solvent")
    c = TR.solvent_curves(particles(spark, sf), "SOL", MAX_LAG, V.DT_NS)
    outputs.save_solvent(c, *FIT, folder)
    return rounded(outputs.load(spark, folder, "curves", c), 5)


@query
def out_events(spark, sf):
    return rounded(_saved(spark, contacts(spark, sf), "events"))


# --- flows --------------------------------------------------------------------------------------------


def trajectory(spark, sf):
    """The canonical views as an ingested trajectory."""
    pos = shared(spark, sf, "positions")
    frames = pos.groupBy("traj", "frame").agg(F.count(F.lit(1)).alias("n_atoms")).select(
        "traj", "frame", "n_atoms", *[F.lit(V.BOX).alias(n) for n in "abc"],
        *[F.lit(90.0).alias(n) for n in ("alpha", "beta", "gamma")])
    return sources_pdb.Trajectory(frames, shared(spark, sf, "atoms").withColumn("site", F.col("element")), pos)


@query
def flow_radial(spark, sf):
    from mdframes.plans.distributions import radial
    return rounded(radial(trajectory(spark, sf), ["Li-O", "Li-N"], RMAX, RDF_BW, start_ratio=0.2, stride=2))


@query
def flow_residence(spark, sf):
    from mdframes.plans.residence import residence
    out = residence(trajectory(spark, sf), "Li", SEL.Target("FSA", ("72",)), ["N", "O", "S"], V.DT_NS,
                    r_on=R_ON, r_off=R_OFF, rmax=RMAX, bins=60)
    return rounded(out.summary.select("traj", "n_frames", "n_cations", "n_molecules", "n_events", "n_left_censored",
                                      "n_right_censored", "mean_coordination", "continuous_integral_ns",
                                      "intermittent_integral_raw_ns", "r_on", "r_off", "cutoff_source"))


@query
def flow_residence_auto(spark, sf):
    """Relaxation table with cutoffs taken from each trajectory's own g(r)."""
    from mdframes.plans.residence import residence
    out = residence(trajectory(spark, sf), "Li", SEL.Target("FSA", ("72",)), ["N", "O", "S"], V.DT_NS,
                    rmax=RMAX, bins=60, bandwidth=0.3, hysteresis=0.5)
    return rounded(out.relaxation, 4)


@query
def flow_joint_states(spark, sf):
    """Coordination of each cation by anions and by solvent at once, from one run over both targets."""
    from mdframes.plans.residence import two_targets
    out = two_targets(trajectory(spark, sf), "Li", SEL.parse_target("FSA:72:-1"), SEL.parse_target("SOL:SOL:71", "solvent"), ["N", "O", "S"], V.DT_NS,
                      r_on=R_ON, r_off=R_OFF, rmax=RMAX, bins=60, max_lag=5)
    return rounded(out.states)


@query
def select_by_field(spark, sf):
    """Molecules anchored by name, residue name or type."""
    a = shared(spark, sf, "atoms")
    parts = [SEL.molecules_by_anchor(a, v, ["O", "S"], f).withColumn("field", F.lit(f)) for f, v in (("name", "n"), ("resname", "fsa"), ("atom_type", 72))]
    return functools.reduce(DataFrame.unionByName, parts)


@query
def flow_angular(spark, sf):
    from mdframes.plans.distributions import angular
    return rounded(angular(trajectory(spark, sf), [("O", "Li", "N"), ("O", "Li", "O")], ANGLE_CUT, ANGLE_CUT, 10.0, True)[0])


@query
def flow_angular_counters(spark, sf):
    from mdframes.plans.distributions import angular
    return angular(trajectory(spark, sf), [("O", "Li", "N")], ANGLE_CUT, ANGLE_CUT, 10.0)[1]


@query
def flow_diffusion(spark, sf):
    """Species MSD from wrapped positions."""
    from mdframes.plans.transport import diffusion
    t = trajectory(spark, sf)
    temp = t.frames.select("traj").distinct().withColumn("temperature_K", F.lit(300.0))
    curve, _, _ = diffusion(t, TARGETS, temp, V.DT_NS, MAX_LAG, FIT)
    return rounded(curve.select("traj", "label", "lag", "time", "msd", "n", "D_A2_per_ns", "D_1e5_cm2_per_s"), 5)


@query
def frame_times(spark, sf):
    """Times of archive frames and of numbered snapshots."""
    fr = shared(spark, sf, "positions").select("traj", "frame").distinct()
    a = sources_xyz.frame_times(fr, 50.0, 10.0).select(F.lit("archive").alias("kind"), F.col("traj").alias("run"), "frame", "time_ps")
    r = shared(spark, sf, "runs").select(F.concat_ws("/", "series", "run_index").alias("run"), (F.col("rn") + 3).alias("index"), F.lit(0).cast("long").alias("frame"))
    b = sources_xyz.frame_times(r, 50.0, index="index", run=["run"]).select(F.lit("snapshots").alias("kind"), "run", F.col("index").cast("long").alias("frame"), "time_ps")
    return a.unionByName(b)


@query
def selected_positions(spark, sf):
    chosen = SEL.molecules_by_anchor(shared(spark, sf, "atoms"), 72, ["O", "S"])
    return sources_pdb.selected_positions(shared(spark, sf, "positions"), chosen).select("traj", "frame", "atom_id", "x", "y", "z")


@query
def restored_box(spark, sf):
    """Frames that lost their cell take the header's."""
    fr = shared(spark, sf, "triclinic_frames")
    cells = ["a", "b", "c", "alpha", "beta", "gamma"]
    lost = fr.withColumns({c: F.when(F.col("frame") % 3 != 0, F.col(c)) for c in cells})
    return sources_pdb.restore_box(lost, fr.where("frame = 0").select("traj", *cells)).select("traj", "frame", *cells)


@query
def reference_file(spark, sf):
    """The reference curve to use, among names built over all orders."""
    o = V.read(spark, sf, "orders")
    name = F.concat(F.lit("file:/data/"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("T300K/"),
                    F.format_string("c%06d_reference_rdf_Li_O.txt", "o_custkey"))
    return sources_text.preferred_file(o.select(name.alias("file")), "file:/data", "_rdf_Li_O.txt")


@query
def flow_transport(spark, sf):
    """Conductivity decomposition from wrapped positions: unwrap, drift, centres, curves, fits."""
    from mdframes.plans.transport import transport
    t = trajectory(spark, sf)
    temp = t.frames.select("traj").distinct().withColumn("temperature_K", F.lit(300.0))
    out = transport(t, TARGETS[:2], temp, V.DT_NS, MAX_LAG, FIT, solvent=TARGETS[2], n_blocks=4)
    return rounded(out.check, 3)


@query
def flow_transport_selected(spark, sf):
    """The same with the drift of the selected particles, which here are all there are."""
    from mdframes.plans.transport import transport
    t = trajectory(spark, sf)
    temp = t.frames.select("traj").distinct().withColumn("temperature_K", F.lit(300.0))
    out = transport(t, TARGETS[:2], temp, V.DT_NS, MAX_LAG, FIT, solvent=TARGETS[2], drift="selected", n_blocks=0)
    return rounded(out.check, 3)


def _density(spark, sf):
    """Entity counts of each run's bond graph: a customer's orders in a run form a molecule."""
    from mdframes.plans.density import density
    r = shared(spark, sf, "runs").withColumn("traj", F.concat_ws("/", "series", F.col("run_index").cast("string")))
    r = previous(r.withColumn("_b", F.floor(F.col("rn") / 65_536)), ["traj", "o_custkey"], "_b", ["rn"], {"last": F.col("o_orderkey")})
    atoms = r.select("traj", F.col("o_orderkey").alias("atom_id"), F.substring("o_orderstatus", 1, 1).alias("name"),
                     (F.col("o_orderkey") % 4).cast("int").alias("atom_type"),
                     F.when(F.col("last").isNotNull(), F.array("last")).otherwise(F.array().cast("array<bigint>")).alias("bonds"))
    masses = spark.createDataFrame([(0, 1.0), (1, 6.94), (2, 14.007), (3, 15.999)], "atom_type int, mass double")
    sel = [SEL.EntitySelection("a", (1,)), SEL.EntitySelection("b", (2, 3)), SEL.EntitySelection("m", (1,), "molecule"),
           SEL.EntitySelection("both", (1, 2), "molecule", "all")]
    return density(shared(spark, sf, "snapshots").drop("o_orderkey"), shared(spark, sf, "logs"), atoms, sel, masses, 10.0)


@query
def flow_density_selections(spark, sf):
    """What was counted in each run, and how often it was found."""
    return _density(spark, sf).selections


@query
def flow_density(spark, sf):
    """Stitched density series."""
    out = _density(spark, sf)
    return rounded(out.summary.select("series", "n_points", "time_max_ps", "volume_A3_mean", "a_A_mean", "count_a_min", "count_a_max",
                                      "count_m_min", "count_m_max", "count_both_max"), 3)
