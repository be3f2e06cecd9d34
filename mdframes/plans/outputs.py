"""What the flows leave behind: every result table in a folder of its own, partitioned, rewritten in place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.operators import transport as TR
from mdframes.plans.residence import Residence
from mdframes.plans.transport import Transport
from mdframes.sources.sinks import key_values, write_series

METHODS = ["PFG_t_app", "eNMR_t0", "Bruce_Vincent_tss"]


def save(tables: Mapping[str, DataFrame | None], folder: str, by: Sequence[str] = ("traj",), fmt: str = "parquet") -> None:
    """Write each table below ``folder`` under its name. Of a table that is there already only the
    partitions that come anew are replaced, so a flow can write after every input it has finished."""
    for name, df in tables.items():
        if df is not None:
            write_series(df, f"{folder}/{name}", [c for c in by if c in df.columns], fmt)


def load(spark: SparkSession, folder: str, name: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """A written table, with the columns and types it was written with."""
    reader = spark.read.schema(like.schema)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(f"{folder}/{name}").select(*like.columns)


def column_name(term: str) -> str:
    """``distinct:Li-FSA`` as a column name that every format can hold."""
    return term.replace(":", "_").replace("-", "_")


def lag_table(curves: DataFrame, labels: Sequence[str], keys: Sequence[str] = ("traj",)) -> DataFrame:
    """One row per lag with one column per term of the decomposition."""
    pairs = [f"distinct:{a}-{b}" for i, a in enumerate(labels) for b in labels[i:]]
    terms = [*[f"self:{a}" for a in labels], *pairs, "total:charge"]
    out = curves.groupBy(*keys, "lag", "time").pivot("term", terms).agg(F.first("value"))
    return out.withColumnsRenamed({t: column_name(t) for t in terms})


def transference_table(running: DataFrame, references: Sequence[str] = ("barycentric", "solvent_fixed")) -> DataFrame:
    """One row per lag with a column ``method__reference`` for each transference number."""
    cells = [F.max(F.when(F.col("ref") == r, F.col(m))).alias(f"{m}__{r}") for r in references for m in METHODS]
    return running.groupBy("traj", "lag", "time").agg(*cells)


def save_transport(out: Transport, labels: Sequence[str], folder: str) -> None:
    """Lag table, decomposition, running curves, transference numbers, block estimates and solvent curves."""
    save({"lags": lag_table(out.curves, labels), "decomposition": out.sigma, "sigma_check": out.check, "running_sigma": out.running,
          "transference_running": transference_table(out.transference), "transference_blocks": out.blocks,
          "transference_block_running": out.block_running, "solvent_curves": out.solvent}, folder)


def save_residence(out: Residence, folder: str) -> None:
    save({"cutoffs": out.cutoffs, "rdf": out.rdf, "events": out.events, "coordination": out.coordination,
          "correlations": out.correlations, "relaxation": out.relaxation, "summary": out.summary}, folder)


def save_diffusion(curve: DataFrame, species: DataFrame, total: DataFrame, folder: str) -> None:
    """A lag table and ``key = value`` lines per species, and the totals."""
    save({"msd": curve}, folder, ["traj", "label"], "csv")
    save({"summary_lines": key_values(species, ["traj", "label"])}, folder, ["traj", "label"])
    save({"species": species, "systems": total}, folder)


def save_solvent(curves: DataFrame, start: float, end: float, folder: str, blocks: DataFrame | None = None) -> None:
    """Solvent curves, diffusion fits and running estimates, and block errors if there are any."""
    save({"curves": curves, "diffusion": TR.solvent_diffusion(curves, ["traj"], start, end),
          "running": TR.solvent_running(curves, ["traj"], start), "blocks": blocks}, folder)
