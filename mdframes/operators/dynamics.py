"""Unwrapping, centres of mass, drift removal and window-averaged displacement correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdframes.schema import XYZ

FRAMES_PER_BUCKET = 4096


def unwrap(positions: DataFrame, lengths: Sequence[str] = ("a", "b", "c")) -> DataFrame:
    """Undo periodic wrapping with minimum-image steps in an orthorhombic cell.

    ``positions`` carries the cell lengths of its frame. A step uses the cell of its later frame.
    A trajectory with an invalid cell anywhere passes through unchanged.
    """
    ok = " AND ".join(f"{n} > 0 AND {n} < double('infinity')" for n in lengths)
    usable = positions.groupBy("traj").agg(F.expr(f"bool_and(coalesce({ok}, false))").alias("_usable"))
    rest = [c for c in positions.columns if c not in {"traj", "atom_id", "frame", *XYZ, *lengths}]
    df = positions.selectExpr("traj", "atom_id", "frame", *XYZ, *lengths, *rest,
                              f"frame div {FRAMES_PER_BUCKET} AS _b")
    w = "(PARTITION BY traj, atom_id, _b ORDER BY frame)"
    step = {n: f"coalesce({{d}} - {length}*rint({{d}}/{length}), 0D)" for n, length in zip(XYZ, lengths)}
    df = df.selectExpr("*", *[step[n].format(d=f"({n} - lag({n}) OVER {w})") + f" AS _s{n}" for n in XYZ])
    # Bucket summaries: travelled path inside, and the step over the border from the bucket before.
    buckets = df.groupBy("traj", "atom_id", "_b").agg(
        *[F.sum(f"_s{n}").alias(f"t{n}") for n in XYZ], *[F.min_by(n, "frame").alias(f"f{n}") for n in XYZ],
        *[F.max_by(n, "frame").alias(f"l{n}") for n in XYZ], *[F.min_by(n, "frame").alias(f"c{n}") for n in lengths])
    wb = "(PARTITION BY traj, atom_id ORDER BY _b)"
    buckets = buckets.selectExpr("traj", "atom_id", "_b", *[f"t{n}" for n in XYZ], *[
        f"coalesce({{d}} - c{length}*rint({{d}}/c{length}), f{n}) AS j{n}".replace(
            "{d}", f"(f{n} - lag(l{n}) OVER {wb})") for n, length in zip(XYZ, lengths)])
    upto = wb[:-1] + " ROWS UNBOUNDED PRECEDING)"
    buckets = buckets.selectExpr("traj", "atom_id", "_b", *[
        f"sum(j{n}) OVER {upto} + sum(t{n}) OVER {upto} - t{n} AS _o{n}" for n in XYZ])
    df = df.join(buckets, ["traj", "atom_id", "_b"]).join(usable, "traj")
    run = w[:-1] + " ROWS UNBOUNDED PRECEDING)"
    return df.selectExpr("traj", "frame", "atom_id", *[
        f"CASE WHEN _usable THEN _o{n} + sum(_s{n}) OVER {run} ELSE {n} END AS {n}" for n in XYZ], *lengths, *rest)


def drift(positions: DataFrame, weight: Column | None = None) -> DataFrame:
    """Centre of the given atoms per frame, relative to the trajectory's first frame."""
    w = F.lit(1.0) if weight is None else weight
    centre = positions.groupBy("traj", "frame").agg(
        *[(F.sum(w * F.col(n)) / F.sum(w)).alias(n) for n in XYZ])
    start = centre.groupBy("traj").agg(*[F.min_by(n, "frame").alias(f"{n}0") for n in XYZ])
    return centre.join(start, "traj").select(
        "traj", "frame", *[(F.col(n) - F.col(f"{n}0")).alias(f"d{n}") for n in XYZ])


def subtract(particles: DataFrame, shift: DataFrame) -> DataFrame:
    """Particles minus a per-frame shift (traj, frame, dx, dy, dz)."""
    out = particles.join(shift, ["traj", "frame"])
    return out.withColumns({n: F.col(n) - F.col(f"d{n}") for n in XYZ}).drop("dx", "dy", "dz")


def remove_drift(particles: DataFrame, reference: DataFrame, weight: Column | None = None) -> DataFrame:
    return subtract(particles, drift(reference, weight))


def mean_position(particles: DataFrame) -> DataFrame:
    """Average particle position per frame, as a shift for ``subtract`` (a reference frame)."""
    return particles.groupBy("traj", "frame").agg(*[F.avg(n).alias(f"d{n}") for n in XYZ])


def select_frames(df: DataFrame, discard: int = 0, stride: int = 1, stop: int | None = None) -> DataFrame:
    """Drop leading frames, then keep every ``stride``-th, and renumber from 0."""
    if stride <= 0:
        raise ValueError("stride must be positive")
    keep = (F.col("frame") >= discard) & ((F.col("frame") - discard) % stride == 0)
    if stop is not None:
        keep = keep & (F.col("frame") < stop)
    return df.where(keep).withColumn("frame", F.floor((F.col("frame") - discard) / stride))


# --- lag correlations -----------------------------------------------------------------------

DIRECT_LAGS = 128
CHUNK_CELLS = 1 << 20


def _place(values: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int, m: int) -> np.ndarray:
    """Scatter (row, position) values into a dense zero-filled (m, n) or (m, n, 3) array."""
    out = np.zeros((m, n, *values.shape[1:]))
    ok = (at >= 0) & (at < n)
    out[rows[ok], at[ok]] = values[ok]
    return out


def _tile_sums(first: int, m: int, rows: np.ndarray, frames: np.ndarray, a: np.ndarray | None, b: np.ndarray | None,
               size: int, lag0: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums, one row per series, over all origins of (a(f+lag)-a(f)).(b(f+lag)-b(f)), and origin counts.

    ``rows`` says which of the m series a frame belongs to. Origins are [first, first+size), lags are
    lag0 .. lag0+lags-1; frames may have gaps. Without ``a`` only the counts are wanted.
    """
    total, count = np.zeros((m, lags)), np.zeros((m, lags))
    last = int(frames.max())
    size = min(size, last - first + 1)
    used = min(lags, last - first - lag0 + 1)
    if size <= 0 or used <= 0:
        return total, count
    span = size + used - 1
    one = np.ones(len(frames))
    om = _place(one, rows, frames - first, size, m)
    pm = _place(one, rows, frames - first - lag0, span, m)
    if a is not None:
        oa, pa = _place(a, rows, frames - first, size, m), _place(a, rows, frames - first - lag0, span, m)
        same = b is None
        ob, pb = (oa, pa) if same else (_place(b, rows, frames - first, size, m),
                                        _place(b, rows, frames - first - lag0, span, m))
    if used <= DIRECT_LAGS:
        for k in range(used):
            w = om * pm[:, k:k + size]
            count[:, k] = w.sum(axis=1)
            if a is not None:
                da = pa[:, k:k + size] - oa
                db = da if same else pb[:, k:k + size] - ob
                total[:, k] = np.einsum("ij,ijc,ijc->i", w, da, db)
        return total, count
    nfft = 1 << int(size + span - 1).bit_length()

    def corr(u, v):
        r = np.fft.irfft(np.fft.rfft(u, n=nfft, axis=1).conj() * np.fft.rfft(v, n=nfft, axis=1), n=nfft, axis=1)[:, :used]
        return r.sum(axis=2) if r.ndim == 3 else r

    count[:, :used] = np.rint(corr(om, pm))
    if a is not None:
        oab, pab = (oa * ob).sum(axis=2), (pa * pb).sum(axis=2)
        total[:, :used] = corr(om, pab) + corr(oab, pm) - corr(oa, pb) - corr(ob, pa)
    return total, count


def lag_products(series: DataFrame, keys: Sequence[str], series_id: str, max_lag: int,
                 cross: bool = False, tile: int = 8192, counts_only: bool = False) -> DataFrame:
    """Window-averaged displacement products: keys, lag, total, n.

    ``series`` holds keys, ``series_id``, frame, x, y, z (and bx, by, bz when ``cross``).
    ``total`` sums (a(f+lag)-a(f)).(b(f+lag)-b(f)) over all origins f and all series of a key and
    ``n`` counts them, so total/n is the exact window average; b is a unless ``cross``. With
    ``counts_only`` no coordinates are needed: ``n`` is how often f and f+lag are both present.

    Frames are cut into tiles of origins and lags into tiles as well; a task sees at most three
    tiles of one series, however long the trajectory is or how large ``max_lag`` is. Each Arrow
    batch is reduced before anything is shuffled; the series of one tile are worked on together
    whatever their keys, so that many short keys cost no more than a few long ones.
    """
    tile = max(2, min(tile, max_lag + 1))
    lag_tiles = (max_lag + tile) // tile
    cols = [] if counts_only else [*XYZ, "bx", "by", "bz"] if cross else list(XYZ)
    # A tile of frames serves as origins, and as partners of earlier origin tiles.
    roles = f"""filter(flatten(transform(sequence(0L, {lag_tiles - 1}L), k ->
        if(k = 0, array(struct(_q as c, k as k), struct(_q - 1 as c, k as k)),
                  array(struct(_q as c, k as k), struct(_q - k as c, k as k),
                        struct(_q - k - 1 as c, k as k))))), r -> r.c >= 0)"""
    packed = (series.selectExpr(*keys, series_id, "frame", *cols, f"frame div {tile} AS _q")
              .groupBy(*keys, series_id, "_q")
              .agg(F.collect_list(F.struct("frame", *cols)).alias("rows"))
              .selectExpr(*keys, series_id, f"explode({roles}) AS role", "rows")
              .groupBy(*keys, series_id, F.col("role.c").alias("c"), F.col("role.k").alias("k"))
              .agg(F.flatten(F.collect_list("rows")).alias("rows"))
              .sortWithinPartitions("c", "k", *keys)
              .selectExpr(*keys, "c", "k", "rows.frame AS frame", *[f"rows.{n} AS {n}" for n in cols]))
    key_names = list(keys)

    def stacked(group: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
        return np.column_stack([np.concatenate(group[n].to_list()) for n in names])

    def reduce_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (c, k), group in pdf.dropna(subset=key_names).groupby(["c", "k"], sort=False):
                c, k = int(c), int(k)
                lags = min(tile, max_lag + 1 - k * tile)
                step = max(1, CHUNK_CELLS // (2 * tile))
                for at in range(0, len(group), step):
                    part = group.iloc[at:at + step]
                    frames = np.concatenate(part["frame"].to_list()).astype(np.int64)
                    rows = np.repeat(np.arange(len(part)), [len(v) for v in part["frame"]])
                    a = None if counts_only else stacked(part, XYZ)
                    b = stacked(part, ("bx", "by", "bz")) if cross else None
                    got = _tile_sums(c * tile, len(part), rows, frames, a, b, tile, k * tile, lags)
                    owners = part.groupby(key_names, sort=False)
                    owner = owners.ngroup().to_numpy()
                    total, n = np.zeros((owners.ngroups, lags)), np.zeros((owners.ngroups, lags))
                    np.add.at(total, owner, got[0])
                    np.add.at(n, owner, got[1])
                    which, lag = np.nonzero(n > 0)
                    out = part.loc[~part.duplicated(key_names), key_names].iloc[which].reset_index(drop=True)
                    yield out.assign(lag=lag + k * tile, total=total[which, lag], n=n[which, lag].astype(np.int64))

    types = dict(series.dtypes)
    schema = ", ".join([f"`{n}` {types[n]}" for n in keys] + ["lag bigint", "total double", "n bigint"])
    parts = packed.mapInPandas(reduce_batch, schema)
    return parts.groupBy(*keys, "lag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def lag_join(series: DataFrame, keys: Sequence[str], series_id: str, max_lag: int) -> DataFrame:
    """``lag_products`` as a plain self join of frames up to ``max_lag`` apart; for short curves and as a check.

    Frames are cut into tiles as wide as the lags, so a partner stands in the origin's tile or the next one: a row is
    shuffled once as origin and twice as partner, whatever the number of lags.
    """
    tile = max_lag + 1
    a = series.select(*keys, series_id, F.floor(F.col("frame") / tile).alias("_q"), F.col("frame").alias("_from"), *[F.col(n).alias(f"o{n}") for n in XYZ])
    q = F.floor(F.col("frame") / tile)
    d = (a.join(series.select(*keys, series_id, F.explode(F.array(q - 1, q)).alias("_q"), "frame", *XYZ), [*keys, series_id, "_q"])
         .withColumn("lag", F.col("frame").cast("long") - F.col("_from").cast("long")).where(F.col("lag").between(0, max_lag)))
    sq = sum(((F.col(n) - F.col(f"o{n}")) * (F.col(n) - F.col(f"o{n}")) for n in XYZ), F.lit(0.0))
    return d.groupBy(*keys, "lag").agg(F.sum(sq).alias("total"), F.count(F.lit(1)).alias("n"))


def msd(particles: DataFrame, keys: Sequence[str], series_id: str, max_lag: int, dt: float,
        clamp: bool = False) -> DataFrame:
    """Mean-squared displacement per key and lag: keys, lag, time, msd, n."""
    value = F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(F.col("total") / F.col("n"))
    if clamp:
        value = F.greatest(value, F.lit(0.0))
    return lag_products(particles, keys, series_id, max_lag).select(
        *keys, "lag", (F.col("lag") * F.lit(float(dt))).alias("time"), value.alias("msd"), "n")


def diffusion_from_origin(curve: DataFrame) -> DataFrame:
    """MSD/(6t) per lag in A^2/ns, m^2/s, cm^2/s and 1e-5 cm^2/s; NULL at t = 0."""
    d = F.when(F.col("time") > 0, F.col("msd") / (F.lit(6.0) * F.col("time")))
    return curve.withColumns({"D_A2_per_ns": d, "D_m2_per_s": d * 1.0e-11, "D_cm2_per_s": d * 1.0e-7,
                              "D_1e5_cm2_per_s": d * 1.0e-7 / 1.0e-5})
