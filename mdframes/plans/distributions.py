"""Radial and angular distribution flows over an ingested trajectory."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.operators import structure as S
from mdframes.operators.neighbors import attach_cell
from mdframes.operators.selection import frame_range, parse_pair
from mdframes.sources.pdb import Trajectory
from mdframes.staging import stage


def site_positions(t: Trajectory, **frames) -> DataFrame:
    """Positions with site and cell, limited to a frame range (see ``selection.frame_range``)."""
    keep = frame_range(t.frames.select("traj", "frame"), **frames)
    pos = attach_cell(t.positions, t.frames.join(keep, ["traj", "frame"], "left_semi"))
    return pos.join(t.atoms.select("traj", "atom_id", "site"), ["traj", "atom_id"])


def radial(t: Trajectory, pairs: Sequence[str], rmax: float = 8.0, bin_width: float = 0.01,
           volume: str = "frame", **frames) -> DataFrame:
    """g(r) and coordination number of every pair ``A-B``: traj, pair, bin, r, g, count, cn."""
    sites = stage(site_positions(t, **frames), "sites")
    out = [S.rdf(sites, *parse_pair(p), rmax, bin_width, volume).withColumn("pair", F.lit(p)) for p in pairs]
    return functools.reduce(DataFrame.unionByName, out)


def angular(t: Trajectory, triplets: Sequence[tuple[str, str, str]], rcut12: float, rcut23: float,
            bin_width: float = 1.0, unique_terminals: bool = False, **frames) -> tuple[DataFrame, DataFrame]:
    """Angle distributions and their counters for every (end, centre, end) triplet."""
    sites = stage(site_positions(t, **frames), "sites")
    curves, counters = [], []
    for a, b, c in triplets:
        tri = stage(S.adf_triplets(sites, a, b, c, rcut12, rcut23, unique_terminals), "tri")
        label = F.lit(f"{a}-{b}-{c}")
        curves.append(S.adf(tri, bin_width, t.frames.select("traj")).withColumn("label", label))
        counters.append(S.adf_counters(tri).withColumn("label", label))
    return functools.reduce(DataFrame.unionByName, curves), functools.reduce(DataFrame.unionByName, counters)
