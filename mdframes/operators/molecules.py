"""Bond graphs: molecules as connected components, entity counts, inventories, topology checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdframes.operators.neighbors import short_contacts  # noqa: F401  (part of this surface)
from mdframes.staging import stage


HELD = 1 << 20          # atoms of a range; a task contracts up to twice as many bonds together


def _lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each node 0..n-1 the lowest node that the links a[i]-b[i] join it to."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while not np.array_equal(low, low[low]):        # follow the pointers to their ends
            low = low[low]
        still = low[a] != low[b]
        a, b = a[still], b[still]
    return low


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bonds of a task, sorted by range, as stars (traj, u, v), v being the lowest atom that they join u to. Whole
    ranges are contracted together, unless one has more bonds than a task should hold."""
    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        code = t["traj"].combine_chunks().dictionary_encode()
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        traj, atom = np.tile(code.indices.to_numpy(zero_copy_only=False), 2), np.concatenate([a, b])
        order = np.lexsort([atom, traj])
        new = np.append(True, (np.diff(traj[order]) != 0) | (np.diff(atom[order]) != 0))
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        first = order[new]                              # a place of each node
        low = _lowest(node[:len(a)], node[len(a):], len(first))
        far = np.flatnonzero(low != np.arange(len(low)))
        yield from pa.table({"traj": code.dictionary.take(pa.array(traj[first[far]])), "u": atom[first[far]], "v": atom[first[low[far]]]}).to_batches(1 << 16)

    held, size, last = [], 0, None
    for batch in batches:
        part = batch.column(3).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if size >= 2 * HELD or size >= HELD // 2 and part[a] != last:
                    yield from stars(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size, last = size + b - a, part[a]
    if size:
        yield from stars(held)


def bond_edges(atoms: DataFrame) -> DataFrame:
    """Distinct undirected bonds (traj, a < b); a bond to an unknown atom is an error."""
    raw = atoms.select("traj", "atom_id", F.explode("bonds").alias("other"))
    known = atoms.select("traj", F.col("atom_id").alias("other"), F.lit(True).alias("_known"))
    checked = raw.join(known, ["traj", "other"], "left")
    bad = F.raise_error(F.concat_ws(" ", F.lit("bond to unknown atom:"), F.col("atom_id").cast("string"),
                                    F.lit("->"), F.col("other").cast("string"))).cast("bigint")
    other = F.when(F.col("_known").isNull(), bad).otherwise(F.col("other"))
    pair = checked.select("traj", "atom_id", other.alias("other")).where(F.col("atom_id") != F.col("other"))
    return pair.select("traj", F.least("atom_id", "other").alias("a"),
                       F.greatest("atom_id", "other").alias("b")).distinct()


def invalid_bonds(atoms: DataFrame) -> DataFrame:
    """Bonds to atoms that do not exist (traj, atom_id, other)."""
    raw = atoms.select("traj", "atom_id", F.explode("bonds").alias("other"))
    return raw.join(atoms.select("traj", F.col("atom_id").alias("other")), ["traj", "other"], "left_anti")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of large-star or small-star over directed edges (traj, u, v), v < u for small."""
    if large:
        both = edges.unionByName(edges.select("traj", F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("traj", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # A hub's minimum is aggregated before the shuffle, and its joined rows are split by the adaptive skew join.
    lowest = both.groupBy("traj", "u").agg(F.min("v").alias("m")).select("traj", "u", F.least("u", "m").alias("m"))
    joined = both.join(lowest, ["traj", "u"])
    if large:
        # Duplicates are harmless here; the small star that follows removes them.
        return joined.where("v > u AND v <> m").select("traj", F.col("v").alias("u"), F.col("m").alias("v"))
    link = joined.select("traj", F.col("v").alias("u"), F.col("m").alias("v"))
    out = link.unionByName(lowest.select("traj", "u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _unsettled(links: DataFrame) -> DataFrame:
    """Atoms (traj, node) that have several links down, or are a leaf and a centre at once: a group of links without
    such an atom is one star."""
    ends = links.select("traj", F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        links.select("traj", "v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("traj", "node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR up = 1 AND down = 1").select("traj", "node")


def components(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """Molecule of each atom: traj, atom_id, mol_id (the lowest atom id of the component).

    Bonds are dealt by ranges of atom numbers, which mostly keeps molecules together, and each task first contracts its
    bonds to stars. Stars that touch no other are whole molecules and stay as they are; alternating large-star and small-star steps
    join the others: the number of rounds grows with the logarithm of the number of stars in a row. Every round is a written
    table, and the search ends when all stars stand alone.
    """
    kind = edges.schema["traj"].dataType.simpleString()
    ids = edges.select("traj", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    near = ids.withColumn("part", F.xxhash64("traj", F.floor(F.col("a") / HELD))).repartition("part").sortWithinPartitions("part")
    cur = stage(near.mapInArrow(_contracted, f"traj {kind}, u long, v long").distinct(), "stars")
    whole = []
    while True:
        loose = stage(_unsettled(cur), "loose")
        if loose.isEmpty():
            break
        centres = stage(cur.join(loose.withColumnRenamed("node", "u"), ["traj", "u"], "left_semi").select("traj", "v").unionAll(
            cur.join(loose.withColumnRenamed("node", "v"), ["traj", "v"], "left_semi").select("traj", "v")).distinct(), "centres")
        whole.append(cur.join(centres, ["traj", "v"], "left_anti").select("traj", "u", "v"))
        cur = stage(_star(_star(cur.join(centres, ["traj", "v"], "left_semi"), True), False), "stars")
    for part in whole:
        cur = cur.unionByName(part)
    return (atoms.select("traj", "atom_id")
            .join(cur.select("traj", F.col("u").alias("atom_id"), F.col("v").alias("mol_id")),
                  ["traj", "atom_id"], "left")
            .select("traj", "atom_id", F.coalesce("mol_id", "atom_id").alias("mol_id")))


def entity_counts(atoms: DataFrame, selections: Sequence) -> DataFrame:
    """Entities per trajectory and selection: traj, token, n.

    ``atoms`` carries mol_id and atom_type. A molecule matches when it has any (or all) of the
    selection's types. One aggregate per molecule holds what all selections ask, so that nothing is multiplied by them.
    """
    def counted(s, i: int) -> Column:
        if s.mode == "atom":
            return F.sum(f"n{i}")
        n_types = sum((F.col(f"h{i}_{k}").cast("int") for k in range(len(set(s.atom_types)))), F.lit(0))
        return F.sum((n_types == len(s.atom_types) if s.match == "all" else n_types > 0).cast("long"))

    kind = F.col("atom_type")
    marks = [m for i, s in enumerate(selections) for m in
             ([F.count_if(kind.isin(list(s.atom_types))).alias(f"n{i}")] if s.mode == "atom" else
              [F.coalesce(F.bool_or(kind == t), F.lit(False)).alias(f"h{i}_{k}") for k, t in enumerate(sorted(set(s.atom_types)))])]
    mol = atoms.groupBy("traj", "mol_id").agg(*marks)
    each = mol.groupBy("traj").agg(*[counted(s, i).alias(f"c{i}") for i, s in enumerate(selections)])
    named = F.explode(F.array(*[F.struct(F.lit(s.token).alias("token"), F.col(f"c{i}").alias("n")) for i, s in enumerate(selections)]))
    return each.select("traj", named.alias("s")).groupBy("traj", "s.token").agg(F.sum("s.n").alias("n"))


def type_inventory(atoms: DataFrame) -> DataFrame:
    """Per atom type: atoms, ``name:count`` list, molecules that contain it."""
    by_name = atoms.groupBy("traj", "atom_type", "name").agg(F.count(F.lit(1)).alias("k"))
    names = by_name.groupBy("traj", "atom_type").agg(
        F.sum("k").alias("atom_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "k"))),
                                 lambda s: F.concat(s["name"], F.lit(":"), s["k"].cast("string"))), ";")
        .alias("atom_names_and_counts"))
    mols = (atoms.select("traj", "atom_type", "mol_id").distinct().groupBy("traj", "atom_type")
            .agg(F.count(F.lit(1)).alias("connected_components_containing_type")))
    return names.join(mols, ["traj", "atom_type"])


def missing_types(atoms: DataFrame, selections: Sequence) -> DataFrame:
    """Requested atom types that no trajectory atom has: traj, token, atom_type."""
    want = F.array(*[F.struct(F.lit(s.token).alias("token"), F.lit(t).alias("atom_type"))
                     for s in selections for t in s.atom_types])
    kinds = atoms.select("traj", "atom_type").distinct()
    asked = kinds.select("traj").distinct().withColumn("s", F.explode(want)).select("traj", "s.*")
    return asked.join(kinds, ["traj", "atom_type"], "left_anti")


def topology_signature(atoms: DataFrame, keys: Sequence[str] = ("traj", "frame"), strict: bool = True) -> DataFrame:
    """Order-free fingerprint of ids, types and sorted distinct bonds per frame, and atom count.

    A sum of row hashes combines map-side; no frame's atoms are gathered.
    """
    row = (F.xxhash64("atom_id", "atom_type", F.array_sort(F.array_distinct("bonds"))) if strict
           else F.lit(0).cast("bigint"))
    return atoms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_atoms"),
                                    F.sum(row.cast("decimal(38,0)")).alias("signature"))


def changed_frames(atoms: DataFrame, strict: bool = True) -> DataFrame:
    """Frames whose atom count (or, if strict, topology) differs from the first frame's."""
    sig = topology_signature(atoms, strict=strict)
    first = sig.groupBy("traj").agg(F.min_by("n_atoms", "frame").alias("n0"),
                                    F.min_by("signature", "frame").alias("s0"))
    return (sig.join(first, "traj").where((F.col("n_atoms") != F.col("n0")) | (F.col("signature") != F.col("s0")))
            .select("traj", "frame", "n_atoms", F.col("n0").alias("n_atoms_first")))


def topology_summary(atoms: DataFrame, top: int = 50) -> DataFrame:
    """Counts by element, residue name, atom type, and the ``top`` most frequent names."""
    kinds = [("element", "element"), ("resname", "resname"), ("atom_type", "atom_type")]
    def tally(kind: str, col: str) -> DataFrame:
        return atoms.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("<blank>")).alias("value")).agg(
            F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    out = tally(*kinds[0])
    for k in kinds[1:]:
        out = out.unionByName(tally(*k))
    names = tally("name", "name").orderBy(F.desc("n"), "value").limit(top)
    return out.unionByName(names)


def residue_summary(atoms: DataFrame) -> DataFrame:
    """Residues by size and element set: resname, n_atoms, elements, n_residues."""
    res = atoms.groupBy("traj", "chain", "resid", "resname").agg(
        F.count(F.lit(1)).alias("n_atoms"),
        F.array_join(F.array_sort(F.collect_set("element")), ",").alias("elements"))
    return res.groupBy("resname", "n_atoms", "elements").agg(F.count(F.lit(1)).alias("n_residues"))


def composition(atoms: DataFrame) -> DataFrame:
    """Element formula of each molecule, e.g. ``F2N1O4S2`` (atoms carry mol_id and element)."""
    k = atoms.groupBy("traj", "mol_id", "element").agg(F.count(F.lit(1)).alias("k"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("element", "k"))),
                        lambda s: F.concat(s["element"], s["k"].cast("string")))
    return k.groupBy("traj", "mol_id").agg(F.array_join(parts, "").alias("formula"))


def retag(atoms: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """New atom types from molecule formula, element and bonded elements.

    ``rules``: formula, element, neighbour (an element that must be bonded, or NULL for any),
    new_type. A rule with a neighbour beats one without. Atoms without a rule keep their type.
    """
    form = composition(atoms)
    both = edges.select("traj", F.col("a").alias("atom_id"), F.col("b").alias("o")).unionByName(
        edges.select("traj", F.col("b").alias("atom_id"), F.col("a").alias("o")))
    near = (both.join(atoms.select("traj", F.col("atom_id").alias("o"), F.col("element").alias("ne")), ["traj", "o"])
            .groupBy("traj", "atom_id").agg(F.collect_set("ne").alias("near")))
    df = atoms.join(form, ["traj", "mol_id"]).join(near, ["traj", "atom_id"], "left")
    r = rules.select("formula", "element", F.col("neighbour").alias("_nb"), F.col("new_type").alias("_new"))
    hit = df.join(r, ["formula", "element"], "left")
    fits = F.col("_nb").isNull() | F.coalesce(F.array_contains("near", F.col("_nb")), F.lit(False))
    rank = F.when(fits & F.col("_new").isNotNull(), F.when(F.col("_nb").isNotNull(), 2).otherwise(1))
    return hit.groupBy("traj", "atom_id", "mol_id", "element", "formula", "atom_type").agg(
        F.max_by("_new", rank).alias("_t")).select(
        "traj", "atom_id", "mol_id", "element", "formula", F.coalesce("_t", "atom_type").alias("atom_type"))
