import random

import pytest
from pyspark.sql import functions as F

from mdframes.operators import molecules as M
from mdframes.operators import selection as SEL

ATOMS = "traj string, atom_id bigint, name string, atom_type int, bonds array<bigint>"


def graph(spark, n, edges):
    bonds = {k: [] for k in range(n)}
    for a, b in edges:
        bonds[a].append(b)
    return spark.createDataFrame([("t", k, "X", k % 3, bonds[k]) for k in range(n)], ATOMS)


def expected(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(0, 39)]
    star = [(60, k) for k in range(61, 80)]
    loose = [(rng.randrange(80, 120), rng.randrange(80, 120)) for _ in range(25)]
    edges = chain + star + loose
    a = graph(spark, 120, edges)
    got = {r["atom_id"]: r["mol_id"] for r in M.components(a, M.bond_edges(a)).collect()}
    assert [got[k] for k in range(120)] == expected(120, edges)


def test_bond_to_unknown_atom_is_an_error(spark):
    a = graph(spark, 3, [(0, 1), (1, 7)])
    assert M.invalid_bonds(a).count() == 1
    with pytest.raises(Exception, match="unknown atom"):
        M.bond_edges(a).collect()


def test_counts_and_changes(spark):
    a = graph(spark, 6, [(0, 1), (1, 2), (3, 4)])
    mols = a.join(M.components(a, M.bond_edges(a)), ["traj", "atom_id"])
    sel = [SEL.EntitySelection("one", (0,)), SEL.EntitySelection("any", (0, 2), "molecule"),
           SEL.EntitySelection("all", (0, 1, 2), "molecule", "all")]
    assert {r["token"]: r["n"] for r in M.entity_counts(mols, sel).collect()} == {"one": 2, "any": 3, "all": 1}
    replay = a.withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    odd = replay.withColumn("atom_type", F.when((F.col("frame") == 2) & (F.col("atom_id") == 1), 9).otherwise(F.col("atom_type")))
    assert [r["frame"] for r in M.changed_frames(odd).collect()] == [2]
    assert M.changed_frames(odd.where("NOT (frame = 1 AND atom_id = 0)"), strict=False).count() == 1


def test_specs():
    assert SEL.parse_entities(["Li FSA:6,7"])[0].token == "Li_FSA"
    with pytest.raises(ValueError):
        SEL.parse_entities(["a b:1", "a_b:2"])
    with pytest.raises(ValueError):
        SEL.parse_species(["Li:6"], "types")
    assert SEL.parse_target("FSA:SN:71", "solvent").label == "SN"
    assert SEL.parse_pair("Li-O") == ("Li", "O")


def test_frame_range_errors(spark):
    fr = spark.createDataFrame([("t", k) for k in range(10)], "traj string, frame bigint")
    assert [r["frame"] for r in SEL.frame_range(fr, start_frame=-4, stride=2).orderBy("frame").collect()] == [6, 8]
    with pytest.raises(Exception, match="frame range"):
        SEL.frame_range(fr, start_frame=10).collect()


def species_atoms(spark):
    rows = [("t", 0, "Li", "Li", "LI", "L", 0, "", 6, 6.94), ("t", 1, "N", "N", "FSA", "A", 1, "", 72, 14.0), ("t", 2, "O", "O", "FSA", "A", 1, "", 81, 16.0)]
    return spark.createDataFrame(rows, "traj string, atom_id bigint, name string, element string, resname string, chain string, resid bigint, icode string, atom_type int, mass double")


def test_empty_species_is_an_error(spark):
    a = species_atoms(spark)
    fine = [SEL.Target("Li", ("Li",), 1.0), SEL.Target("FSA", ("FSA",), -1.0, "residues")]
    assert SEL.build_species(a, fine).count() == 3
    with pytest.raises(Exception, match="no particles found for species Xe"):
        SEL.build_species(a, [*fine, SEL.Target("Xe", ("Xe",), 1.0)]).collect()
    both = a.unionByName(a.where("element <> 'Li'").withColumn("traj", F.lit("u")))
    with pytest.raises(Exception, match="no particles found for species Li"):
        SEL.build_species(both, fine).collect()


def test_missing_anchor_is_an_error(spark):
    a = species_atoms(spark)
    assert {r["atom_id"] for r in SEL.molecules_by_anchor(a, "fsa", ["O"], "resname").collect()} == {2}
    with pytest.raises(Exception, match="anchor 99 matched no atoms in t"):
        SEL.molecules_by_anchor(a, 99, ["O"]).collect()


def test_flow_needs_ions_and_frames(spark):
    from mdframes.plans.transport import transport
    from mdframes.sources.pdb import Trajectory
    a = species_atoms(spark)
    frames = spark.range(9).selectExpr("'t' AS traj", "id AS frame", "3L AS n_atoms", "20D AS a", "20D AS b", "20D AS c", "90D AS alpha", "90D AS beta", "90D AS gamma")
    pos = frames.select("traj", "frame").crossJoin(a.select("atom_id")).selectExpr("*", "double(atom_id) AS x", "0D AS y", "0D AS z")
    t = Trajectory(frames, a, pos)
    temp = spark.createDataFrame([("t", 300.0)], "traj string, temperature_K double")
    ions = [SEL.Target("Li", ("Li",), 1.0), SEL.Target("FSA", ("FSA",), -1.0, "residues")]
    with pytest.raises(ValueError, match="positive"):
        transport(t, [ions[0], SEL.Target("N", ("N",), 1.0)], temp, 0.2, 5, (0.2, 1.0))
    with pytest.raises(Exception, match="too few frames left in t"):
        transport(t, ions, temp, 0.2, 5, (0.2, 1.0))


@pytest.mark.parametrize("spec,role,want", [
    ("FSA:72", "anion", ("FSA", "72", None)), (" FSA : 72 : -1 ", "anion", ("FSA", "72", -1.0)), ("X:SN:71", "solvent", ("SN", "71", None)),
    ("SN:71:0", "solvent", ("SN", "71", 0.0)), ("A:b:1.5", "anion", ("A", "b", 1.5)), ("SN:NIT", "solvent", ("SN", "NIT", None))])
def test_target_forms(spec, role, want):
    t = SEL.parse_target(spec, role)
    assert (t.label, t.values[0], t.charge) == want


@pytest.mark.parametrize("spec", ["FSA", "FSA:", ":72", "a:b:c:d", "FSA:72:x"])
def test_target_errors(spec):
    with pytest.raises(ValueError):
        SEL.parse_target(spec)


@pytest.mark.parametrize("held,most", [(1 << 20, 2), (1 << 10, 9)])
def test_long_chain_in_few_rounds(spark, monkeypatch, held, most):
    """100,000 atoms in a row: one contraction if a task holds them all, few rounds if a hundred tasks hold pieces."""
    rounds = []
    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "stage", lambda df, name, stage=M.stage: rounds.append(name) or stage(df, name))
    edges = spark.range(99_999).selectExpr("'t' AS traj", "id AS a", "id + 1 AS b")
    atoms = spark.range(100_001).selectExpr("'t' AS traj", "id AS atom_id")
    out = M.components(atoms, edges)
    assert out.where("mol_id <> 0 AND atom_id < 100000").count() == 0 and out.where("mol_id = 100000").count() == 1
    assert len(rounds) <= most, rounds


def test_whole_molecules_are_not_carried_along(spark, monkeypatch):
    """Molecules of ten atoms in ranges of a thousand: after the first contraction only those over a border are looked at again."""
    tables = []
    monkeypatch.setattr(M, "HELD", 1000)

    def stage(df, name, stage=M.stage):
        tables.append((name, stage(df, name)))
        return tables[-1][1]

    monkeypatch.setattr(M, "stage", stage)
    edges = spark.range(19_999).where("id % 10 <> 4").selectExpr("'t' AS traj", "id AS a", "id + 1 AS b")
    out = M.components(spark.range(20_000).selectExpr("'t' AS traj", "id AS atom_id"), edges)
    assert out.where("mol_id <> greatest(0, (atom_id + 5) div 10 * 10 - 5)").count() == 0
    first, *later = [t.count() for name, t in tables if name == "stars"]
    assert first > 17_000 and sum(later) < 500, (first, later)


def test_components_of_scattered_numbers(spark, monkeypatch):
    """Bonds between any atoms of several trajectories, in ranges of a few atoms; the same number in two trajectories is two atoms."""
    monkeypatch.setattr(M, "HELD", 16)
    rng = random.Random(8)
    want, rows = {}, []
    for traj in "abc":
        pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
        rows += [(traj, min(p), max(p)) for p in pairs if p[0] != p[1]]
        want.update({(traj, k): low for k, low in enumerate(expected(300, pairs))})
    atoms = spark.createDataFrame([(t, k) for t, k in want], "traj string, atom_id bigint")
    got = M.components(atoms, spark.createDataFrame(rows, "traj string, a bigint, b bigint"))
    assert {(r["traj"], r["atom_id"]): r["mol_id"] for r in got.collect()} == want


def test_components_without_bonds(spark):
    atoms = spark.createDataFrame([("a", 1), ("a", 2)], "traj string, atom_id bigint")
    assert M.components(atoms, spark.createDataFrame([], "traj string, a bigint, b bigint")).where("mol_id = atom_id").count() == 2


def test_counts_are_not_multiplied_by_selections(spark):
    """One aggregate per molecule and one per trajectory; null types, null molecules and types asked for twice."""
    rows = [("t", 1, 7), ("t", 1, 8), ("t", 2, 7), ("t", 2, None), ("t", 3, None), ("t", None, 8), ("u", 1, 9)]
    mols = spark.createDataFrame(rows, "traj string, mol_id bigint, atom_type int")
    sel = [SEL.EntitySelection("atoms", (7, 8)), SEL.EntitySelection("any", (7, 8), "molecule"), SEL.EntitySelection("all", (7, 8), "molecule", "all"),
           SEL.EntitySelection("twice", (7, 7), "molecule", "all"), SEL.EntitySelection("none", (1,), "molecule")]
    got = M.entity_counts(mols, sel)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 2
    assert {(r["traj"], r["token"]): r["n"] for r in got.collect()} == {
        ("t", "atoms"): 4, ("t", "any"): 3, ("t", "all"): 1, ("t", "twice"): 0, ("t", "none"): 0,
        ("u", "atoms"): 0, ("u", "any"): 0, ("u", "all"): 0, ("u", "twice"): 0, ("u", "none"): 0}


def test_years_of_frames_are_not_shuffled_by(spark, tmp_path):
    """Atoms replayed in every year stay where they are read: the join on years moves only the years."""
    from mdframes.catalog import QUERIES
    rows = [(k, k % 5, f"{1992 + k % 3}-01-0{1 + k % 9}", "1-URGENT") for k in range(60)]
    o = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate string, o_orderpriority string")
    o.withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["topology_check"](spark, str(tmp_path))
    assert [tuple(r) for r in got.orderBy("frame").collect()] == [(1993, 60, 60), (1994, 60, 60)]
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "frame#" in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins)
