import gzip
import random

import pytest
from pyspark.sql import functions as F

from mdframes.sources import logs, pdb, sinks, text, xyz

CRYST = "CRYST1   20.000   21.000   22.000  90.00  90.00  90.00 P 1           1\n"


def atom(serial, name, x, el=""):
    return f"ATOM  {serial:5d} {name:<4s} LI  A{1:4d}    {x:8.3f}{2:8.3f}{3:8.3f}{1:6.2f}{72:6.2f}          {el:>2s}\n"


def frame(x, names=("LI", "WC")):
    return atom(1, names[0], x, "Li" if names[0] == "LI" else "") + atom(2, names[1], x + 1)


LAYOUTS = {
    "model": CRYST + "MODEL        1\n" + frame(1) + "ENDMDL\nMODEL        2\n" + frame(2) + "ENDMDL\nEND\n",
    "cryst": CRYST + frame(1) + CRYST + frame(2),
    "end": CRYST + frame(1) + "END\n" + frame(2) + "END\n",
    "serial": CRYST + frame(1) + frame(2) + "CONECT    1    2\n",
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("block", [None, "150"])
def test_pdb_layouts(spark, tmp_path, layout, block):
    (tmp_path / "a.pdb").write_text(LAYOUTS[layout])
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        t = pdb.read_pdb(spark, str(tmp_path))
        got = [(r["frame"], r["atom_id"], r["x"]) for r in t.positions.orderBy("frame", "atom_id").collect()]
        assert got == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)]
        assert [(r["n_atoms"], r["b"]) for r in t.frames.collect()] == [(2, 21.0)] * 2
        assert [(r["site"], r["element"], r["atom_type"]) for r in t.atoms.orderBy("atom_id").collect()] == [("Li", "Li", 72), ("WC", "C", 72)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pdb_gzip_and_whitespace(spark, tmp_path):
    with gzip.open(tmp_path / "g.pdb.gz", "wt") as f:
        f.write("ATOM  1 LI LI A 1 1.5 2.0 3.0\nATOM  2 O H2O 2 4.5 5.0 6.0\nEND\n" + CRYST)
    t = pdb.read_pdb(spark, str(tmp_path))
    assert [(r["traj"], r["x"]) for r in t.positions.orderBy("atom_id").collect()] == [("g", 1.5), ("g", 4.5)]
    assert t.frames.first()["a"] == 20.0  # header cell restored


@pytest.mark.parametrize("body,message", [
    (CRYST + frame(1) + "END\n" + atom(1, "LI", 2.0), "atom count changes"),
    (CRYST + frame(1) + "END\n" + frame(1, ("WC", "LI")), "site order changes")])
def test_pdb_errors(spark, tmp_path, body, message):
    (tmp_path / "a.pdb").write_text(body)
    with pytest.raises(Exception, match=message):
        pdb.read_pdb(spark, str(tmp_path)).frames.collect()


def test_pdb_strict_needs_a_cell(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(frame(1) + "END\n")
    assert pdb.read_pdb(spark, str(tmp_path)).frames.first()["a"] is None
    assert pdb.read_pdb(spark, str(tmp_path), user_box=(5, 6, 7)).frames.first()["c"] == 7.0
    with pytest.raises(Exception, match="without a cell"):
        pdb.read_pdb(spark, str(tmp_path), strict=True).frames.collect()


def xyz_frame(z, box=True, n=3):
    return (f"{n} water\n" + (" 20.0 20.0 20.0 90.0 90.0 90.0\n" if box else "")
            + f" 1 O 0.0 0.0 {z} 1 2 3\n 2 H 1.0D0 0.0 0.0 2 1\n 3 H 0.0 1.0 0.0 2 1 0\n")


@pytest.mark.parametrize("box", [True, False])
def test_xyz_archive(spark, tmp_path, box):
    (tmp_path / "m.arc").write_text(xyz_frame(1.0, box) + "\n" + xyz_frame(2.0, box))
    t = xyz.read_xyz(spark, str(tmp_path))
    assert [(r["frame"], r["z"]) for r in t.positions.where("atom_id = 1").orderBy("frame").collect()] == [(0, 1.0), (1, 2.0)]
    assert {r["atom_id"]: r["bonds"] for r in t.atoms.collect()} == {1: [2, 3], 2: [1], 3: [1]}
    assert t.frames.first()["a"] == (20.0 if box else None)


@pytest.mark.parametrize("body,message", [
    (xyz_frame(1.0) + "3 cut\n 20.0 20.0 20.0 90.0 90.0 90.0\n 1 O 0 0 0 1\n", "truncated"),
    (xyz_frame(1.0) + "4 more\n 20.0 20.0 20.0 90.0 90.0 90.0\n 1 O 0 0 0 1\n", "atom count changes")])
def test_xyz_errors(spark, tmp_path, body, message):
    (tmp_path / "m.arc").write_text(body)
    with pytest.raises(Exception, match=message):
        xyz.read_xyz(spark, str(tmp_path)).frames.collect()


def mixed(n, atoms=3):
    """Frames with and without a cell line; the atom named like a number looks like a cell line, the last id like a head."""
    rng, out = random.Random(n), []
    boxed = [rng.random() < 0.5 for _ in range(n)]
    for k, b in enumerate(boxed):
        out.append(f"{atoms} title {k}\n" + (" 20.0 21.0 2.2D1 90.0 90.0 90.0\n" if b else "")
                   + "".join(f" {i} {i + 6} {k + 0.5} 0.25 {i}.0 {i}\n" if i % 2 else f" {i} O {k + 0.5} 0.25 {i}.0 {i}\n" for i in range(1, atoms + 1)))
    return "".join(out), boxed


@pytest.mark.parametrize("width,block", [(1, "128m"), (7, "500b"), (1 << 16, "300b"), (50, "1k")])
def test_xyz_with_cells_in_some_frames(spark, tmp_path, width, block):
    """Frames are found whatever buckets and file blocks they are cut into."""
    names = {"a.arc": (40, 3), "b.arc": (25, 1), "c.arc": (30, 8)}
    want = {}
    for name, (n, atoms) in names.items():
        body, boxed = mixed(n, atoms)
        # A numeric atom behind a head without a cell line would be taken for one: such a frame begins with a named atom.
        body = body.replace(" 1 7 ", " 1 O ")
        (tmp_path / name).write_text(body)
        want.update({(name[0], k): (22.0 if b else None, f"title {k}") for k, b in enumerate(boxed)})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        t = xyz.read_xyz(spark, str(tmp_path), width=width)
        frames = {(r["traj"], r["frame"]): (r["c"], r["title"]) for r in t.frames.collect()}
        places = sorted((r["traj"], r["frame"], r["atom_id"], r["x"], r["z"]) for r in t.positions.collect())
        rows = xyz.topology_rows(text.read_lines(spark, str(tmp_path)), width=width).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert frames == want
    assert places == sorted((f, k, i, k + 0.5, float(i)) for f, k in want for i in range(1, names[f + ".arc"][1] + 1)) and rows == len(places)


@pytest.mark.parametrize("cut,message", [(lambda b: b[:-30], "truncated|malformed"), (lambda b: b.rsplit("\n", 3)[0] + "\n", "truncated"),
                                         (lambda b: b + "4 more\n 1 O 0 0 0 1\n", "atom count changes")])
def test_mixed_xyz_errors(spark, tmp_path, cut, message):
    (tmp_path / "m.arc").write_text(cut(mixed(20)[0].replace(" 1 7 ", " 1 O ")))
    with pytest.raises(Exception, match=message):
        xyz.read_xyz(spark, str(tmp_path), width=10).frames.collect()


def test_xyz_bad_atoms(spark, tmp_path):
    (tmp_path / "m.xyz").write_text("2 t\n 1 O 0 0 0 1\n 1 O 0 0 0 1\n")
    with pytest.raises(Exception, match="repeated atom id"):
        xyz.read_xyz(spark, str(tmp_path)).atoms.collect()
    (tmp_path / "m.xyz").write_text("2 t\n 1 O 0 0 0 1\n 2 O 0 x 0 1\n")
    with pytest.raises(Exception, match="malformed"):
        xyz.read_xyz(spark, str(tmp_path)).positions.collect()


LOG = """ Current Time      10.0000 Picosecond
 Current Potential   -100.5 Kcal/mole
 Current Kinetic   5.0D+01 Kcal/mole
 Potential Energy   1.0
 Lattice Lengths  20.0 21.0 22.0
 Lattice Angles  90.0 90.0 91.0
 Current Time      20.0000 Picosecond
 Temperature   300.0
 Current Temperature  301.0
 Periodic Box Dimensions
   30.0 20.0 20.0
   90 90 90
"""


@pytest.mark.parametrize("block", [None, "100"])
def test_run_logs(spark, tmp_path, block):
    base, more = tmp_path / "T300K", tmp_path / "T300K_run_002"
    base.mkdir(), more.mkdir()
    (base / "md_log.out").write_text(LOG)
    (base / "other.out").write_text(" Current Time 5.0 Picosecond\n Current Kinetic 1.0 Kcal/mole\n")
    (more / "only.out").write_text(" Current Time 5.0 Picosecond\n Current Kinetic 1.0 Kcal/mole\n")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = logs.read_logs(spark, str(tmp_path)).orderBy("run_index", "time_ps").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r["run_index"], r["time_ps"], r["potential_kcal_mol"], r["kinetic_kcal_mol"], r["temperature_K"], r["a_A"], r["gamma_deg"])
            for r in rows] == [(1, 10.0, -100.5, 50.0, None, 20.0, 91.0), (1, 20.0, None, None, 301.0, 30.0, 90.0),
                               (2, 5.0, None, 1.0, None, None, None)]


def test_masses_and_curves(spark, tmp_path):
    (tmp_path / "ff.prm").write_text('# c\natom 1 2 O "Water O 1" 8 15.999 2\natom 1 2 O "again" 8 16.5 2\natom 3 3 X "two" 7 3.5\natom 4 4 Y "x" 1 0.0 2\n')
    got = {r["atom_type"]: r["mass"] for r in logs.parse_masses(text.read_lines(spark, str(tmp_path), "*.prm")).collect()}
    assert got == {1: 16.5, 3: 3.5}
    (tmp_path / "reference_rdf_O_Li.txt").write_text("# r g\n0.1 0.5\n0.2 0.75\n")
    c = logs.read_curves(text.read_lines(spark, str(tmp_path), "*.txt"), ("r", "g"))
    want = spark.createDataFrame([("Li", "O")], "a string, b string")
    assert logs.curve_for_pair(c, want).count() == 2
    (tmp_path / "bad.dat").write_text("0.1\n")
    with pytest.raises(Exception, match="two columns"):
        logs.read_curves(text.read_lines(spark, str(tmp_path), "*.dat")).collect()


def test_snapshots(spark, tmp_path):
    for n in ("run.001", "run.002", "other.001"):
        (tmp_path / n).write_text(xyz_frame(1.0))
    files = text.list_files(spark, str(tmp_path))
    assert [r["prefix"] for r in text.numbered_series(files).collect()] == ["run", "run"]
    with pytest.raises(FileNotFoundError):
        text.numbered_series(files, "none")
    cells = xyz.snapshot_cells(spark, str(tmp_path), 50.0)
    assert sorted(r["time_ps"] for r in cells.collect()) == [50.0, 50.0, 100.0]


def test_reuse(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3).toDF("a")
    path = str(tmp_path / "out")
    for columns in ((), ("a",), ("b",)):
        sinks.reuse(spark, path, compute, columns)
    assert len(calls) == 2


def test_positions_alone_carry_the_checks(spark, tmp_path):
    (tmp_path / "m.arc").write_text("2 t\n 1 O 0 0 0 1\n 2 O 0 0 0 1\n2 t\n 1 O 0 0 0 1\n 1 O 0 0 0 1\n")
    with pytest.raises(Exception, match="change or repeat"):
        xyz.read_xyz(spark, str(tmp_path)).positions.collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "cut.arc").write_text("2 t\n 1 O 0 0 0 1\n 2 O 0 0 0 1\n2 t\n 1 O 0 0 0 1\n")
    with pytest.raises(Exception, match="truncated frame 2"):
        xyz.read_xyz(spark, str(tmp_path / "c")).positions.collect()


def test_bonds_beyond_a_thousand(spark, tmp_path):
    n = 1500
    lines = [f"{n} star", " 1 O 0 0 0 1 " + " ".join(map(str, range(2, n + 1)))] + [f" {i} H 0 0 0 2 1" for i in range(2, n + 1)]
    (tmp_path / "s.xyz").write_text("\n".join(lines) + "\n")
    atoms = {r["atom_id"]: r["bonds"] for r in xyz.read_xyz(spark, str(tmp_path)).atoms.collect()}
    assert atoms[1] == list(range(2, n + 1)) and atoms[n] == [1]


def test_partitions_not_written_anew_stay(spark, tmp_path):
    from mdframes.plans import outputs
    df = spark.createDataFrame([("a", 1), ("b", 2)], "traj string, n int")
    outputs.save({"t": df, "none": None}, str(tmp_path))
    outputs.save({"t": spark.createDataFrame([("b", 3)], "traj string, n int")}, str(tmp_path))
    assert sorted(map(tuple, outputs.load(spark, str(tmp_path), "t", df).collect())) == [("a", 1), ("b", 3)]


def test_files_of_one_directory_are_ranked_by_many_tasks(spark):
    files = spark.range(5000).selectExpr("concat('file:/d/', if(id % 3 = 0, 'a', 'b'), lpad(string((id * 7919) % 5000), 5, '0'), if(id % 2 = 0, '.arc', '.xyz.gz')) AS file", "1L AS length")
    out = text.trajectory_files(files)
    names = [r["file"] for r in out.orderBy("rank").collect()]
    assert names == sorted(names, key=lambda n: (not n.endswith(".arc"), n)) and [r["rank"] for r in out.orderBy("rank").collect()] == list(range(1, 5001))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in x for x in plan.splitlines() if "Window" in x)


def test_reuse_looks_at_inputs_and_parameters(spark, tmp_path):
    calls, path = [], str(tmp_path / "out")

    def compute():
        calls.append(1)
        return spark.range(len(calls)).toDF("a")
    files = lambda *rows: spark.createDataFrame(list(rows), "file string, length bigint")
    for inputs, parameters, n in ((files(("a", 1)), {"r": 1}, 1), (files(("a", 1)), {"r": 1}, 1), (files(("a", 1), ("b", 1)), {"r": 1}, 2),
                                  (files(("b", 1), ("a", 1)), {"r": 1}, 2), (files(("a", 2), ("b", 1)), {"r": 1}, 3),
                                  (files(("a", 2), ("b", 1)), {"r": 2}, 4), (files(("a", 2), ("b", 1)), {"r": 2}, 4)):
        assert sinks.reuse(spark, path, compute, ["a"], inputs=inputs, parameters=parameters).count() == n == len(calls)


def test_a_broken_flow_resumes(spark, tmp_path):
    """Steps of one input: what was entered before the fault is not computed again; a changed, a new and a missing input are noticed."""
    import os

    from mdframes.plans import manifest
    for k in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"t{k}.xyz").write_text(f"1 t\n 1 O {k}.0 0 0 1\n")
    done, out, broken = [], str(tmp_path / "out"), [True]
    files = lambda: manifest.inputs(spark, str(tmp_path / "in"))

    def compute(paths):
        names = [os.path.basename(p) for p in paths]
        if broken[0] and "t2.xyz" in names:
            raise OSError("lost")
        done.extend(names)
        return {"places": xyz.read_xyz(spark, paths).positions.select("traj", "x"), "nothing": None}

    def places(parameters):
        table = spark.read.schema("x double, traj string").parquet(out + "/places")
        return sorted((r["traj"], r["x"]) for r in manifest.current(spark, out, table, files(), parameters).collect())

    with pytest.raises(OSError):
        manifest.resume(spark, out, files(), {"r": 1}, compute, per_step=1)
    assert done == ["t0.xyz", "t1.xyz"] and places({"r": 1}) == [("t0", 0.0), ("t1", 1.0)]
    broken[0] = False
    assert manifest.resume(spark, out, files(), {"r": 1}, compute, per_step=1) == 2 and done[2:] == ["t2.xyz", "t3.xyz"]
    (tmp_path / "in" / "t1.xyz").write_text("1 t\n 1 O 11.25 0 0 1\n")
    (tmp_path / "in" / "t9.xyz").write_text("1 t\n 1 O 9.0 0 0 1\n")
    assert ("t1", 1.0) not in places({"r": 1})
    assert manifest.resume(spark, out, files(), {"r": 1}, compute) == 2 and done[4:] == ["t1.xyz", "t9.xyz"]
    assert places({"r": 1}) == [("t0", 0.0), ("t1", 11.25), ("t2", 2.0), ("t3", 3.0), ("t9", 9.0)] and places({"r": 2}) == []
    assert manifest.resume(spark, out, files(), {"r": 2}, compute) == 5 and places({"r": 1}) == [] and len(places({"r": 2})) == 5
    assert manifest.resume(spark, out, files(), {"r": 2}, compute) == 0
    assert manifest.resume(spark, out, files(), {"r": 2}, compute, force=True) == 5


def test_csv_files_hold_the_order(spark, tmp_path):
    """Part files, one after the other, give the rows in order."""
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "id AS v").repartition(7)
    sinks.write_csv(df, str(tmp_path / "out"), {"unit": "ps"}, ["k"])
    keys = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        head, *rows = part.read_text().splitlines()
        assert head == "k,v"
        keys += [int(r.split(",")[0]) for r in rows]
    assert keys == list(range(5000))


def test_lines_of_a_block_are_dealt_to_bounded_tasks(spark, tmp_path, monkeypatch):
    """One file in one block: its lines are numbered in order by many tasks, and an archive's atoms are parsed by as many."""
    monkeypatch.setattr(text, "LINES_PER_STRETCH", 64, raising=False)
    for module in (text, xyz):
        monkeypatch.setattr(module, "LINES_PER_TASK", 200, raising=False)
    (tmp_path / "a.xyz").write_text("6000 long\n" + "".join(f"{k} Li 0.0 1.0 2.5 7 {k + 1} # 5\n" for k in range(1, 6001)))
    lines = text.read_lines(spark, str(tmp_path)).coalesce(1)
    found = text.numbered(lines).withColumn("task", F.spark_partition_id())
    assert found.where("ln <> 1 AND line NOT LIKE concat(ln - 1, ' Li%')").count() == 0 and found.agg(F.max("ln")).first()[0] == 6001
    tasks = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(tasks) > 15 and max(tasks) < 1000, tasks
    atoms = xyz.parse_xyz(lines).atoms
    assert atoms.count() == 6000 and atoms.where("bonds <> array(atom_id + 1)").count() == 0
    tasks = [r["count"] for r in atoms.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert len(tasks) > 15 and max(tasks) < 1000, tasks


def test_a_series_is_written_by_one_task(spark, tmp_path):
    """Not every task writes a file for every series."""
    from mdframes.sources import sinks
    df = spark.range(0, 400, 1, 8).selectExpr("id", "concat('s', id % 10) AS series")
    sinks.write_series(df, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("series=*/*.parquet"))) == 10
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400
