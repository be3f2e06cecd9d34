"""XYZ files with atom types and bonds (single snapshots, numbered series, multi-frame archives).

Layout of a frame: a line ``n title``, an optional line of six cell numbers, then n lines
``id name x y z type bonded-ids...``. All frames of a file have the same atom count; the cell line may be there in some
frames only, so where a frame starts depends on all frames before it. Lines that could start a frame are few; each
points at the line behind its frame. The pointers are followed within buckets of lines, the buckets' ends are chained, and a file is
otherwise parsed in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mdframes.operators.scan import fold, tasks_for, with_carry
from mdframes.schema import CELL, XYZ
from mdframes.sources.pdb import Trajectory
from mdframes.sources.text import LINES_PER_TASK, numbered, read_lines, stem
from mdframes.staging import stage

TOK = "split(trim(line), '\\\\s+')"
LINES_PER_BUCKET = 1 << 16


def _num(i: int) -> str:
    return f"try_cast(regexp_replace(get(toks, {i}), '[Dd]', 'E') AS double)"


def _followed(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Possible heads in order, for each the next one in its bucket (itself, if that lies elsewhere), and where it points."""
    t = t.sort_by("ln")
    ln, after = t["ln"].to_numpy(), t["after"].to_numpy()
    at = np.minimum(np.searchsorted(ln, after), len(ln) - 1)
    return t, np.where(ln[at] == after, at, np.arange(len(ln))), after


def _exits(t: pa.Table) -> pa.Table:
    """For heads that a frame of an earlier bucket can point at: the line behind the bucket's last frame, and the frames passed."""
    t, to, after = _followed(t)
    passed = (to != np.arange(len(to))).astype(np.int64)
    while not np.array_equal(to, to[to]):       # pointer doubling
        passed, to = passed + passed[to], to[to]
    t = t.append_column("exit", pa.array(after[to])).append_column("passed", pa.array(passed + 1))
    return t.filter(t["entry"]).select(["file", "bucket", "ln", "exit", "passed"])


def _reached(t: pa.Table) -> pa.Table:
    """The heads on the way from the bucket's first one, with their frame numbers."""
    t, to, _ = _followed(t)
    k, way = int(np.searchsorted(t["ln"].to_numpy(), t["head"][0].as_py())), []
    while not way or way[-1] != k:
        way.append(k)
        k = int(to[k])
    t = t.take(way)
    return t.append_column("frame", pa.array(t["first"].to_numpy() + np.arange(len(way)))).select(["file", "ln", "frame", "n_atoms", "boxed", "title", *CELL])


def _heads(df: DataFrame, width: int) -> DataFrame:
    """file, ln, frame, n_atoms, boxed, title and cell of every frame, from numbered lines."""
    count = "try_cast(regexp_extract(line, '^\\\\s*(\\\\S+)', 1) AS bigint)"
    n = df.where("ln = 1").selectExpr("file", f"{count} AS n").selectExpr(
        "file", "CASE WHEN n > 0 THEN n ELSE bigint(raise_error(concat('no atom count in ', file))) END AS n_atoms")
    six = " AND ".join(f"{_num(i)} {'> 0' if i < 3 else 'IS NOT NULL'}" for i in range(6))
    # Few lines pass the first test for numbers, so few are split.
    cell = f"CASE WHEN size(toks) >= 6 AND coalesce({six}, false) THEN struct({', '.join(f'{_num(i)} AS {c}' for i, c in enumerate(CELL))}) END"
    lines = df.join(n, "file").selectExpr("file", "ln", "n_atoms", "line", f"coalesce({count} = n_atoms, false) AS head",
                                          f"CASE WHEN line RLIKE '^\\\\s*[+.0-9]\\\\S*\\\\s+[+.0-9]' THEN {TOK} END AS toks")
    marks = stage(lines.where("head OR toks IS NOT NULL").selectExpr("*", f"{cell} AS cell").where("head OR cell IS NOT NULL").drop("toks"), "heads")
    boxes = marks.where("cell IS NOT NULL").selectExpr("file", "ln - 1 AS ln", "cell AS box")
    found = marks.where("head").drop("cell").join(boxes, ["file", "ln"], "left").selectExpr(
        "file", "ln", "n_atoms", "int(box IS NOT NULL) AS boxed", "trim(regexp_replace(trim(line), '^\\\\S+', '')) AS title",
        *[f"box.{c} AS {c}" for c in CELL], f"greatest({width}L, n_atoms + 2) AS width")
    found = found.selectExpr("*", "ln div width AS bucket", "ln + n_atoms + 1 + boxed AS after",
                             "ln = 1 OR ln % width < n_atoms + 2 AS entry").drop("width")
    exits = found.select("file", "bucket", "ln", "after", "entry").groupBy("file", "bucket").applyInArrow(
        _exits, "file string, bucket bigint, ln bigint, exit bigint, passed bigint")

    def follow(r: dict, at: tuple[int, int]) -> tuple[dict | None, tuple[int, int]]:
        head, frame = at
        if r["ln"] != head:
            return None, at
        return {"bucket": r["bucket"], "head": head, "first": frame}, (r["exit"], frame + r["passed"])

    entered = fold(exits, ["file"], ["bucket", "ln"], (1, 0), follow, "bucket bigint, head bigint, first bigint")
    schema = f"file string, ln bigint, frame bigint, n_atoms bigint, boxed int, title string, {', '.join(f'{c} double' for c in CELL)}"
    return stage(found.join(entered, ["file", "bucket"]).groupBy("file", "bucket").applyInArrow(_reached, schema), "frames")


def _placed(lines: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Every line with its frame and its place there (file, frame, part, n_atoms, boxed, line), and the frames."""
    df = numbered(lines.where(F.length(F.trim("line")) > 0)).select("file", "stretch", "ln", "line")
    heads = _heads(df, width)
    mine = heads.select("file", "ln", F.struct("ln", "frame", "n_atoms", "boxed").alias("own"))
    df = df.join(mine, ["file", "ln"], "left")
    df = with_carry(df, ["file"], "stretch", ["ln"], lasts={"before": F.col("own")})
    inside = Window.partitionBy("file", "stretch").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("h", F.coalesce(F.last("own", ignorenulls=True).over(inside), F.col("before")))
    return df.selectExpr("file", "line", "h.frame AS frame", "ln - h.ln AS part", "h.n_atoms AS n_atoms", "h.boxed AS boxed"), heads


def parse_xyz(lines: DataFrame, traj: Column | None = None, width: int = LINES_PER_BUCKET) -> Trajectory:
    """Line table -> trajectory. Malformed lines, truncated frames, repeated atom ids and a
    changing atom count or topology raise an error when the affected table is computed.

    ``atoms`` holds the first frame's ids, names, types and bonds.
    """
    label = stem() if traj is None else traj
    df, heads = _placed(lines, width)
    # A line behind the last atom that starts no frame of this size is a frame of another one.
    df = df.selectExpr("*", """CASE WHEN part > boxed + n_atoms
        THEN bigint(raise_error(concat('atom count changes in ', file, ', frame ', frame + 2))) ELSE part END AS place""")
    body = df.where("place > boxed").withColumn("traj", label).selectExpr("*", f"{TOK} AS toks").selectExpr(
        "traj", "file", "frame", "place AS part", "boxed", "line", "toks", "try_cast(get(toks, 0) AS bigint) AS id", "get(toks, 1) AS name",
        *[f"{_num(2 + k)} AS {n}" for k, n in enumerate(XYZ)], "try_cast(get(toks, 5) AS int) AS atom_type")
    # The optimizer may test the raising column before the filter above, so the guard is repeated.
    body = body.selectExpr("*", """CASE WHEN part > boxed AND (id IS NULL OR x IS NULL OR y IS NULL OR z IS NULL OR atom_type IS NULL)
        THEN bigint(raise_error(concat('malformed atom line in ', file, ': ', line))) ELSE id END AS atom_id""")
    # Each line is parsed once; atoms, positions and checks start from what was written.
    body = stage(body.drop("toks"), "xyz")
    ids = body.groupBy("file", "frame").agg(F.sum(F.xxhash64("atom_id").cast("decimal(38,0)")).alias("_ids"), F.count(F.lit(1)).alias("have"))
    first = ids.where("frame = 0").select("file", F.col("_ids").alias("_first"))
    ends = heads.join(ids, ["file", "frame"], "left").join(first, "file", "left").withColumn("traj", label).selectExpr("traj", "frame", """CASE
        WHEN have IS NULL OR have < n_atoms THEN bigint(raise_error(concat('truncated frame ', frame + 1, ' in ', file)))
        WHEN _ids <> _first THEN bigint(raise_error(concat('atom ids change or repeat in ', file, ', frame ', frame + 1)))
        ELSE n_atoms END AS n_atoms""", "title", *CELL)
    # Who reads positions alone gets the checks of their frames as well.
    positions = body.select("traj", "frame", "atom_id", *XYZ).join(
        ends.where("n_atoms > 0").select("traj", "frame"), ["traj", "frame"], "left_semi")
    # Bonded ids run until the first token that is no integer; zeros are placeholders.
    atoms = body.where("frame = 0").selectExpr("*", f"{TOK} AS toks").selectExpr("traj", "atom_id", "name", "atom_type", """filter(transform(
        slice(toks, 7, greatest(0, coalesce(nullif(array_position(transform(slice(toks, 7, size(toks)), t -> try_cast(t AS bigint) IS NULL), true), 0) - 1,
                                            size(toks) - 6))), t -> try_cast(t AS bigint)), b -> b > 0) AS bonds""")
    tasks = tasks_for(body.where("frame = 0").count(), LINES_PER_TASK, body.sparkSession)
    atoms = atoms.repartition(tasks, "traj", "atom_id").withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("traj", "atom_id")))
    atoms = atoms.withColumn("atom_id", F.expr(
        "CASE WHEN _k > 1 THEN bigint(raise_error(concat('repeated atom id ', atom_id, ' in ', traj))) ELSE atom_id END")).drop("_k")
    return Trajectory(ends, atoms, positions)


def read_xyz(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, traj: Column | None = None,
             width: int = LINES_PER_BUCKET) -> Trajectory:
    return parse_xyz(read_lines(spark, paths, glob), traj, width)


def topology_rows(lines: DataFrame, traj: Column | None = None, width: int = LINES_PER_BUCKET) -> DataFrame:
    """Every frame's atom ids, types and bonds (traj, frame, atom_id, atom_type, bonds), for strict
    topology comparison with ``molecules.changed_frames``."""
    label = stem() if traj is None else traj
    df = _placed(lines, width)[0].where("part > boxed").selectExpr("file", "frame", f"{TOK} AS toks")
    return df.withColumn("traj", label).selectExpr(
        "traj", "frame", "bigint(get(toks, 0)) AS atom_id", "int(get(toks, 5)) AS atom_type",
        "transform(slice(toks, 7, size(toks)), t -> try_cast(t AS bigint)) AS bonds")


def cells_of(lines: DataFrame, save_interval_ps: float) -> DataFrame:
    """``snapshot_cells`` of a line table."""
    head = lines.where(F.col("file").rlike(r"\.\d{3,}$") & (F.col("block") == 0))
    first = head.groupBy("file").agg(F.min("seq").alias("first"))
    df = head.join(first, "file").where("seq = first + 1").selectExpr(
        "file", f"{TOK} AS toks", "bigint(regexp_extract(file, '\\\\.([0-9]{3,})$', 1)) AS frame")
    df = df.selectExpr("file", "frame", f"frame*{float(save_interval_ps)}D AS time_ps",
                       *[f"{_num(i)} AS {c}" for i, c in enumerate(CELL)])
    return df.where("a > 0 AND b > 0 AND c > 0 AND alpha IS NOT NULL AND beta IS NOT NULL AND gamma IS NOT NULL")


def snapshot_cells(spark: SparkSession, paths: str | Sequence[str], save_interval_ps: float) -> DataFrame:
    """Cell of each numbered snapshot ``*.NNN`` from its second line: file, frame, time_ps, cell.

    Files whose second line holds no valid cell are left out.
    """
    return cells_of(read_lines(spark, paths), save_interval_ps)


def frame_times(frames: DataFrame, interval_ps: float, first_ps: float | None = None,
                index: str | None = None, run: Sequence[str] = ("traj",)) -> DataFrame:
    """Add time_ps. Numbered snapshots: ``index`` steps from the first (default first time is the
    lowest index times the interval), plus the frame within the file. Archives: the first frame is
    at ``first_ps`` (default one interval)."""
    step = F.lit(float(interval_ps))
    if index is None:
        first = F.lit(float(first_ps)) if first_ps is not None else step
        return frames.withColumn("time_ps", first + F.col("frame") * step)
    low = frames.groupBy(*run).agg(F.min(index).alias("_low"))
    first = F.lit(float(first_ps)) if first_ps is not None else F.col("_low") * step
    out = frames.join(low, list(run))
    return out.withColumn("time_ps", first + (F.col(index) - F.col("_low") + F.col("frame")) * step).drop("_low")
