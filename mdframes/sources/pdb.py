"""PDB trajectories as frames, atoms and positions tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.functions import sites as T
from mdframes.schema import CELL, XYZ
from mdframes.sources.text import read_lines, renumber, stem
from mdframes.staging import stage


@dataclass(frozen=True)
class Trajectory:
    """frames: traj, frame, n_atoms, cell; atoms: one row per atom of the first frame;
    positions: traj, frame, atom_id, x, y, z."""
    frames: DataFrame
    atoms: DataFrame
    positions: DataFrame


def _slice(start: int, end: int) -> str:
    return f"trim(substring(line, {start + 1}, {end - start}))"


def _num(text: str) -> str:
    return f"try_cast({text} AS double)"


TOKENS = "split(trim(line), '\\\\s+')"


def _struct(names: Sequence[str], values: Sequence[str]) -> str:
    """A struct of doubles, or NULL when any part is no number."""
    ok = " AND ".join(f"{v} IS NOT NULL" for v in values)
    return f"CASE WHEN {ok} THEN named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(names, values))}) END"


def _coordinates(strict: bool) -> str:
    """Fixed columns; else whitespace fields 7-9 or 6-8; else the first three numbers in a row."""
    tok = lambda i: _num(f"get(toks, {i})")
    tries = [_struct(XYZ, [_num(_slice(30, 38)), _num(_slice(38, 46)), _num(_slice(46, 54))])]
    if strict:
        tries.append("CASE WHEN size(toks) >= 8 THEN " + _struct(XYZ, [tok(5), tok(6), tok(7)]) + " END")
    else:
        tries += ["CASE WHEN size(toks) >= 9 THEN " + _struct(XYZ, [tok(6), tok(7), tok(8)]) + " END",
                  "CASE WHEN size(toks) >= 8 THEN " + _struct(XYZ, [tok(5), tok(6), tok(7)]) + " END",
                  "get(filter(transform(sequence(5, greatest(5, size(toks) - 3)), i -> "
                  + _struct(XYZ, [tok("i"), tok("i + 1"), tok("i + 2")]) + "), s -> s IS NOT NULL), 0)"]
    return f"coalesce({', '.join(tries)})"


def _cell() -> str:
    cols = [(6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54)]
    fixed = _struct(CELL, [_num(_slice(*c)) for c in cols])
    loose = _struct(CELL, [_num(f"get(toks, {i})") for i in range(1, 7)])
    good = "least({0}.a, {0}.b, {0}.c) > 0"
    return (f"coalesce(CASE WHEN {good.format(f'({fixed})')} THEN {fixed} END, "
            f"CASE WHEN {good.format(f'({loose})')} THEN {loose} END)")


def without_conect(lines: DataFrame) -> DataFrame:
    """Drop bond records, which readers of plain coordinates do not need."""
    return lines.where(~F.col("line").startswith("CONECT"))


def parse_pdb(lines: DataFrame, user_box: Sequence[float] | None = None, strict: bool = False,
              atom_type_field: str = "auto", traj: Column | None = None) -> Trajectory:
    """Line table -> trajectory.

    A frame ends at MODEL, ENDMDL, END, at a CRYST1 outside MODEL, or where serials restart at 1
    outside MODEL. Its cell is the user's, else the last CRYST1 before it, else the file's first
    CRYST1. All frames of a file must have the same number of atoms and the same sites in the same
    order; ``strict`` also requires a cell.
    """
    if user_box is not None and len(user_box) not in (3, 6):
        raise ValueError("user_box needs 3 or 6 values")
    label = stem() if traj is None else traj
    rec = "upper(trim(substring(line, 1, 6)))"
    kinds = ["ATOM", "HETATM", "MODEL", "ENDMDL", "END", "CRYST1"]
    df = lines.where(F.expr(rec).isin(kinds)).selectExpr("file", "block", "seq", "line", f"{rec} AS rec",
                                                         f"{TOKENS} AS toks")
    df = df.selectExpr("*", "rec IN ('ATOM', 'HETATM') AS is_atom",
                       f"CASE WHEN rec = 'CRYST1' THEN {_cell()} END AS box",
                       f"CASE WHEN rec IN ('ATOM', 'HETATM') THEN coalesce(try_cast({_slice(6, 11)} AS int), "
                       "try_cast(get(toks, 1) AS int)) END AS serial").drop("toks")
    # Inside MODEL .. ENDMDL a CRYST1 or a serial of 1 does not end a frame. Whether a block starts
    # inside is only known from earlier blocks, so such rows are counted separately.
    w = "(PARTITION BY file, block ORDER BY seq ROWS UNBOUNDED PRECEDING)"
    df = df.selectExpr("*", f"last(CASE rec WHEN 'MODEL' THEN true WHEN 'ENDMDL' THEN false END, true) OVER {w} AS inside",
                       "rec IN ('MODEL', 'ENDMDL', 'END') AS hard", "rec = 'CRYST1' OR coalesce(is_atom AND serial = 1, false) AS soft")
    df = df.selectExpr("*", "int(hard OR (soft AND coalesce(NOT inside, false))) AS sure", "int(soft AND inside IS NULL) AS maybe")
    blocks = df.groupBy("file", "block").agg(
        F.sum("sure").alias("sure"), F.sum("maybe").alias("maybe"), F.count_if("is_atom").alias("n"),
        F.max_by("inside", "seq").alias("inside"), F.max_by("box", F.expr("CASE WHEN box IS NOT NULL THEN seq END")).alias("box"),
        F.min_by("box", F.expr("CASE WHEN box IS NOT NULL THEN seq END")).alias("head"))
    past = "(PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = blocks.selectExpr("*", f"coalesce(last(inside, true) OVER {past}, false) AS was_inside")
    blocks = blocks.selectExpr(
        "file", "block", "was_inside", f"last(box, true) OVER {past} AS last_box",
        "first(head, true) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head_box",
        f"coalesce(sum(sure + CASE WHEN was_inside THEN 0 ELSE maybe END) OVER {past}, 0L) AS seg0",
        f"coalesce(sum(n) OVER {past}, 0L) AS n0")
    df = df.drop("inside", "hard", "soft").join(blocks, ["file", "block"])
    df = df.selectExpr("file", "block", "line", "is_atom", "serial",
                       f"seg0 + sum(sure + CASE WHEN was_inside THEN 0 ELSE maybe END) OVER {w} AS seg",
                       f"n0 + sum(int(is_atom)) OVER {w} AS n",
                       f"coalesce(last(box, true) OVER {w}, last_box, head_box) AS box")
    df = df.where("is_atom").withColumn("traj", label)
    parsed = df.selectExpr("traj", "file", "seg", "n", "is_atom", "serial", "box", "line", f"{TOKENS} AS toks")
    parsed = parsed.selectExpr("*", f"{_coordinates(strict)} AS p",
                               f"coalesce(nullif({_slice(12, 16)}, ''), get(toks, 2)) AS name",
                               f"{_slice(76, 78)} AS element_field")
    parsed = parsed.withColumn("site", F.coalesce(
        F.when(F.length(T.site_token(F.col("element_field"))) > 0, T.site_token(F.col("element_field"))),
        T.site_token(F.col("name")))).drop("toks")
    # Each line is parsed once; all tables start from what was written.
    parsed = stage(parsed, "pdb")
    seg = parsed.groupBy("traj", "file", "seg").agg(
        F.count(F.lit(1)).alias("n_atoms"), F.min("n").alias("first_n"), F.min_by("box", "n").alias("box"))
    seg = renumber(seg, ["traj", "file"], "seg")
    box = F.col("box")
    if user_box is not None:
        six = [*user_box, 90.0, 90.0, 90.0][:6]
        box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(CELL, six)])
    elif strict:
        box = F.when(box.isNull(), F.raise_error(F.concat(F.lit("frame without a cell in "), "file")).cast(
            "struct<a:double,b:double,c:double,alpha:double,beta:double,gamma:double>")).otherwise(box)
    rows = parsed.join(seg.select("file", "seg", "frame", "first_n"), ["file", "seg"])
    rows = rows.withColumn("atom_id", F.col("n") - F.col("first_n"))
    bad_xyz = F.raise_error(F.concat(F.lit("no coordinates in line: "), "line")).cast("double")
    positions = rows.select("traj", "frame", "atom_id",
                            *[F.when(F.col("is_atom") & F.col("p").isNull(), bad_xyz).otherwise(F.col(f"p.{n}")).alias(n) for n in XYZ])
    check = rows.groupBy("traj", "frame").agg(
        F.sum(F.xxhash64("atom_id", "site").cast("decimal(38,0)")).alias("_sig"))
    frames = seg.select("traj", "frame", "n_atoms", box.alias("box")).join(check, ["traj", "frame"])
    first = frames.groupBy("traj").agg(F.min_by("n_atoms", "frame").alias("_n0"), F.min_by("_sig", "frame").alias("_s0"))
    frames = frames.join(first, "traj")
    frames = frames.withColumn("n_atoms", F.expr("""CASE
        WHEN n_atoms <> _n0 THEN bigint(raise_error(concat('atom count changes in ', traj, ', frame ', frame, ': ', _n0, ' -> ', n_atoms)))
        WHEN _sig <> _s0 THEN bigint(raise_error(concat('site order changes in ', traj, ', frame ', frame)))
        ELSE n_atoms END""")).select("traj", "frame", "n_atoms", *[F.col(f"box.{n}").alias(n) for n in CELL])
    # Who reads positions alone gets the checks of their frames as well.
    positions = positions.join(frames.where("n_atoms > 0").select("traj", "frame"), ["traj", "frame"], "left_semi")
    res = "try_cast(" + _slice(22, 26) + " AS int)"
    atoms = rows.where("frame = 0").selectExpr("*", f"{TOKENS} AS toks").select(
        "traj", "atom_id", "serial", "name", F.expr(f"coalesce(nullif({_slice(17, 21)}, ''), get(toks, 3))").alias("resname"),
        F.expr(_slice(21, 22)).alias("chain"), F.expr(f"coalesce({res}, try_cast(get(toks, 4) AS int))").alias("resid"),
        F.expr(_slice(26, 27)).alias("icode"), "site",
        T.infer_element(F.col("name"), F.col("element_field")).alias("element"),
        T.atom_type(F.col("line"), atom_type_field).alias("atom_type"))
    atoms = atoms.withColumn("mass", T.element_mass(F.col("element")))
    return Trajectory(frames, atoms, positions)


def read_pdb(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, **options) -> Trajectory:
    """Plain or gzip-compressed PDB files; see ``parse_pdb`` for the options."""
    return parse_pdb(without_conect(read_lines(spark, paths, glob)), **options)


def restore_box(frames: DataFrame, header: DataFrame) -> DataFrame:
    """Frames without a cell take the header's cell (header: traj, cell)."""
    h = header.select("traj", *[F.col(c).alias(f"_{c}") for c in CELL])
    out = frames.join(h, "traj", "left")
    missing = F.col("a").isNull()
    return out.withColumns({c: F.when(missing, F.col(f"_{c}")).otherwise(F.col(c)) for c in CELL}).drop(
        *[f"_{c}" for c in CELL])


def selected_positions(positions: DataFrame, selected: DataFrame) -> DataFrame:
    """Coordinates of the chosen atoms only (selected: traj, atom_id)."""
    return positions.join(selected.select("traj", "atom_id").distinct(), ["traj", "atom_id"], "left_semi")
