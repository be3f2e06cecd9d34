"""Periodic neighbour joins.

Pairs are found with an equi-join on grid cells, never by pairing everything in a frame. Cells
live in fractional space and are at least one cutoff thick, so both partners of a pair within
the cutoff sit in the same or in touching cells. Positions must carry their frame's cell matrix
(see ``attach_cell``), which costs six constant columns and saves a join at pairing time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.functions import cell as C

KEYS = ["traj", "frame"]
PER_CELL = 4        # atoms of the fullest frame that a cell holds on average, at least


def attach_cell(positions: DataFrame, frames: DataFrame) -> DataFrame:
    """Positions with the cell matrix and volume of their frame."""
    return positions.join(C.with_cell_matrix(frames.select(*KEYS, *C.CELL)), KEYS)


def _most_cells(points: DataFrame) -> int:
    """Cells per axis that leave ``PER_CELL`` atoms of the fullest frame to a cell: finer ones would mostly be empty, and every row
    would be sent to many of them in vain. A frame's number of atoms is the one figure the driver sees."""
    fullest = points.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    most = 1
    while PER_CELL * (most + 1) ** 3 <= fullest:
        most += 1
    return most


def _gridded(df: DataFrame, cutoff: float, carry: list[str], most: int = 1 << 20) -> DataFrame:
    """Cell index (gx, gy, gz) of every row, the number of cells (nx, ny, nz) per axis, ``most`` at most, and the steps (sx, sy, sz) to the
    cells that the row can have a partner in: a face further away than the cutoff has none behind it."""
    names = list(zip("xyz", C.fractional("x", "y", "z"), C.heights()))
    reach = float(cutoff) * (1.0 + 1.0e-9)
    df = df.selectExpr(*carry, *[f"{f} AS f{n}" for n, f, _ in names], *[f"double({h}) AS h{n}" for n, _, h in names],
                       *[f"int(least({most}, greatest(1, floor(({h})/{float(cutoff)}D)))) AS n{n}" for n, _, h in names])
    # Round-off can lift a wrapped coordinate to exactly 1.
    index = [f"least(int(floor((f{n} - floor(f{n}))*n{n})), n{n} - 1) AS g{n}" for n in "xyz"]
    df = df.selectExpr("*", *index)
    into = {n: f"((f{n} - floor(f{n}))*n{n} - g{n})*h{n}/n{n}" for n in "xyz"}     # depth behind the lower face
    steps = [f"array_compact(array(0, CASE WHEN {into[n]} <= {reach}D THEN -1 END, CASE WHEN h{n}/n{n} - {into[n]} <= {reach}D THEN 1 END)) AS s{n}" for n in "xyz"]
    return df.selectExpr(*carry, *[f"{k}{n}" for k in "ng" for n in "xyz"], *steps)


CELL_ID = "bigint(gx) + nx*(bigint(gy) + ny*bigint(gz)) AS cell"


def _touching(df: DataFrame) -> DataFrame:
    """One row per cell that may hold partners: 1, 2 or 3 distinct cells along a periodic axis."""
    for n in "xyz":
        rest = [c for c in df.columns if c not in (f"g{n}", f"s{n}")]
        df = df.selectExpr(*rest, f"explode(array_distinct(transform(s{n}, s -> pmod(g{n} + s, n{n})))) AS g{n}")
    return df


def _found(joined: DataFrame, cutoff: float, strict: bool, extra: list[str]) -> DataFrame:
    out = C.minimum_image(joined, "rx - lx", "ry - ly", "rz - lz", ("dx", "dy", "dz"))
    out = out.selectExpr(*KEYS, "i", "j", "dx", "dy", "dz", f"{C.dot('d', 'd')} AS r2", "volume", *[f"`{c}`" for c in extra])
    return out.where(f"r2 {'<' if strict else '<='} {float(cutoff) * float(cutoff)}D")


FIXED = {*KEYS, "atom_id", "x", "y", "z", "volume", *C.MATRIX}
POINT = [*KEYS, "atom_id", "x", "y", "z"]


def _left(grid: DataFrame, extra: list[str], *more: str) -> DataFrame:
    return grid.selectExpr(*KEYS, CELL_ID, *more, "atom_id AS i", "x AS lx", "y AS ly", "z AS lz", *C.MATRIX, "volume", *[f"`{c}` AS `l_{c}`" for c in extra])


def _right(grid: DataFrame, extra: list[str], *more: str) -> DataFrame:
    return grid.selectExpr(*KEYS, CELL_ID, *more, "atom_id AS j", "x AS rx", "y AS ry", "z AS rz", *[f"`{c}` AS `r_{c}`" for c in extra])


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the same cell. Constant cell columns shrink to nothing in shuffle files, so that a side that looks small enough to
    broadcast can fill the driver's memory; a merge join never passes the driver."""
    return left.hint("merge").join(right, [*KEYS, "cell"])


def radius_pairs(left: DataFrame, right: DataFrame, cutoff: float, strict: bool = False, copied: str = "right") -> DataFrame:
    """All (left, right) pairs of a frame whose minimum-image distance is within ``cutoff``.

    Both inputs hold traj, frame, atom_id, x, y, z and the cell matrix. An atom is never paired
    with itself. Output: traj, frame, i (left atom), j (right atom), dx, dy, dz (right - left),
    r2, volume and any further left/right column, prefixed ``l_`` / ``r_``. The
    ``copied`` side, best the smaller one, is sent to every touching cell within reach. A crowded cell is one join key; Spark splits the partitions it makes too large (adaptive skew join), however many there are.
    """
    l_extra = [c for c in left.columns if c not in FIXED]
    r_extra = [c for c in right.columns if c not in FIXED]
    most = _most_cells(right if copied == "left" else left)
    lg = _gridded(left, cutoff, [*POINT, *C.MATRIX, "volume", *l_extra], most)
    rg = _gridded(right, cutoff, [*POINT, *r_extra], most)
    lg, rg = (_touching(lg), rg) if copied == "left" else (lg, _touching(rg))
    joined = _paired(_left(lg, l_extra), _right(rg, r_extra)).where("i <> j")
    return _found(joined, cutoff, strict, [*[f"l_{c}" for c in l_extra], *[f"r_{c}" for c in r_extra]])


def like_pairs(points: DataFrame, cutoff: float, strict: bool = False) -> DataFrame:
    """Every unordered pair of ``points`` within ``cutoff`` once, in either order; columns as ``radius_pairs``.

    A row is sent only to its own cell and to touching ones of a higher number, 14 of 27 on average: of two touching cells the lower one's
    rows go to the higher one, whose rows stay.
    """
    extra = [c for c in points.columns if c not in FIXED]
    grid = _gridded(points, cutoff, [*POINT, *C.MATRIX, "volume", *extra], _most_cells(points))
    home = CELL_ID.replace(" AS cell", " AS home")
    sent = _right(_touching(grid.selectExpr("*", home)), extra, "home").where("cell >= home")
    joined = _paired(_left(grid, extra), sent).where("cell > home OR i < j").where("i <> j")
    return _found(joined, cutoff, strict, [*[f"l_{c}" for c in extra], *[f"r_{c}" for c in extra]])


def molecule_distances(pairs: DataFrame, mol: str = "r_mol_id") -> DataFrame:
    """Shortest left-atom-to-molecule distance per frame: traj, frame, i, mol_id, r2."""
    return pairs.groupBy(*KEYS, "i", F.col(mol).alias("mol_id")).agg(F.min("r2").alias("r2"))


def short_contacts(positions: DataFrame, cutoff: float, top: int) -> DataFrame:
    """The ``top`` closest pairs of atoms that belong to different molecules."""
    pairs = like_pairs(positions, cutoff).where("l_mol_id <> r_mol_id")
    return (pairs.selectExpr(*KEYS, "least(i, j) AS i", "greatest(i, j) AS j", "sqrt(r2) AS distance")
            .orderBy("distance", *KEYS, "i", "j").limit(top))
