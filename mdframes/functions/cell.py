"""Periodic-cell arithmetic as SQL expression texts (for ``selectExpr`` / ``F.expr``).

A cell with lengths a, b, c and angles alpha, beta, gamma is held as the six non-zero terms of
its lower-triangular matrix, rows being the cell vectors::

    (ax, 0, 0)  (bx, by, 0)  (cx, cy, cz)

Functions take column names (or expressions) and give expressions; the matrix terms are read from
columns named as above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["a", "b", "c", "alpha", "beta", "gamma"]
MATRIX = ["ax", "bx", "by", "cx", "cy", "cz"]
ERR = "no cell: gamma is a multiple of 180 degrees or the angles do not close"


def cell_volume(a="a", b="b", c="c", alpha="alpha", beta="beta", gamma="gamma") -> str:
    """Volume; NULL when the angles describe no cell (beyond round-off)."""
    ca, cb, cg = (f"cos(radians({v}))" for v in (alpha, beta, gamma))
    factor = f"(1D - {ca}*{ca} - {cb}*{cb} - {cg}*{cg} + 2D*{ca}*{cb}*{cg})"
    return f"CASE WHEN {factor} >= -1e-10D THEN {a}*{b}*{c}*sqrt(greatest({factor}, 0D)) END"


def orthorhombic_volume(a="a", b="b", c="c") -> str:
    """a*b*c where all three are finite and positive, else NULL."""
    ok = " AND ".join(f"{v} > 0 AND {v} < double('infinity')" for v in (a, b, c))
    return f"CASE WHEN {ok} THEN {a}*{b}*{c} END"


def is_orthorhombic(alpha="alpha", beta="beta", gamma="gamma", tol: float = 1.0e-7) -> str:
    return "(" + " AND ".join(f"abs(cos(radians({v}))) <= {tol}D" for v in (alpha, beta, gamma)) + ")"


def with_cell_matrix(frames: DataFrame, keep_lengths: bool = False) -> DataFrame:
    """Replace a..gamma of a frames table by the matrix terms and the volume.

    cos(pi/2) is 6e-17 in floating point; a right angle gives exact zeros instead.
    """
    rest = [c for c in frames.columns if c not in CELL]
    cos = {n: f"CASE WHEN {v} = 90 THEN 0D ELSE cos(radians({v})) END AS _c{n}"
           for n, v in zip("abg", ("alpha", "beta", "gamma"))}
    df = frames.selectExpr("*", *cos.values(), "CASE WHEN gamma = 90 THEN 1D ELSE sin(radians(gamma)) END AS _sg")
    df = df.selectExpr("*", "c*_cb AS cx", "c*(_ca - _cb*_cg)/_sg AS cy")
    bad = f"raise_error('{ERR}')"
    df = df.selectExpr(
        *rest, *(CELL if keep_lengths else []), "a AS ax", "b*_cg AS bx",
        f"CASE WHEN abs(_sg) < 1e-12D THEN double({bad}) ELSE b*_sg END AS by", "cx", "cy",
        f"CASE WHEN c*c - cx*cx - cy*cy < -1e-8D THEN double({bad}) "
        "ELSE sqrt(greatest(c*c - cx*cx - cy*cy, 0D)) END AS cz", f"{cell_volume()} AS volume")
    return df


def fractional(x: str, y: str, z: str) -> tuple[str, str, str]:
    """A vector times the inverse of the lower-triangular matrix."""
    fz = f"({z})/cz"
    fy = f"(({y}) - {fz}*cy)/by"
    fx = f"(({x}) - {fy}*bx - {fz}*cx)/ax"
    return fx, fy, fz


def minimum_image(df: DataFrame, x: str, y: str, z: str, out: tuple[str, str, str]) -> DataFrame:
    """Add the shortest periodic copy of (x, y, z) as ``out``; fractions round half to even.

    Whole cell vectors are subtracted, so a right-angled cell keeps the vector's digits.
    """
    fx, fy, fz = fractional(x, y, z)
    df = df.selectExpr("*", f"rint({fx}) AS _kx", f"rint({fy}) AS _ky", f"rint({fz}) AS _kz")
    return df.selectExpr("*", f"({x}) - (_kx*ax + _ky*bx + _kz*cx) AS {out[0]}",
                         f"({y}) - (_ky*by + _kz*cy) AS {out[1]}",
                         f"({z}) - _kz*cz AS {out[2]}").drop("_kx", "_ky", "_kz")


def heights() -> tuple[str, str, str]:
    """Perpendicular distance between opposite faces along each axis."""
    vol = "(ax*by*cz)"
    bxc = "sqrt(pow(by*cz, 2) + pow(bx*cz, 2) + pow(bx*cy - by*cx, 2))"
    cxa = "sqrt(pow(ax*cz, 2) + pow(ax*cy, 2))"
    return f"{vol}/{bxc}", f"{vol}/{cxa}", "cz"


def dot(a: str, b: str) -> str:
    """Dot product of two column triples given by prefix."""
    return "(" + " + ".join(f"{a}{n}*{b}{n}" for n in "xyz") + ")"
