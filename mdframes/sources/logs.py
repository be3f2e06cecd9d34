"""Run logs, force-field masses and small curve files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframes.functions import sites as T
from mdframes.operators.scan import previous
from mdframes.schema import LOG_CELL, LOG_ENERGIES
from mdframes.sources.text import LINE, list_files, read_lines

# Words that mark a field, in the order in which a line is tried, and what they do. "set" gives the
# field its value, "fill" only fills a gap; a line that says "current" elsewhere fills no "bare" field.
MARKS = [
    ("current time", "time"),
    ("current potential", "set:potential_kcal_mol"),
    ("current kinetic", "set:kinetic_kcal_mol"),
    ("total energy", "set:total_energy_kcal_mol"),
    ("potential energy", "fill:potential_kcal_mol"),
    ("kinetic energy", "fill:kinetic_kcal_mol"),
    ("current temperature", "set:temperature_K"),
    ("temperature", "fill:temperature_K"),
    ("current pressure", "set:pressure_atm"),
    ("pressure", "fill:pressure_atm"),
    ("lattice lengths", "lengths"),
    ("cell lengths", "lengths"),
    ("lattice angles", "angles"),
    ("cell angles", "angles"),
    ("box dimensions", "box"),
]
BARE = ["temperature", "pressure"]
HEADINGS = ["lengths", "angles", "box"]     # their numbers may stand in later lines


def _kind() -> F.Column:
    """Which field a line carries: time, set:<field>, fill:<field>, lengths, angles, box."""
    out = F.lit(None).cast("string")
    for text, kind in reversed(MARKS):
        hit = F.col("low").contains(text)
        if kind not in HEADINGS:
            hit = hit & F.col("line").rlike("[0-9]")
        if text in BARE:
            hit = hit & ~F.col("low").contains("current")
        out = F.when(hit, kind).otherwise(out)
    return out


def parse_logs(lines: DataFrame) -> DataFrame:
    """Line table -> one row per record: file, rec, time_ps, energies, cell.

    A ``Current Time`` line opens a record. A box heading takes six numbers from itself and the
    three lines that follow, which may lie in the next block of the file.
    """
    w = "(PARTITION BY file, block ORDER BY seq)"
    df = lines.select("file", "block", "seq", "line", F.lower("line").alias("low")).withColumn("kind", _kind())
    df = df.selectExpr("file", "block", "line", "kind", f"row_number() OVER {w} AS rn",
                       f"sum(int(coalesce(kind = 'time', false))) OVER {w[:-1]} ROWS UNBOUNDED PRECEDING) AS rec",
                       f"filter(array(lead(line, 1) OVER {w}, lead(line, 2) OVER {w}, lead(line, 3) OVER {w}), l -> l IS NOT NULL) AS more")
    # Per block: its records, and its first three lines for a heading at the end of the block before.
    heads = df.groupBy("file", "block").agg(
        F.max("rec").alias("recs"),
        F.transform(F.array_sort(F.collect_list(F.expr("CASE WHEN rn <= 3 THEN struct(rn, line) END"))),
                    lambda s: s["line"]).alias("head"))
    wb = "(PARTITION BY file ORDER BY block)"
    none = "cast(array() AS array<string>)"
    heads = heads.selectExpr(
        "file", "block", f"coalesce(sum(recs) OVER {wb[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS rec0",
        "flatten(array(" + ", ".join(f"coalesce(lead(head, {i}) OVER {wb}, {none})" for i in (1, 2, 3)) + ")) AS next")
    df = df.where("kind IS NOT NULL").join(heads, ["file", "block"])
    # Recognised lines are longer than a byte, so block start + line number grows along the file.
    df = df.selectExpr("file", "rec0 + rec AS rec", "kind", "block + rn AS at", """CASE WHEN kind = 'box'
        THEN concat_ws(' ', line, array_join(slice(concat(more, next), 1, 3), ' ')) ELSE line END AS text""")
    # Exploding a one-element array computes the numbers once instead of once per use.
    df = df.select("file", "rec", "kind", "at", F.explode(F.array(T.numbers(F.col("text")))).alias("nums"))
    enough = "size(nums) >= CASE kind WHEN 'box' THEN 6 WHEN 'lengths' THEN 3 WHEN 'angles' THEN 3 ELSE 1 END"
    # Plain scalar columns keep the aggregation below in a hash map.
    df = df.where(enough).selectExpr("file", "rec", "kind", "at", *[f"get(nums, {i}) AS n{i}" for i in range(6)])

    aggs = ["max_by(n0, CASE WHEN kind = 'time' THEN at END) AS time_ps"]
    for field in LOG_ENERGIES:
        aggs.append(f"coalesce(max_by(n0, CASE WHEN kind = 'set:{field}' THEN at END), "
                    f"min_by(n0, CASE WHEN kind = 'fill:{field}' THEN at END)) AS {field}")
    for i, field in enumerate(LOG_CELL):
        own = "lengths" if i < 3 else "angles"
        aggs.append(f"max_by(CASE kind WHEN '{own}' THEN n{i % 3} ELSE n{i} END, "
                    f"CASE WHEN kind IN ('{own}', 'box') THEN at END) AS {field}")
    return df.groupBy("file", "rec").agg(*[F.expr(a) for a in aggs])


def clean_logs(records: DataFrame, run: Sequence[str]) -> DataFrame:
    """Records with a time and at least one measure; per run and time the last one wins
    (later file, then later record)."""
    useful = [*LOG_ENERGIES, "a_A", "b_A", "c_A"]
    df = records.where(F.col("time_ps").isNotNull()).dropna(how="all", subset=useful)
    rest = [c for c in df.columns if c not in {*run, "time_ps", "rec"}]
    last = df.groupBy(*run, "time_ps").agg(F.max_by(F.struct(*rest), F.struct("file", "rec")).alias("v"))
    return last.select(*run, "time_ps", "v.*")


def preferred_logs(files: DataFrame, run: Sequence[str], extension: str = ".out") -> DataFrame:
    """Of a run's files with the extension, those named like logs if there are any, else all."""
    name = F.lower(F.regexp_extract("file", r"([^/]+)$", 1))
    df = files.where(name.endswith(extension)).withColumn("_g", name.rlike("log|dynamic").cast("int"))
    return df.join(df.groupBy(*run).agg(F.max("_g").alias("_g")), [*run, "_g"]).select(*files.columns)


def run_columns(df: DataFrame, directory: F.Column | None = None) -> DataFrame:
    """series, run_index and target temperature from the directory of each file."""
    d = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1) if directory is None else directory
    return df.withColumns({"series": T.series_label(d), "run_index": T.run_number(d),
                           "target_temperature_K": T.series_temperature(d)})


def read_logs(spark: SparkSession, paths: str | Sequence[str], extension: str = ".out",
              directory: F.Column | None = None) -> DataFrame:
    """Cleaned records of all runs below ``paths``: series, run_index, time_ps, measures, file."""
    run = ["series", "run_index"]
    files = preferred_logs(run_columns(list_files(spark, paths, f"*{extension}"), directory), run, extension)
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"no {extension} files below {paths}")
    lines = read_lines(spark, paths, f"*{extension}").join(files.select("file").distinct(), "file", "left_semi")
    return clean_logs(run_columns(parse_logs(lines), directory), run)


def kinetic_log(lines: DataFrame, dof: int) -> DataFrame:
    """Temperature from each kinetic-energy line and the last time before it."""
    from mdframes.functions.scalars import kinetic_temperature
    num = r"([0-9Ee+\-.]+)"
    t = F.regexp_extract("line", rf"Current Time\s+{num}\s+Picosecond", 1).try_cast("double")
    k = F.regexp_extract("line", rf"Current Kinetic\s+{num}\s+Kcal/mole", 1).try_cast("double")
    df = lines.withColumns({"_t": t, "kinetic_kcal_mol": k}).where("_t IS NOT NULL OR kinetic_kcal_mol IS NOT NULL")
    df = previous(df, ["file"], "block", ["seq"], {"time_ps": F.col("_t")})
    df = df.where(F.col("kinetic_kcal_mol").isNotNull())
    return df.select("file", F.coalesce("_t", "time_ps").alias("time_ps"), "kinetic_kcal_mol",
                     kinetic_temperature(F.col("kinetic_kcal_mol"), F.lit(dof)).alias("temperature_K"),
                     F.lit(dof).alias("dof_used"))


def parse_masses(lines: DataFrame) -> DataFrame:
    """``atom`` records of a force-field file: atom_type, mass; the last record of a type wins.

    The mass is the last but one of the trailing numbers (at least three), or the last of two.
    """
    df = lines.where(F.col("line").rlike(r"(?i)^\s*atom\s+"))
    df = df.selectExpr("*", "split(trim(regexp_replace(line, '\"[^\"]*\"', '_')), '\\\\s+') AS toks").where("size(toks) >= 6")
    df = df.selectExpr(*LINE, "try_cast(toks[1] AS int) AS atom_type", """filter(transform(slice(toks, 5, size(toks)),
        t -> try_cast(regexp_replace(t, '[Dd]', 'E') AS double)), v -> v IS NOT NULL) AS tail""")
    df = df.selectExpr(*LINE, "atom_type", """CASE WHEN size(tail) >= 3 THEN element_at(tail, -2)
        WHEN size(tail) = 2 THEN element_at(tail, -1) END AS mass""").where("atom_type IS NOT NULL AND mass > 0")
    return df.groupBy("atom_type").agg(F.max_by("mass", F.struct(*LINE)).alias("mass"))


def read_curves(lines: DataFrame, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Two-column text curves, comments and blank lines skipped: file, pair, and the columns.

    ``pair`` comes from ``reference_rdf_A_B.txt`` (NULL for other names). A line with fewer than
    two numbers is an error.
    """
    df = lines.where(~F.trim("line").startswith("#") & (F.length(F.trim("line")) > 0))
    df = df.withColumn("v", F.transform(F.split(F.trim("line"), r"[\s,]+"), lambda t: T.to_double(t)))
    bad = F.raise_error(F.concat(F.lit("two columns needed in "), "file")).cast("double")
    p = r"reference_rdf_(.+?)_(.+?)\.txt$"
    pair = F.when(F.col("file").rlike(p), F.concat_ws("-", F.regexp_extract("file", p, 1), F.regexp_extract("file", p, 2)))
    second = F.get("v", F.lit(1))
    return df.select("file", pair.alias("pair"), F.get("v", F.lit(0)).alias(names[0]),
                     F.when(second.isNull(), bad).otherwise(second).alias(names[1]))


def curve_for_pair(curves: DataFrame, wanted: DataFrame) -> DataFrame:
    """Reference curves of each wanted pair (a, b) under either order; the exact order is preferred."""
    c = curves.where(F.col("pair").isNotNull())
    w = wanted.select("a", "b", F.explode(F.array(
        F.struct(F.concat_ws("-", "a", "b").alias("pair"), F.lit(0).alias("swap")),
        F.struct(F.concat_ws("-", "b", "a").alias("pair"), F.lit(1).alias("swap")))).alias("w")).select("a", "b", "w.*").distinct()
    have = w.join(c.select("pair").distinct(), "pair")
    best = have.groupBy("a", "b").agg(F.min_by("pair", "swap").alias("pair"))
    return c.join(best, "pair")


def read_result_csv(spark: SparkSession, path: str) -> DataFrame:
    """A result table written with ``# key: value`` header lines; an old ``density`` column is
    renamed."""
    df = spark.read.option("comment", "#").option("header", True).option("inferSchema", True).csv(path)
    return df.withColumnRenamed("density", "density_per_degree")
