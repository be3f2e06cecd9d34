"""How far the words of each source lie from those of the other sources of its language.

Equal texts are collapsed per language first: a text is split into words once, and its document frequencies and counts are added with the
number of its copies in each source. Pairs of sources are evaluated sparsely: terms that both lack have one value, terms
that one lacks are summed by their count, and only terms that both hold are looked at one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdframes.llm.common import settled, table

LEAST = 3               # documents of its language that hold a kept term
TOP = 200               # ranks of part ``term``
HELD = 400_000          # terms counted by a task before they are passed on
SALTS = 64              # parts in which a group's terms are ranked first
PAIRS = 1 << 20         # pairs of sources of a term evaluated together

# Bytes of terms: ASCII letters, lower-cased, and all bytes of other characters; the rest separates.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

COUNTED = "lang string, source string, term binary, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the terms of texts (lang, text, copies per source): occurrences and documents, by language and source."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(list(n), pa.binary()),
                     pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for k in range(batch.num_rows):
            lang, text, sources = (c[k].as_py() for c in batch.columns)
            words = text.translate(_TERM).split()
            if not words:
                continue
            different = set(words)
            for x in sources:
                n, docs = held.setdefault((lang, x["source"]), (Counter(), Counter()))
                if x["copies"] == 1:
                    n.update(words)
                    docs.update(different)
                else:
                    for t, c in Counter(words).items():
                        n[t] += c * x["copies"]
                        docs[t] += x["copies"]
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from passed_on()
    yield from passed_on()


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in two steps that stay within 64 bits up to 9 10^13 words."""
    n, whole = F.expr(str(n)) if isinstance(n, str) else n, F.expr(f"{total} + {terms}")
    high = (n + 1) * 100_000
    return 1 + F.call_function("div", high, whole) * 10_000 + F.call_function("div", (high % whole) * 10_000, whole)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two sources with terms in common, what these terms add over what was assumed of terms that one lacks."""
    for batch in batches:
        lists = batch.column(0)
        size = np.diff(lists.offsets.to_numpy())
        source, p, none = (lists.flatten().field(k).to_numpy() for k in range(3))
        begin = np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        size = np.repeat(size, size)
        names, at = np.unique(source, return_inverse=True)
        done = np.concatenate([[0], np.cumsum(size)])
        i0 = 0
        while i0 < len(p):
            i1 = max(i0 + 1, int(np.searchsorted(done, done[i0] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(i0, i1), size[i0:i1])
            j = begin[i] + np.arange(len(i)) - np.repeat(done[i0:i1] - done[i0], size[i0:i1])
            i, j = i[i != j], j[i != j]
            f = lambda a, b: (a - b) * (a - b) // b
            more = f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j])
            code, where = np.unique(at[i] * len(names) + at[j], return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, where, more)
            yield table("g long, h long, value long", {"g": names[code // len(names)], "h": names[code % len(names)], "value": total})
            i0 = i1


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Divergence of each source from the other sources (part ``pair``) and the terms that mark it (part ``term``).

    Needs ``text``, ``lang`` and ``source``; other columns are not looked at. Null values read as ''. Terms are maximal runs of
    ASCII letters, lower-cased, and characters beyond ASCII; a language keeps those in ``least`` of its documents. With n
    the count of a term in a group, N that of all kept terms and V their number, p = 1 + floor(10^9 (n + 1) / (N + V));
    f = floor((p - q)^2 / q). A pair's value sums f over all kept terms of the language (0 if there are none), q being the other source's; a
    term's q is the language's, and terms with n > 0 and p > q are ranked up to ``top``. Ties go to the smaller item by its bytes.

    Returns lang, source, part, item, value, rank. Texts are told apart by 128 bits of hash. Repeated rows count as often as
    they stand; groups whose texts hold no term take part; an empty table gives an empty one.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.select("lang", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.col("text").cast("binary").alias("text"))
    same = ["lang", "h1", "h2"]
    copies = settled(rows.groupBy(*same, "source").agg(F.count("*").alias("copies")))
    sources = copies.groupBy(*same).agg(F.collect_list(F.struct("source", "copies")).alias("sources"))
    texts = rows.groupBy(*same).agg(F.first("text").alias("text")).join(sources, same).select("lang", "text", "sources")

    # One exchange by term serves the sums by source and those over the sources.
    counted = (texts.mapInArrow(_counted, COUNTED).repartition("lang", "term")
               .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = settled(counted.groupBy("lang", "term")
                   .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
                   .where(F.col("docs") >= least).drop("docs"))
    held = kept.select("lang", "term", "total", F.explode("by_source").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    groups = copies.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "own", "terms", "all")])
    none = F.when(F.col("terms") > 0, share("0", "size", "terms")).alias("none")
    groups = settled(groups.withColumn("g", F.monotonically_increasing_id()).select("*", none))

    p = share("n", "size", "terms").alias("p")
    marked = settled(held.join(groups, ["lang", "source"]).select("lang", "source", "g", "term", "n", p, "none", share("total", "all", "terms").alias("q")))
    term = (marked.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
            .withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))))
    order = [F.desc("value"), "item"]
    for keys in (["lang", "source", "salt"], ["lang", "source"]):       # no group's terms meet in one task before they are few
        term = term.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)

    here = groups.where("terms > 0").select("lang", "g", "none", "own", "terms")
    there = here.select("lang", F.col("g").alias("h"), F.col("none").alias("q"), F.col("own").alias("others"))
    both = distance(F.col("none"), F.col("q"))
    lacking = here.join(there, "lang").where("g <> h").select("g", "h", ((F.col("terms") - F.col("own") - F.col("others")) * both).alias("value"))
    by_count = marked.groupBy("lang", "g", "p").agg(F.count("*").alias("m"))
    mine = (by_count.join(there, "lang").where("g <> h")
            .select("g", "h", (F.col("m") * distance(F.col("p"), F.col("q"))).alias("value")))
    others = (by_count.select("lang", F.col("g").alias("h"), "p", "m").join(here, "lang").where("g <> h")
              .select("g", "h", (F.col("m") * distance(F.col("none"), F.col("p"))).alias("value")))
    together = (marked.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "none")).alias("x"))
                .where(F.size("x") > 1).select("x").mapInArrow(_shared, "g long, h long, value long"))
    sums = settled(lacking.unionAll(mine).unionAll(others).unionAll(together).groupBy("g", "h").agg(F.sum("value").alias("value")))
    names = groups.select("lang", "source", "g")
    pair = (names.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").where("g <> h")
            .join(sums, ["g", "h"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value")))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pair.withColumn("part", F.lit("pair")).select(*columns)
            .unionAll(term.withColumn("part", F.lit("term")).select(*columns)))
