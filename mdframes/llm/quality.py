"""Quality scores from Bradley-Terry preference pairs."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import doc_crc, staged, table
from mdframes.operators.scan import running

CUT = 0.7       # score from which a document counts as good
SIGNS = b"|!$%&*#~^<>={}[]\\_@+/"


def features(text: str | None) -> list[float]:
    """Shares that describe a text's form: repetition, signs, capitals, lengths. All are 0 for an empty text but the first."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * 17
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    same = sum(map(operator.eq, words, words[1:])) / n
    again = sum(map(operator.eq, words, words[2:])) / n
    distinct = len(set(words)) / n
    lines = text.split("\n")
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    bare = sum(map(str.isalpha, words)) / n
    return [0.0, same, same ** 0.5, again, distinct, distinct * np.log1p(n), np.log1p(n),
            count[list(SIGNS)].sum() / n, min(1.0, count[list(SIGNS)].sum() / n) ** 0.5, count[ord("|")] / n, count[ord("!")] / n,
            upper / (upper + lower + 1), upper / n, count[48:58].sum() / size, size / n, (count[ord(".")] + count[ord(",")]) / n,
            1 - len(set(lines)) / len(lines), bare]


WIDTH = len(features(None))


@dataclass
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float          # raw score at the quantile that separates good from bad

    def spread_out(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -6, 6)
        return np.concatenate([z, np.abs(z)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.spread_out(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Raw scores on the scale 0 to 1, the quantile threshold at ``CUT``."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.asarray(features(t), np.float64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def held_out() -> Column:
    return F.pmod(doc_crc(), F.lit(4)) == 2


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, quality, x) of each class numbered from 0, in an order that only the rows decide."""
    dealt = rows.withColumn("_h", F.xxhash64("doc_id", "x")).withColumn("_b", F.pmod("_h", F.lit(1 << 10)))
    return running(dealt, ["quality"], "_b", ["_h", "x"], {"_n": F.lit(1)}).select("quality", "x", (F.col("_n") - 1).cast("long").alias("at"))


def _pairs(rows: DataFrame, many: int, n: dict[int, int], rounds: int) -> DataFrame:
    """Preference pairs (good, bad): every row of the larger class ``many`` takes part ``rounds`` times, with partners that go
    around the other class, so that each of its rows takes part as well."""
    few = n[1 - many]
    numbered = staged(_numbered(rows))
    turn = F.explode(F.array(*[F.lit(t) for t in range(rounds)]))
    left = numbered.where(F.col("quality") == many).select(F.col("x").alias("own"), "at", turn.alias("turn"))
    left = left.select("own", F.pmod(F.col("at") + F.col("turn") * F.lit(max(1, few // rounds)), F.lit(few)).alias("at"))
    right = numbered.where(F.col("quality") == 1 - many).select("at", F.col("x").alias("other"))
    good, bad = ("own", "other") if many == 1 else ("other", "own")
    return left.hint("merge").join(right, "at").select(F.col(good).alias("good"), F.col(bad).alias("bad"))


def _slope(model: Ranking):
    """Per task the gradient and the curvature of the pairs' logistic loss, flat."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, curve = np.zeros(2 * WIDTH), np.zeros((2 * WIDTH, 2 * WIDTH))
        for batch in batches:
            d = model.spread_out(_matrix(batch.column(0))) - model.spread_out(_matrix(batch.column(1)))
            lost = 1 / (1 + np.exp(np.clip(d @ model.weights, -30, 30)))
            grad -= lost @ d
            curve += (d * (lost * (1 - lost))[:, None]).T @ d
        flat = np.concatenate([grad, curve.ravel()])
        yield table("idx int, v double", {"idx": np.arange(len(flat), dtype=np.int32), "v": flat})

    return add


def _cut(raw: DataFrame, k: int) -> float:
    """Halfway from the value of rank ``k`` (from 0) to the next one, found by counting in ever finer intervals."""
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    below, first, last = 0, lo, hi
    for _ in range(4):
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            break
        place = F.least(F.floor((F.col("raw") - lo) / width), F.lit(4095)).alias("place")
        inside = raw.where((F.col("raw") >= lo) & (F.col("raw") <= hi))
        for place, n in sorted(map(tuple, inside.groupBy(place).count().collect())):
            if below + n > k:
                lo, hi = lo + place * width, min(hi, lo + (place + 1) * width)
                break
            below += n
        below = raw.where(F.col("raw") < lo).count()
    top = F.col("raw") <= hi
    here, n, after = raw.agg(F.max(F.when(top, F.col("raw"))), F.count_if(top), F.min(F.when(~top, F.col("raw")))).first()
    return here if n > k + 1 or after is None else (here + after) / 2


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rounds: int = 2, steps: int = 8) -> Ranking:
    """Learn weights from preference pairs (a good and a bad document) by logistic loss on feature
    differences, over all documents whose labels may be learned from: their features are staged, all statistics are taken
    over all of them, each takes part in pairs, and Newton steps add up gradients and curvatures in the tasks. The
    threshold is the raw score at the quantile given by the share of bad documents. Without both classes every score
    is equal and every document good."""
    marked = labels.where(learn & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_features, f"doc_id {kind}, x array<double>")
    rows = staged(found.hint("merge").join(marked, "doc_id").select("doc_id", "quality", "x"))
    n = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    if len(n) < 2:
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(2 * WIDTH), 0.0 - 1.0)
    x = [F.col("x")[i] for i in range(WIDTH)]
    stats = np.array(rows.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first(), np.float64).round(10)
    model = Ranking(stats[:WIDTH], np.maximum(stats[WIDTH:], 1e-6), np.zeros(2 * WIDTH), 0.0)
    many = 1 if n[1] >= n[0] else 0
    pairs = staged(_pairs(rows, many, n, rounds))
    size, ridge = n[many] * rounds, 1e-4
    for _ in range(steps):
        flat = pairs.mapInArrow(_slope(model), "idx int, v double").groupBy("idx").agg(F.sum("v").alias("v")).orderBy("idx").toArrow()["v"].to_numpy()
        grad = flat[:2 * WIDTH] / size + ridge * model.weights
        curve = flat[2 * WIDTH:].reshape(2 * WIDTH, 2 * WIDTH) / size + ridge * np.eye(2 * WIDTH)
        model.weights = (model.weights - np.linalg.solve(curve, grad)).round(9)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table("raw double", {"raw": model.raw(_matrix(batch.column(0)))})

    model.cut = float(_cut(staged(rows.select("x").mapInArrow(raw, "raw double")), n[0] - 1))
    return model


def rank(docs: DataFrame, model: Ranking) -> DataFrame:
    """Per row of ``docs``: doc_id, score and predicted from the whole text alone; a null text is scored as an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, WIDTH)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels whose crc32(doc_id) mod 4 is not 2, score all documents: doc_id, held_out, score, predicted."""
    found = rank(docs, fit(docs, labels, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the ranking accepts, all columns unchanged."""
    model = fit(docs, labels, ~held_out())

    @F.pandas_udf("boolean")
    def good(text):
        return text.map(lambda t: bool(model.score(np.array([features(t if isinstance(t, str) else None)]))[0] >= CUT)).astype(bool)

    return docs.where(good("text"))
