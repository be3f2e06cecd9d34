"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import doc_crc, table

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
BUCKETS = 1 << 14
GRAMS = (2, 3, 4)
DIM = 16
TAIL = 3.09             # standard deviations that all but a thousandth of a normal distribution stay within


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all 2- to 4-byte subwords of the lower-cased text, word edges included."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    out, h = [], raw
    for n in range(2, GRAMS[-1] + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ raw[n - 1:]
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(18))
    return np.concatenate(out)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray       # per bucket its embedding times the output layer
    bias: np.ndarray
    heat: float             # calibrated temperature
    least: float            # calibrated probability below which a text is rejected
    known: np.ndarray       # per bucket the logarithm of its share in each language
    usual: np.ndarray       # per language the mean of that over a text, its variance between texts, and within them
    far: float              # deviation from the usual beyond which a text is of no learned language

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected); a text without letters is unknown."""
        if not text or not self.labels or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        ids = subwords(text)
        logits = (self.table[ids].mean(axis=0, dtype=np.float64) + self.bias) / self.heat
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        strange = _deviation(self.known[ids, best].mean(dtype=np.float64), len(ids), self.usual[best])
        return self.labels[best], float(p[best]), bool(p[best] < self.least or strange > self.far)


def _deviation(share: float, subwords: int, usual: np.ndarray) -> float:
    """How far the mean log share of a text's subwords lies below the usual, in standard deviations for its length."""
    return float((usual[0] - share) / np.sqrt(usual[1] + usual[2] / subwords + 1e-12))


def _sample(docs: DataFrame, learn: Column, per_language: int) -> DataFrame:
    """About ``per_language`` labelled rows of each language, chosen by hash, never more than twice that on average."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return labelled.select("lang", "text")
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(unit < F.element_at(share, F.col("lang"))).limit(2 * per_language * len(counts)).select("lang", "text")


def fit(docs: DataFrame, learn: Column, per_language: int = 1000, epochs: int = 6, seed: int = 7) -> Model:
    """Train on a bounded sample of the rows that ``learn`` admits: at most ``2 * per_language`` a
    language, each reduced in its task to subword counts (at most ``BUCKETS`` numbers, however long the
    text). The only inputs are text and lang. A fifth of the sample is kept from training and sets the
    temperature (least log loss) and two thresholds that all but a thousandth of the right predictions
    keep: the calibrated probability, and how much rarer a text's subwords are in its language than is usual there, which
    tells texts of no learned language however few are learned. Where the kept fifth is too small to show a thousandth, a normal
    tail stands in. With nothing kept the probability must be one half."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(subwords(t), return_counts=True) for t in batch.column(1).to_pylist()]
            yield table("lang string, n long, ids binary, weights binary", {
                "lang": batch.column(0).to_pylist(), "n": [n.sum() for _, n in found], "ids": [i.astype("<u2").tobytes() for i, _ in found],
                "weights": [(n / n.sum()).astype("<f4").tobytes() for _, n in found]})

    rows = _sample(docs, learn, per_language).mapInArrow(reduce, "lang string, n long, ids binary, weights binary").toArrow()
    names = rows.column("lang").to_pylist()
    labels = sorted(set(names))
    target = np.array([labels.index(x) for x in names], np.int64)
    lengths = rows.column("n").to_numpy()
    # Views of Arrow's own memory, no second copy of the sample.
    ids = [np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("ids")]
    weights = [np.frombuffer(x.as_buffer(), "<f4") for x in rows.column("weights")]
    del rows
    # The order rows arrive in depends on the cluster; their content decides instead.
    order = sorted(range(len(ids)), key=lambda i: (target[i], len(ids[i]), zlib.crc32(ids[i]), zlib.crc32(weights[i])))
    order = np.random.default_rng(seed).permutation(np.array(order, np.int64))
    hold, train = order[:len(order) // 5], order[len(order) // 5:]

    rng = np.random.default_rng(seed)
    classes = len(labels)
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, max(classes, 1)), np.float32), np.zeros(max(classes, 1), np.float32)
    for epoch in range(epochs):
        rate = np.float32(2.0 * (1 - epoch / epochs))
        for i in rng.permutation(train):
            u, w = ids[i], weights[i]
            mean = w @ embed[u]
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[target[i]] -= 1
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * np.float32(0.1) * g
            embed[u] -= rate * w[:, None] * back[None, :] * np.float32(8)
    scores = embed @ out
    z = np.array([weights[i] @ scores[ids[i]] + bias for i in hold]).reshape(-1, max(classes, 1))
    heat, least, best = 1.0, 0.5, np.inf
    for t in np.geomspace(0.05, 20, 61):
        p = z / t - (z / t).max(axis=1, keepdims=True) if len(z) else z
        p = np.exp(p) / np.exp(p).sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(z)), target[hold]], 1e-12)).mean() if len(z) else 0.0
        if loss < best:
            best, heat = loss, float(t)
            right = p.max(axis=1)[p.argmax(axis=1) == target[hold]]
            least = _least(right) if len(right) else 0.5
    known, usual = _shares(ids, weights, lengths, target, train, classes)
    right = [i for i, c in zip(hold, z.argmax(axis=1)) if c == target[i]]
    strange = [_deviation(weights[i] @ known[ids[i], target[i]], lengths[i], usual[target[i]]) for i in right]
    far = max(np.quantile(strange, 0.999), np.mean(strange) + TAIL * np.std(strange)) if strange else np.inf
    return Model(labels, scores, bias, heat, least, known, usual, float(far))


def _least(right: np.ndarray) -> float:
    """The probability that all but a thousandth reach, by their quantile or by the normal tail of their log-odds."""
    odds = np.log(np.clip(right, 1e-12, 1 - 1e-12) / (1 - np.clip(right, 1e-12, 1 - 1e-12)))
    return float(1 / (1 + np.exp(-min(np.quantile(odds, 0.001), odds.mean() - TAIL * odds.std()))))


def _shares(ids: list, weights: list, lengths: np.ndarray, target: np.ndarray, train: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The log share of each bucket in each language, and its usual mean over texts with the variances between and within.

    Each text is judged by the other half of its language's texts, as its own subwords are never unknown to it."""
    halves = np.full((2, BUCKETS, max(classes, 1)), 0.5, np.float64)
    for k, i in enumerate(train):
        halves[k % 2, ids[i], target[i]] += weights[i] * float(lengths[i])
    log = lambda counts: np.log(counts / counts.sum(axis=0)).astype(np.float32)
    parts, seen = [log(h) for h in halves], [[] for _ in range(max(classes, 1))]
    for k, i in enumerate(train):
        share = parts[1 - k % 2][ids[i], target[i]]
        mean = float(weights[i] @ share)
        seen[target[i]].append((mean, float(weights[i] @ (share - mean) ** 2), lengths[i]))
    usual = np.zeros((max(classes, 1), 3))
    for c, rows in enumerate(seen):
        if rows:
            mean, within, n = np.array(rows, np.float64).T
            usual[c] = mean.mean(), max(0.0, mean.var() - (within / n).mean()), within.mean()
    return log(halves.sum(axis=0)), usual


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (0 to 1) and rejected, from the whole text alone. A null text or
    one without letters is ``und`` with score 0 and rejected, as is every row if nothing could be learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # bounded by BUCKETS x number of labels
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = zip(*map(shared.value.predict, batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return F.pmod(doc_crc(), F.lit(3)) == 1


def language_id(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """Train on the rows whose crc32(doc_id) mod 3 is not 1, predict all: doc_id, held_out, lang_pred, score, rejected."""
    found = identify(docs, fit(docs, ~held_out(), per_language))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """The rows of ``docs`` whose language the model does not reject, all columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out(), per_language))

    @F.pandas_udf("boolean")
    def known(text):
        return text.map(lambda t: isinstance(t, str) and not model.value.predict(t)[2]).astype(bool)

    return docs.where(known("text"))
