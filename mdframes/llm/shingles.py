"""Near copies by exact Jaccard similarity of word shingles, found by vantage-point trees over SimHash fingerprints and over the
rarest shingles of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import connected, shuffle_partitions, staged, table
from mdframes.llm.simhash import ROWS, majority, near_links

WIDTH = 5
NUMBER, OF = 4, 5       # the least similarity, 4/5, as whole numbers: no pair is lost to rounding
SAMPLE = 60_000         # texts whose shingles tell which are common; an estimate, which only costs depend on
COMMON = 300_000        # shingles known as common, 16 bytes each, that are sent to every task
STARS = 2               # texts of a shingle that all others of it are compared with before all pairs are
PAIRS = 1 << 16         # pairs in one Arrow batch
BITS = 64, 8192         # the fewest and the most bits of a set's parities

POSTING = "shingle long, key long, n int, place int"


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different hashed shingles of a text, ascending; none for a text without words."""
    words = [w.encode("utf-8", "replace") for w in (text or "").lower().split()]
    if not words:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(line)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return np.unique(np.array([h(line[a:b - 1]) for a, b in zip([0, *ends], ends[width - 1:])], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least 4/5; two empty sets are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= NUMBER * (len(a) + len(b) - common)


def parities(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall on each of some slots, modulo 2, as words of 64 bits; there are about as many slots as shingles.

    A shingle that only one of two sets holds changes one bit, so sets differ by at least as many shingles as their parities
    by bits. The halves of the words added modulo 2 are the parities over half as many slots."""
    slots = min(max(1 << (len(shingles) - 1).bit_length() if len(shingles) else 0, BITS[0]), BITS[1])
    odd = np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


class Marks:
    """The parities of some sets, those of equal width together; ``order`` sorts the sets by width."""

    def __init__(self, marks: np.ndarray):
        wide = np.array([len(x) // 8 for x in marks], np.int64)
        self.order = np.argsort(wide, kind="stable")
        marks, wide = marks[self.order], wide[self.order]
        starts = np.flatnonzero(np.append(True, wide[1:] != wide[:-1]))
        self.parts = [(a, np.frombuffer(b"".join(marks[a:b]), "<u8").reshape(b - a, wide[a]))
                      for a, b in zip(starts, np.append(starts[1:], len(wide)))]

    def differing(self, i: int, j: np.ndarray) -> np.ndarray:
        """The number of bits in which sets ``j`` (ascending) differ from set i, over the lesser of both widths."""
        own = next(words[i - a] for a, words in reversed(self.parts) if a <= i)
        out = []
        for a, words in self.parts:
            at = j[np.searchsorted(j, a):np.searchsorted(j, a + len(words))] - a
            if len(at):
                width = min(len(own), words.shape[1])
                out.append(np.bitwise_count(_folded(words[at], width) ^ _folded(own, width)).sum(axis=1, dtype=np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; Spark's skips nulls, so their places are added."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def _key(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that several of some texts hold, ascending by how many hold them."""
    total = docs.count()
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(text, width) for batch in batches for text in set(batch.column(0).to_pylist())]
        if sets:
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            yield table("shingle long, n long", {"shingle": found[n > 1].view(np.int64), "n": n[n > 1]})

    texts = docs.select("text").where(unit < min(1.0, SAMPLE / max(total, 1)))
    most = (texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow())
    return most.column(0).to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _keyed(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, row (hash of all its columns), key of its shingle set, the set's size, its rarest shingles, its
    parities and its SimHash fingerprint.

    Sets at least 4/5 similar share 4/5 of the larger one at least, so whatever the order of shingles,
    the first n - ceil(4n/5) + 1 of both have one in common."""
    common = _common(docs, width)
    by_value = np.argsort(common, kind="stable")
    held = docs.sparkSession.sparkContext.broadcast((common[by_value], by_value))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rank = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                sets = [shingle_set(text, width) for text in batch.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                fp = np.zeros(len(sets), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    fp[full] = majority(np.concatenate(sets), np.cumsum(sizes[full]) - sizes[full], sizes[full])
                first = []
                for s in sets:
                    if len(values):
                        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                        s = s[np.lexsort([s, np.where(values[at] == s, rank[at], -1)])]
                    first.append(s[:len(s) - -(-NUMBER * len(s) // OF) + 1].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([_key(s) for s in sets], pa.int64()), pa.array(sizes, pa.int32()),
                     pa.array(first, pa.binary()), pa.array([parities(s).tobytes() for s in sets], pa.binary()), pa.array(fp.view(np.int64))],
                    names=["doc_id", "row", "key", "n", "first", "marks", "fp"])

    return (docs.select("doc_id", "text", row_hash(docs).alias("row"))
            .mapInArrow(compute, f"doc_id {kind}, row long, key long, n int, first binary, marks binary, fp long"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            first = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
            sizes = np.array([len(x) for x in first], np.int64)
            if not sizes.sum():
                continue
            yield table(POSTING, {"shingle": np.concatenate(first), "key": np.repeat(part.column(0).to_numpy(), sizes),
                                  "n": np.repeat(part.column(1).to_numpy(), sizes),
                                  "place": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches of whole groups of equal shingles, as columns, from a partition sorted by shingle."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(np.searchsorted(now[0], now[0][-1]))
        if held and held[-1][0][-1] == now[0][-1]:      # the open group goes on
            held.append(now)
            continue
        yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in now])]
        held = [[c[last:] for c in now]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of shingles that several sets hold."""
    for columns in _groups(batches):
        shingle = columns[0]
        same = shingle[1:] == shingle[:-1]
        keep = np.append(same, False) | np.append(False, same) if len(shingle) else np.zeros(0, bool)
        if keep.any():
            yield table(POSTING, dict(zip(("shingle", "key", "n", "place"), (c[keep] for c in columns))))


def _possible(n, place, m, other) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one stands at these places can be similar."""
    return (NUMBER + OF) * np.minimum(n - place, m - other) >= NUMBER * (n + m)


def _pairs(stars: int):
    """Candidate pairs of different roots, smaller key first, from postings with the root and the parities of their key: each set
    with ``stars`` others of its shingle, or, if there are none, all pairs. Pairs whose places or parities show that they are
    not similar are left out."""
    salts = [np.uint64(2 * star + 0x9E3779B97F4A7C15) for star in range(stars)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for shingle, key, n, place, root, marks in _groups(batches):
            starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(shingle))
            mixed = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts) if len(starts) else np.zeros(0, bool)
            for a, b in zip(starts[mixed], ends[mixed]):
                known = Marks(marks[a:b])
                k, s, p, r = (c[a:b][known.order] for c in (key, n.astype(np.int64), place.astype(np.int64), root))
                centres = {int((k.view(np.uint64) * salt).argmin()) for salt in salts} if stars else range(len(k) - 1)
                for i in centres:
                    j = np.arange(0 if stars else i + 1, len(k))
                    j = j[(r[j] != r[i]) & _possible(s[i], p[i], s[j], p[j])]
                    # Similar sets share 4/9 of n + m shingles at least, so at most 1/9 of n + m are in one of them alone.
                    j = j[(NUMBER + OF) * known.differing(i, j) <= s[i] + s[j]]
                    if len(j):
                        out.append(np.stack([np.minimum(k[i], k[j]), np.maximum(k[i], k[j])]))
                        held += len(j)
                    if held >= PAIRS:
                        both, out, held = np.unique(np.concatenate(out, axis=1), axis=1), [], 0
                        yield table("a long, b long", {"a": both[0], "b": both[1]})
        if out:
            both = np.unique(np.concatenate(out, axis=1), axis=1)
            yield table("a long, b long", {"a": both[0], "b": both[1]})

    return find


def _tree_pairs(sets: DataFrame) -> DataFrame:
    """Candidate pairs, smaller key first, by vantage-point trees: sets of one fingerprint with the first of them, and the
    first sets of fingerprints that the trees link. There are at most as many as sets and links."""
    heads = staged(sets.groupBy("fp").agg(F.min("key").alias("head")))
    same = sets.join(heads, "fp").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = (near_links(heads.select("fp")).join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return same.unionAll(near).where("a <> b")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets are similar, from the texts themselves."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, own = [], None, None
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, own = a, shingle_set(x.as_py(), width)
                keep.append(similar(own, shingle_set(y.as_py(), width)))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left, right = texts.toDF("a", "own"), texts.toDF("b", "other")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "own", "other").mapInArrow(check, "a long, b long")


def shingle_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, row (hash of all columns), and group, the same for all texts that are linked by
    pairs of at least 4/5 Jaccard similarity over their different lower-cased word shingles. Every such pair
    is found: vantage-point trees link fingerprints at most 3 bits apart, which most near copies are; other candidates share one
    of their rarest shingles. All are compared by their texts.

    Texts without words form one group; fewer words than ``width`` make one shingle. Equal sets are compared once.
    The trees and comparing with a few texts of each shingle link the large groups; then all pairs of
    texts that share a rare shingle, are not linked yet and may be similar by their parities are compared.
    """
    spark = docs.sparkSession
    keyed = staged(_keyed(docs, width))
    postings = keyed.groupBy("key").agg(F.first("n").alias("n"), F.first("first").alias("first")).select("key", "n", "first")
    deal = lambda df: df.repartition(shuffle_partitions(spark), "shingle").sortWithinPartitions("shingle", "key")
    shared = staged(deal(postings.mapInArrow(_postings, POSTING)).mapInArrow(_shared, POSTING))
    # Any text of a set gives the set.
    sets = staged(keyed.groupBy("key").agg(F.min("row").alias("row"), F.first("marks").alias("marks"), F.first("fp").alias("fp")))

    def rare_pairs(roots: DataFrame, stars: int) -> DataFrame:
        rooted = shared.join(roots.select("key", "root", "marks"), "key").select(*shared.columns, "root", "marks")
        return deal(rooted).mapInArrow(_pairs(stars), "a long, b long")

    def similar_pairs(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.distinct())
        wanted = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
        chosen = sets.select("key", "row").join(wanted, "key")
        texts = (docs.select(row_hash(docs).alias("row"), "text").join(chosen, "row")
                 .groupBy("key").agg(F.first("text").alias("text")).select("key", "text"))
        return staged(_verified(pairs, staged(texts), width))

    roots = connected(similar_pairs(_tree_pairs(sets).unionAll(rare_pairs(sets.withColumn("root", F.col("key")), STARS))))
    rooted = sets.join(roots, sets.key == roots.node, "left").select("key", F.coalesce("root", "key").alias("root"), "marks")
    found = similar_pairs(rare_pairs(rooted, 0))
    if not found.isEmpty():
        roots = connected(found.unionAll(roots.toDF("a", "b")))
    return keyed.join(roots, keyed.key == roots.node, "left").select("doc_id", "row", F.coalesce("root", "key").alias("group"))
