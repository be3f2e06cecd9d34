"""Repeated word sequences by recompression: runs and pairs of symbols get names until long repeats share some.

Every round names the runs of a symbol, or pairs a symbol of the left class with a following one of the right class;
classes are drawn by name, so a pair depends on its own two symbols and never overlaps another. A name is computed from
the names it replaces, hence all tasks give the same one without a dictionary. Inside a repeated sequence the symbols are the
same wherever it stands, but for its ends: a symbol's reach is the span of words that settles it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import settled, table

LENGTH = 50             # words of a window
RUN_ROUNDS = 4          # every so many rounds runs are named; in between only pairs, which need fewer neighbours
CHUNK = 1 << 21         # bytes of text parsed together
LAST = (1 << 63) - 1    # rank of rows without an id

U = np.uint64
FAR = np.int64(1 << 40)
STEP = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)     # odd, so that they have inverses modulo 2^64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _powers(bits: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of a step and of its inverse."""
    out = []
    for step in (STEP[lane], pow(STEP[lane], -1, 1 << 64)):
        p = np.full(1 << bits, step, U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def sequence_names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A name for each of the slices [start, end) of ``values``, equal for equal slices."""
    power, inverse = _powers(max(10, int(len(values)).bit_length()), lane)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(values * power[:len(values)])])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


_BYTES = mixed(np.arange(1, 257, dtype=U))


def word_names(line: bytes) -> np.ndarray:
    """A name for each word of a line whose words have one space between them."""
    raw = np.frombuffer(line, np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.concatenate([[0], ends[:-1] + 1])
    out, a = np.zeros(len(ends), U), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        base = starts[a]
        out[a:b] = sequence_names(_BYTES[raw[base:ends[b - 1]]], starts[a:b] - base, ends[a:b] - base)
        a = b
    return out


def rounds_for(length: int) -> int:
    """Rounds after which a sequence of ``length`` words still holds symbols that it settles itself: a round takes a
    quarter of the symbols, and the ends of a sequence leave some six symbols open."""
    return max(0, int(math.log(max(1.0, length / 6.5)) / math.log(4 / 3)))


def parse(name: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after some rounds: name, document, and the reach [left, right) in words.

    A symbol that a document's begin or end helped to settle has no finite reach."""
    left = np.arange(len(name), dtype=np.int64)
    right = left + 1
    for r in range(rounds):
        kind = name
        if r % RUN_ROUNDS == 0:
            same = np.zeros(len(name), bool)
            same[1:] = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
            at = np.flatnonzero(~same)
            size = np.diff(np.append(at, len(name)))
            end = at + size - 1
            begins = np.ones(len(at), bool)
            begins[1:] = doc[at[1:]] != doc[at[:-1]]
            stops = np.append(begins[1:], True)
            # A run ends where its neighbours are known to differ.
            before, after = np.full(len(at), -FAR), np.full(len(at), FAR)
            before[1:], after[:-1] = left[end[:-1]], right[at[1:]]
            before[begins], after[stops] = -FAR, FAR
            kind = name[at]
            name = np.where(size > 1, mixed(kind * U(3) + size.astype(U)), kind)
            left, right, doc = np.minimum(left[at], before), np.maximum(right[end], after), doc[at]
        first = (mixed(kind ^ U(r + 1)) & U(1)).astype(bool)
        joined = np.append(doc[1:] == doc[:-1], False)                      # a next symbol in the document
        head = first & joined & ~np.append(first[1:], True)
        tail = np.append(False, head[:-1])[:len(name)]
        after = np.where(joined, np.append(right[1:], 0), FAR)
        before = np.where(np.append(False, joined[:-1])[:len(name)], np.append(0, left[:-1])[:len(name)], -FAR)
        # Unpaired, a left symbol depends on the next one and a right symbol on the one before.
        new_left = np.where(~first & ~tail, np.minimum(left, before), left)
        new_right = np.where(first, np.maximum(right, after), right)        # a pair reaches as far as both
        h = np.flatnonzero(head)
        new_left[h] = np.minimum(left[h], left[h + 1])
        name = name.copy()
        name[h] = mixed(name[h] * U(5) + mixed(name[h + 1]) + U(r))
        keep = ~tail
        name, doc, left, right = name[keep], doc[keep], new_left[keep], new_right[keep]
    return name, doc, left, right


def _within(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of the places 0..n-1 lie in one of the ranges [first, last]."""
    edges = np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1)[:n + 1]
    return np.cumsum(edges[:n]) > 0


PARSED = "row long, doc_id long, rank long, n_words long, text binary, open boolean, names binary, lefts binary, widths binary"


def _parsed(length: int):
    """Arrow step: words, symbols that a window can settle, and whether some window settles none."""
    rounds = rounds_for(length)

    def symbols(lines: list[bytes], sizes: list[int]) -> list[tuple[bool, bytes, bytes, bytes]]:
        out = [(False, b"", b"", b"")] * len(lines)
        long = [i for i, n in enumerate(sizes) if n >= length]
        if not long:
            return out
        n = np.array([sizes[i] for i in long], np.int64)
        begin = np.concatenate([[0], np.cumsum(n)])
        name, doc, left, right = parse(word_names(b" ".join([lines[i] for i in long])), np.repeat(np.arange(len(long)), n), rounds)
        use = right - left <= length
        name, doc, left, right = name[use], doc[use], left[use], right[use]
        settles = _within(np.maximum(right - length, begin[doc]), np.minimum(left, begin[doc + 1] - length), int(begin[-1]))
        cut = np.searchsorted(doc, np.arange(len(long) + 1))
        name, width, left = name.view(np.int64), (right - left).astype(np.uint16), (left - begin[doc]).astype(np.int32)
        for k, i in enumerate(long):
            a, b = cut[k], cut[k + 1]
            open_ = not settles[begin[k]:begin[k + 1] - length + 1].all()
            out[i] = (open_, name[a:b].tobytes(), left[a:b].tobytes(), width[a:b].tobytes())
        return out

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lines, sizes, total, start = [], [], 0, at
                while at < batch.num_rows and total < CHUNK:
                    words = (batch.column(2)[at].as_py() or b"").split()
                    lines.append(b" ".join(words))
                    sizes.append(len(words))
                    total += len(lines[-1])
                    at += 1
                found = symbols(lines, sizes)
                ids = batch.column(1).slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, at - start), ids, ids.fill_null(LAST), pa.array(sizes, pa.int64()),
                     pa.array(lines, pa.binary()), pa.array([x[0] for x in found], pa.bool_()),
                     *[pa.array([x[k] for x in found], pa.binary()) for k in (1, 2, 3)]],
                    names=["row", "doc_id", "rank", "n_words", "text", "open", "names", "lefts", "widths"])
    return step


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per symbol: its name, row, rank and number."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            names = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
            sizes = np.array([len(x) for x in names], np.int64)
            yield table("name long, row long, rank long, at int",
                        {"name": np.concatenate(names), "row": np.repeat(part.column(0).to_numpy(), sizes),
                         "rank": np.repeat(part.column(1).to_numpy(), sizes),
                         "at": np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])})


WINDOWS = "hi long, lo int, row long, rank long, at int, asks boolean"


def _windows(length: int):
    """Arrow step: the windows in which every settled symbol stands in several documents, named by their words. A
    window asks whether an earlier document has it if one of lower rank has each of these symbols."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rank, text, lefts, widths, marks in zip(*[c.to_pylist() for c in batch.columns]):
                left = np.frombuffer(lefts, np.int32).astype(np.int64)
                last = left + np.frombuffer(widths, np.uint16) - length
                marks = np.array(marks or [], np.int64)
                n = text.count(b" ") + 1
                first, final = np.maximum(last, 0), np.minimum(left, n - length)
                alone, leading = np.ones(len(left), bool), np.ones(len(left), bool)
                alone[marks >> 1] = False
                leading[(marks >> 1)[(marks & 1) == 1]] = False
                open_ = ~_within(first[alone], final[alone], n - length + 1)
                if not open_.any():
                    continue
                asks = ~_within(first[leading], final[leading], n - length + 1)
                at = np.flatnonzero(open_)
                words = word_names(text)
                hi, lo = sequence_names(words, at, at + length), sequence_names(mixed(words + U(1)), at, at + length, 1)
                yield table(WINDOWS, {"hi": hi.view(np.int64), "lo": (lo >> U(32)).astype(np.uint32).view(np.int32), "row": np.full(len(at), row),
                                      "rank": np.full(len(at), rank), "at": at.astype(np.int32), "asks": asks[at]})
    return step


def _cut(length: int):
    """Arrow step: the words that no repeated window covers."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for n, text, starts in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)]):
                if starts is None:
                    gone.append(0)
                    kept.append(text)
                    continue
                at = np.array(starts, np.int64)
                out = _within(at, at + length - 1, n)
                gone.append(int(out.sum()))
                kept.append(b" ".join([w for w, x in zip(text.split(), out.tolist()) if not x]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"])
    return step


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Remove every word that lies in a window of ``length`` words which also stands in a document of smaller doc_id.

    Needs ``doc_id`` (integer) and ``text``; other columns are not looked at. Returns per row doc_id, n_words, n_removed,
    kept (the words left, one space between). Words are cut at ASCII space and control characters 9 to 13. A null or empty text has no
    words. Rows without an id rank after all others; rows of one id remove nothing from each other, so repeated rows give
    repeated results. Texts are whole whatever their length; an empty table gives an empty one.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parsed = settled(texts.mapInArrow(_parsed(length), PARSED))
    symbols = (parsed.where(F.col("n_words") >= length).select("row", "rank", "names")
               .mapInArrow(_exploded, "name long, row long, rank long, at int"))
    shared = settled(symbols.groupBy("name").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
                     .where("first < last").select("name", "first"))
    mark = (F.col("at") * 2 + (F.col("first") < F.col("rank")).cast("int")).alias("mark")
    marks = settled(symbols.join(shared, "name").select("row", mark).groupBy("row").agg(F.collect_list("mark").alias("marks")))
    marked = (parsed.where(F.col("n_words") >= length).join(marks, "row", "left").where("open OR marks IS NOT NULL")
              .select("row", "rank", "text", "lefts", "widths", "marks"))
    windows = settled(marked.mapInArrow(_windows(length), WINDOWS))
    earliest = settled(windows.groupBy("hi", "lo").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
                       .where("first < last").select("hi", "lo", "first"))
    removed = settled(windows.where("asks").join(earliest, ["hi", "lo"]).where("first < rank")
                      .groupBy("row").agg(F.collect_list("at").alias("starts")))
    out = (parsed.select("row", "doc_id", "n_words", "text").join(removed, "row", "left")
           .select("doc_id", "n_words", "text", "starts")
           .mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept binary"))
    return out.withColumn("kept", F.col("kept").cast("string"))


def repeats_digest(docs: DataFrame) -> DataFrame:
    """Per document the words, those removed and the hash of the rest; see ``without_repeats``."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
