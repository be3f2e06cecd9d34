"""Best-two-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdframes.llm.common import gather, shuffle_partitions, staged

SIMPLE = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\\[-`{-~]*)$"       # no apostrophe: the tokenizer knows contractions
ODD = "[\x1c-\x1f]"         # white space to Arrow, not to the tokenizer
CACHE = 350_000             # parts of words at which a worker lets go of those that it hasn't met since it last did
LONG = 64                   # characters beyond which a part isn't kept
CHUNK = 16 << 20            # bytes of text that are split at once

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, worked out once per distinct word of a chunk.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words in turn. It also parts letters from signs: a word of Latin letters and signs after them is
    the ids of its lower-cased letters and those of the signs, and both are remembered. Other words go
    through the whole tokenizer; they are kept behind a blank, which no word holds.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xC0, 0x100)}      # the model spells bytes as characters
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def part(self, part: str) -> bytes:
        """The ids of a run of lower-case letters, or of signs."""
        tokens = self.model.tokenize(part if part.isascii() else part.translate(self.spelling))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Those met since the last clearing, and those met between the two last, are known."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, parts))
        rest = []
        for i, part in enumerate(parts):
            if ids[i] is None:
                ids[i] = self.older.get(part)
                if ids[i] is None:
                    if part.startswith(" "):
                        rest.append(i)
                        continue
                    ids[i] = self.part(part)
                if len(part) <= LONG:
                    self.known[part] = ids[i]
        for i, found in zip(rest, self.whole([parts[i][1:] for i in rest])):
            ids[i] = found
            if len(parts[i]) <= LONG:
                self.known[parts[i]] = found
        return ids

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where those of each word start and how many they are."""
        cut = pc.extract_regex(words, SIMPLE)
        simple = cut.is_valid()
        letters = pc.if_else(simple, pc.utf8_lower(pc.struct_field(cut, 0)), pc.binary_join_element_wise("", words, " "))
        both = pa.concat_arrays([letters, pc.if_else(simple, pc.struct_field(cut, 1), "")]).dictionary_encode()
        found = self.parts(both.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = both.indices.to_numpy().reshape(2, -1).T.ravel()
        flat, ends = gather(np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size, at)
        starts = np.append(0, ends[1::2])
        return flat, starts[:-1], np.diff(starts)

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text; a null text has none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, ODD)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
            whole = odd.slice(a, b - a)
            split = pc.utf8_split_whitespace(pc.if_else(whole, "", texts.slice(a, b - a)))
            words = split.flatten().dictionary_encode()
            flat, ends = gather(*self.words(words.dictionary), words.indices.to_numpy())
            bounds = np.append(0, ends)[np.cumsum(np.append(0, pc.list_value_length(split).to_numpy()))].tolist()
            for i, w in enumerate(whole.to_pylist()):
                yield self.whole([texts[a + i].as_py()])[0] if w else flat[bounds[i]:bounds[i + 1]].tobytes()
            a = b


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """Every document as pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32
    and, if asked for, the ids as an array. A document is its ids and then ``end``; a null text is empty.
    Only longer documents are cut, into full pieces and a last one that may be shorter."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for row, data in enumerate(encoder.encode(batch.column(1))):
                data += last
                for piece, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a:a + 4 * capacity]
                    out.append((row, piece, a // 4, len(part) // 4, zlib.crc32(part), part))
            row, piece, start, length, code, data = zip(*out) if out else [()] * 6
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(code, pa.int64())]
            if ids:
                arrays.append(pa.array([np.frombuffer(d, "<u4").astype(np.int32) for d in data], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(arrays)])

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Pack documents given only how many there are of each length; returns the segments
    (length, first rank, sequence base, documents per sequence, offset), one row each, and the number
    of sequences.

    A bin is filled greedily, longest fitting document first. Then its smallest document is replaced
    by the two unpacked ones that fill the gap with it most tightly, if they fill it better than it
    does. The same filling is repeated as often as the lengths last, so the plan's size depends on the
    number of distinct lengths, not on the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rank, segments, sequences = np.zeros(capacity + 1, np.int64), [], 0
    while left.any():
        use: dict[int, int] = {}
        gap = capacity
        while gap and len(fits := np.flatnonzero(left[:gap + 1])):
            length = int(fits[-1])
            n = int(min(left[length], gap // length))
            use[length] = use.get(length, 0) + n
            left[length] -= n
            gap -= n * length
        small = min(use)
        if gap and (two := _two(left, gap + small)) and sum(two) > small:
            use[small] -= 1
            left[small] += 1
            for length in two:
                use[length] = use.get(length, 0) + 1
                left[length] -= 1
            use = {k: n for k, n in use.items() if n}
        times = 1 + min(int(left[k]) // n for k, n in use.items())
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            segments.append((length, rank[length], sequences, n, offset))
            rank[length] += times * n
            left[length] -= (times - 1) * n
            offset += n * length
        sequences += times
    return np.array(sorted(segments), np.int64).reshape(-1, 5), sequences


def _two(left: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum of at most ``room``."""
    lengths = np.flatnonzero(left[:room])
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, room - lengths, side="right") - 1
    other = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    # A length that is there once can't be its own partner: the next shorter one is.
    alone = (other == lengths) & (left[lengths] < 2)
    other = np.where(alone, np.where(at >= 1, lengths[np.maximum(at - 1, 0)], 0), other)
    total = np.where(other > 0, lengths + other, 0)
    best = int(total.argmax())
    return (int(lengths[best]), int(other[best])) if total[best] else None


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length from 1 to ``capacity``, and more).

    The driver sees one count per length, at most ``capacity`` of them, and plans on those; rows then
    find their place by their rank among rows of their length. Ranks are counted per (length, bucket) and
    added up over the buckets. A row's bucket comes from its position and is written with it, so that neither
    a very common length nor equal rows are a hot task. Equal rows are interchangeable. An empty table gives an
    empty result; input columns named sequence_id or offset are replaced, others may have any name.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    own = uuid.uuid4().hex
    bucket, ranking, before = f"bucket_{own}", f"rank_{own}", f"before_{own}"
    dealt = staged(pieces.withColumn(bucket, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shuffle_partitions(spark))).cast("int")))
    counts = {r[0]: r[1] for r in dealt.groupBy("length").count().collect()}
    segments, _ = plan(counts, capacity)
    key = segments[:, 0] << 48 | segments[:, 1]

    per = dealt.groupBy("length", bucket).agg(F.count("*").alias(ranking))
    earlier = per.select("length", bucket, (F.sum(ranking).over(Window.partitionBy("length").orderBy(bucket)) - F.col(ranking)).alias(before))
    ranked = (dealt.withColumn(ranking, F.row_number().over(Window.partitionBy("length", bucket).orderBy("doc_id", "piece")) - 1)
              .join(earlier, ["length", bucket]).withColumn(ranking, F.col(ranking) + F.col(before)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            length, rank = (batch.column(at(c)).to_numpy() for c in ("length", ranking))
            seg = segments[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            turn = rank - seg[:, 1]
            new = [pa.array(seg[:, 2] + turn // seg[:, 3]), pa.array(seg[:, 4] + turn % seg[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in names), *new], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*[f"`{c}`" for c in names], ranking).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and pack whole documents. Null texts count as empty (one token, the end mark);
    repeated rows are packed as often as they occur; other columns of ``docs`` are ignored."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
