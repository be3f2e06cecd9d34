"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
WIDEST = 16             # characters of the longest piece
CHARS = 1 << 20         # characters that are indexed at a time
CACHE = 500_000         # words at which a worker begins to remember anew
LONG = 64               # characters beyond which a word isn't kept
UNKNOWN = -2            # a character that no piece holds

_coders: dict[str, Coder] = {}


class Coder:
    """A byte-pair model read from a SentencePiece file (identity normalisation, byte fallback).

    No piece holds a space mark after another character, but for runs of marks, so a text's ids are those of
    its words, each with the mark before it, and of the extra marks where spaces repeat.
    """

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.output = [b""] * n
        for b, i in self.byte_id.items():
            self.output[i] = bytes([b])
        self.score = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.id_of = {model.id_to_piece(i): i for i in normal}
        for piece, i in self.id_of.items():
            self.output[i] = piece.replace(SPACE, " ").encode()
        pieces = [p for p in self.id_of if len(p) == 1 or p.strip(SPACE)]       # runs of marks are handled apart
        self.single = {p for p in pieces if len(p) == 1}
        # Pieces numbered in the order in which they are merged; single characters come first.
        pieces.sort(key=lambda p: (len(p) > 1, -self.score[p]))
        self.number = {p: k for k, p in enumerate(pieces)}
        self.ids = np.array([self.id_of[p] for p in pieces], "<u4")
        self.size = len(pieces)
        self.singles = len(self.single)
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        pairs, whole = {}, np.ones(self.size, bool)
        for k, p in enumerate(pieces):
            if len(p) > 1:
                last = self._merge(p)
                whole[k] = last is not None
                if last is not None:
                    self.left[k], self.right[k] = last
                for cut in range(1, len(p)):
                    a, b = self.number.get(p[:cut]), self.number.get(p[cut:])
                    if a is not None and b is not None:
                        pairs[a * self.size + b] = k
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[x] for x in sorted(pairs)], np.int64)
        chars = sorted(self.single)
        self.codes = {ord(c): i + 1 for i, c in enumerate(chars)}     # 0 ends a word
        self.none = len(chars) + 1                                    # a character no piece holds
        kept = [k for k in range(self.size) if whole[k]]
        self.kept = np.array(kept, np.int64)
        self.kept_size = np.array([len(pieces[k]) for k in kept], np.int64)
        low, high = np.zeros((len(kept), WIDEST), ">u2"), np.full((len(kept), WIDEST), 0xFFFF, ">u2")
        for row, k in enumerate(kept):
            codes = [self.codes[ord(c)] for c in pieces[k]]
            low[row, :len(codes)] = high[row, :len(codes)] = codes
        self.low, self.high = (x.view(f"S{2 * WIDEST}").ravel() for x in (low, high))
        self.known: dict[str, bytes] = {}
        self.checked, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def _merge(self, piece: str) -> tuple[int, int] | None:
        """The last merge that makes ``piece`` out of its characters; None if merging doesn't make it."""
        parts = list(piece)
        last = None
        while len(parts) > 1:
            scores = [(self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, i = max(scores)
            if best == -np.inf:
                return None
            last = parts[-i], parts[-i + 1]
            parts[-i:-i + 2] = [parts[-i] + parts[-i + 1]]
        return (self.number[last[0]], self.number[last[1]]) if last and all(x in self.number for x in last) else None

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces a and b side by side; each different pair is worked out once."""
        key, back = np.unique(a * self.size + b, return_inverse=True)
        at = np.searchsorted(self.checked, key)
        there = at < len(self.checked)
        there[there] = self.checked[at[there]] == key[there]
        if not there.all():
            new = key[~there]
            fits = self._side_by_side(new // self.size, new % self.size)
            every = np.concatenate([self.checked, new])
            order = np.argsort(every, kind="stable")
            self.checked, self.fits = every[order], np.concatenate([self.fits, fits])[order]
            at = np.searchsorted(self.checked, key)
        return self.fits[at][back]

    def _side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # Backwards in time: the piece merged last is taken apart again, and before each step it is seen whether
        # the two pieces at the border would have merged earlier than that. Ties go to the pair further left.
        fits = np.ones(len(a), bool)
        limit = np.full(len(a), self.size)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            cross = (self.pair[at] == key) & (self.merged[at] < limit[open_])
            fits[open_[cross]] = False
            ended = cross | ((x < self.singles) & (y < self.singles))
            open_, x, y = open_[~ended], x[~ended], y[~ended]
            later = x > y
            limit[open_] = np.where(later, x, y + 1)
            a[open_], b[open_] = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return fits

    def _match(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of every piece in ``row``: (start, length, piece)."""
        padded = np.concatenate([row, np.zeros(WIDEST, row.dtype)])
        n = len(row)
        # Suffixes sorted by their first 4, 8 and 16 characters: each rank pairs up two of the one before.
        wide = padded.astype(np.uint64)
        rank = wide[:n] << np.uint64(48) | wide[1:n + 1] << np.uint64(32) | wide[2:n + 2] << np.uint64(16) | wide[3:n + 3]
        order = np.argsort(rank)
        for step in (4, 8):
            ordered = rank[order]
            place = np.empty(n + WIDEST, np.uint64)
            place[n:] = 0
            place[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])).astype(np.uint64)
            rank = place[:n] << np.uint64(32) | place[step:n + step]
            order = np.argsort(rank)
        heads = np.lib.stride_tricks.sliding_window_view(padded, WIDEST)[order].astype(">u2")
        heads = np.ascontiguousarray(heads).view(f"S{2 * WIDEST}").ravel()
        first, last = np.searchsorted(heads, self.low), np.searchsorted(heads, self.high, side="right")
        times = last - first
        hit = np.flatnonzero(times > 0)
        times, first = times[hit], first[hit]
        ends = np.cumsum(times)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(first, times)
        return order[at], np.repeat(self.kept_size[hit], times), np.repeat(self.kept[hit], times)

    def _learn(self, words: list[str]) -> None:
        """The ids of ``words``, each with a space mark before it."""
        text = "".join(SPACE + w + "\0" for w in words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        different, back = np.unique(points, return_inverse=True)
        row = np.array([self.codes.get(int(c), self.none) for c in different], np.uint16)[back]
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        row[begin + sizes] = 0      # a NUL in a word is a character like others; the end mark isn't
        start, size, piece = self._match(row)
        strange = np.flatnonzero(row == self.none)
        start = np.concatenate([start, strange])
        size = np.concatenate([size, np.ones(len(strange), np.int64)])
        piece = np.concatenate([piece, np.full(len(strange), UNKNOWN)])
        # Edges by the place in their word where they end, all words in step.
        first = np.repeat(begin, sizes + 1)
        ends = start + size - first[start]
        order = np.argsort(ends.astype(np.uint16), kind="stable") if len(ends) and ends.max() < 1 << 16 else np.argsort(ends, kind="stable")
        start, size, piece, ends = start[order], size[order], piece[order], ends[order]
        last = np.full(len(row) + 1, -1)        # the piece that ends before a place, in the ids of all up to it
        came = np.zeros(len(row) + 1, np.int64)
        steps = np.flatnonzero(np.diff(ends, prepend=-1))
        for a, b in zip(steps, [*steps[1:], len(ends)]):
            s, t = start[a:b], piece[a:b]
            head = s == first[s]
            before = last[s]
            good = head | (before == UNKNOWN) | ((before >= 0) & (t == UNKNOWN))
            ask = np.flatnonzero(~good & (before >= 0))
            good[ask] = self._compatible(before[ask], t[ask])
            s, t = s[good], t[good]
            to = s + size[a:b][good]
            last[to], came[to] = t, s
        # Back from the ends of the words, again in step.
        at, word = begin + sizes, np.arange(len(words))
        chain: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            chain.append((word, last[at], came[at]))
            at = came[at]
            more = at > begin[word]
            word, at = word[more], at[more]
        word, piece, place = (np.concatenate(x[::-1]) for x in zip(*chain)) if chain else (np.zeros(0, np.int64),) * 3
        order = np.argsort(word, kind="stable")
        word, piece, place = word[order], piece[order], place[order]
        data = self.ids[np.maximum(piece, 0)].tobytes()
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        odd = set(word[piece == UNKNOWN].tolist())
        for w, (name, a, b) in enumerate(zip(words, cuts[:-1].tolist(), cuts[1:].tolist())):
            if w not in odd:
                self.known[name] = data[4 * a:4 * b]
            else:
                whole = SPACE + name
                self.known[name] = b"".join(
                    self._bytes(whole[int(place[i] - begin[w])]) if piece[i] == UNKNOWN else data[4 * i:4 * i + 4] for i in range(a, b))

    def _bytes(self, char: str) -> bytes:
        return np.array([self.byte_id[b] for b in char.encode()], "<u4").tobytes()

    def _marks(self, n: int) -> bytes:
        """The ids of ``n`` space marks in a row: merged like any text, the leftmost pair first among equals."""
        after, alive, size = list(range(1, n + 1)), [True] * n, [1] * n
        before = list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self.score.get(SPACE * (size[i] + size[j]))) is not None:
                heapq.heappush(heap, (-s, i, size[i], size[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (size[i], size[j]) != (a, b):
                continue
            size[i] += size[j]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([self.id_of[SPACE * size[i]] for i in range(n) if alive[i]], "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        bare = self.ids[self.number[SPACE]].tobytes()
        for a in range(0, len(texts), 500):
            split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts[a:a + 500]]
            if len(self.known) > CACHE:
                self.known = {}
            found = [list(map(self.known.get, words)) for words in split]
            new = {w for words, ids in zip(split, found) if None in ids for w, i in zip(words, ids) if i is None}
            new.discard("")
            group, size = [], 0
            for w in new:
                group.append(w)
                size += len(w) + 2
                if size > CHARS:
                    self._learn(group)
                    group, size = [], 0
            if group:
                self._learn(group)
            get = self.known.__getitem__
            for words, ids in zip(split, found):
                if None not in ids:
                    yield b"".join(ids)
                    continue
                if "" not in words:
                    yield b"".join(map(get, words))
                    continue
                out, extra = [], 0
                for w in words:
                    if not w:
                        extra += 1
                        continue
                    ids = get(w)
                    if extra and ids[:4] == bare:       # the word's own mark stands alone and joins the run
                        ids, extra = ids[4:], extra + 1
                    out += [self._marks(extra) if extra else b"", ids]
                    extra = 0
                yield b"".join(out) + (self._marks(extra) if extra else b"")
            for w in new:
                if len(w) > LONG:
                    self.known.pop(w, None)

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes of pieces in a row, without the space put before the first word."""
        out = b"".join(map(self.output.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out[1:].decode("utf-8", "replace") if out[:1] == b" " else out.decode("utf-8", "replace")


def coder(path: str) -> Coder:
    """One coder per worker process."""
    return _coders.get(path) or _coders.setdefault(path, Coder(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs``: doc_id and ids (array<int>) of the whole text. Null and empty texts have none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder(model).encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [coder(model).decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pieces, ids_crc32 (unsigned, of little-endian 32-bit ids), decoded_crc32 (of the
    decoded text's UTF-8) and round_trip, whether decoding gave the text back. A null text counts as empty;
    a text with the mark itself (U+2581) comes back with spaces in its place, and so does not round-trip."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for text, ids in zip(texts, c.encode(texts)):
                back = c.decode(ids)
                out.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode("utf-8", "replace")), back == text))
            n, a, b, same = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.bool_())],
                                             names=["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
