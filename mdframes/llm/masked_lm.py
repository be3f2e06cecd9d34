"""Masked pseudo-likelihood: every token predicted from the words on both sides of it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import gather, staged, table

CLASSES = 22                        # a token is three digits: its class, its group within the class, its place within the group
IN_CLASS = CLASSES * CLASSES
TOKENS = CLASSES * IN_CLASS         # frequent words, pieces of all others, then single bytes
WORDS = 3600                        # frequent words, at most
RARE = 512                          # bytes at the start of a word, and bytes inside one
PIECE = 4                           # characters of a piece, at most
PAD = TOKENS                        # beyond a document's ends
OFFSETS = (-2, -1, 1, 2)
DIM, HIDDEN = 16, 32
BATCH = 4096
SHARED = 4                          # step size of the layers that all tokens share, beside that of a word's embedding
LONGEST = 40                        # characters of a word that may enter the vocabulary
HELD = 300_000                      # different words a task counts before it passes them on
SLICE = 4096                        # numbers of a model that travel in one row
CHUNK = 8 << 20                     # bytes of text that are split at once
TEXTS = 500                         # documents whose tokens are shuffled together in training, or scored at once


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _split(texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Chunks of the texts as their distinct words, lower-cased (some may then be equal), the words of all texts as places
    among these, and how many words each text has. Null texts have none."""
    texts = texts.fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, side="right")))
        split = pc.utf8_split_whitespace(texts.slice(a, b - a))
        found = split.flatten()
        # Blanks at the ends of a text split off empty words.
        full = pc.not_equal(found, "").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(b - a), pc.list_value_length(split).to_numpy())[full]
        coded = found.filter(pa.array(full)).dictionary_encode()
        yield [w.lower() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(), np.bincount(owner, minlength=b - a)
        a = b


def all_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all texts, counted within each chunk before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, at, _ in _split(batch.column(0)):
                yield table("word string, n long", {"word": found, "n": np.bincount(at, minlength=len(found))})

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``all_counts`` of the words that may enter the vocabulary."""
    return all_counts(docs).where(F.length("word") <= LONGEST)


class Speller:
    """The tokens of each word: its own, or else the longest pieces it starts with, one after the other, with single
    UTF-8 bytes where no piece fits. A piece inside a word is in the vocabulary behind a blank, which no word holds."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        # Pieces as numbers of PIECE characters with 16 bits each; a character is its place in the alphabet of all pieces.
        short = [(w, i) for w, i in vocabulary.items() if 0 < len(w.lstrip(" ")) <= PIECE]
        self.alphabet = np.unique(np.concatenate([_points(w.lstrip(" ")) for w, _ in short] or [np.zeros(0, np.uint32)]))
        self.tables = []
        for inside in (False, True):
            own = [(w.lstrip(" "), i) for w, i in short if w.startswith(" ") == inside]
            for n in range(1, PIECE + 1):
                part = [(w, i) for w, i in own if len(w) == n]
                keys = self._keys(self._letters(_points("".join(w for w, _ in part))).reshape(-1, n), n)
                order = np.argsort(keys)
                self.tables.append((np.append(keys, ~np.uint64(0))[np.append(order, len(part))], np.array([i for _, i in part], np.int64)[order]))

    def __reduce__(self):
        return Speller, (self.vocabulary,)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """Places in the alphabet, from 1; 0 for characters of no piece."""
        if not len(self.alphabet):
            return np.zeros(len(points), np.uint64)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.uint64)

    @staticmethod
    def _keys(letters: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(letters), np.uint64)
        for k in range(n):
            out = out << np.uint64(16) | letters[:, k]
        return out

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one word after the other, and how many each word has. Words are spelt side by side, a
        piece of each at a time."""
        found = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(found < 0)
        points = _points("".join([words[i] for i in rest]))
        size = np.fromiter((len(words[i]) for i in rest), np.int64, len(rest))
        ends = np.cumsum(size)
        letters = np.append(self._letters(points), np.zeros(PIECE, np.uint64))
        at, live, first = ends - size, np.flatnonzero(size), True
        owners, tokens, turns, turn = [np.flatnonzero(found >= 0)], [found[found >= 0]], [np.zeros(int((found >= 0).sum()), np.int64)], 0
        while len(live):
            here = at[live]
            token, step = np.full(len(live), -1), np.ones(len(live), np.int64)
            for n in range(PIECE, 0, -1):
                keys, ids = self.tables[(0 if first else PIECE) + n - 1]
                open_ = np.flatnonzero((token < 0) & (here + n <= ends[live]))
                window = letters[here[open_, None] + np.arange(n)]
                key = self._keys(window, n)
                place = np.searchsorted(keys[:-1], key)
                hit = (keys[place] == key) & (window > 0).all(axis=1)
                token[open_[hit]] = ids[place[hit]]
                step[open_[hit]] = n
            plain = np.flatnonzero(token < 0)
            raw = [chr(c).encode("utf-8", "replace") for c in points[here[plain]].tolist()]
            for k in range(4):      # the bytes of a character that no piece holds
                more = [b[k] if len(b) > k else -1 for b in raw]
                byte = np.array(more, np.int64)
                has = byte >= 0
                owners.append(rest[live[plain[has]]])
                tokens.append(TOKENS - RARE + byte[has] + 256 * int(k > 0 or not first))
                turns.append(np.full(int(has.sum()), turn + k))
            good = token >= 0
            owners.append(rest[live[good]])
            tokens.append(token[good])
            turns.append(np.full(int(good.sum()), turn))
            turn, first = turn + 4, False
            at[live] += step
            live = live[at[live] < ends[live]]
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.lexsort((np.concatenate(turns), owner))
        return token[order].astype(np.uint16), np.bincount(owner, minlength=len(words))


def _points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(counts: DataFrame, whole: set[str], most: int) -> list[tuple[str, int]]:
    """The pieces of 2 to ``PIECE`` characters that spell most of the words beside the ``whole`` ones, with their counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        flush = lambda: table("piece string, n long", {"piece": list(seen), "n": list(seen.values())})
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word in whole:
                    continue
                for size in range(2, PIECE + 1):
                    for at in range(len(word) - size + 1):
                        seen[" " * (at > 0) + word[at:at + size]] += n
                if len(seen) > HELD:
                    yield flush()
                    seen = Counter()
        yield flush()

    found = counts.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    saved = F.col("n") * (F.length(F.ltrim("piece")) - 1)
    return [(r[0], r[1]) for r in found.orderBy(saved.desc(), "piece").limit(most).collect()]


def _frequencies(counts: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """How often each token stands in all texts."""
    held = counts.sparkSession.sparkContext.broadcast(Speller(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros(TOKENS)
        for batch in batches:
            ids, sizes = held.value.spell(batch.column(0).to_pylist())
            summed += np.bincount(ids, np.repeat(batch.column(1).to_numpy(), sizes), TOKENS)
        yield table("token int, n double", {"token": range(TOKENS), "n": summed})

    out = np.zeros(TOKENS)
    for token, n in counts.mapInArrow(count, "token int, n double").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


@dataclass
class Network:
    """Embeddings of the words around a position, one hidden layer, and a softmax over each of the three digits of the
    token, given the digits before it. Digits share their output matrix; the digits before pick gates on the
    hidden layer and biases (``second`` and ``third``: a row of gates, then biases, for each class and each group)."""

    vocabulary: dict[str, int]
    parts: dict[str, np.ndarray] = field(default_factory=dict)
    speller: Speller | None = None

    def __post_init__(self):
        self.speller = self.speller or Speller(self.vocabulary)

    def ids(self, text: str | None) -> list[int]:
        return self.speller.spell(words(text))[0].tolist()

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def load(self, vector: np.ndarray) -> Network:
        parts, at = {}, 0
        for name, v in self.parts.items():
            parts[name] = vector[at:at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return Network(self.vocabulary, parts, self.speller)


def _start(counts: list[tuple[str, int]], total: int, seed: int, tokens: np.ndarray | None = None) -> Network:
    """Small random weights; the biases hold the frequencies of the tokens, or else those of ``counts`` with the rest
    of ``total`` spread over the bytes."""
    rng = np.random.default_rng(seed)
    vocabulary = {w: i for i, (w, _) in enumerate(counts)}
    freq = np.full(TOKENS, 0.5)
    if tokens is not None:
        freq += tokens
    else:
        freq[:len(counts)] += [n for _, n in counts]
        freq[TOKENS - RARE:] += max(0, total - sum(n for _, n in counts)) / RARE
    digits = freq.reshape(CLASSES, CLASSES, CLASSES)
    groups = digits.sum(axis=2)
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True)).astype(np.float32)
    gated = lambda x: np.hstack([np.ones((len(x), HIDDEN), np.float32), x])
    normal = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return Network(vocabulary, {
        "embed": normal(TOKENS + 1, DIM), "mix": normal(len(OFFSETS) * DIM, HIDDEN), "shift": np.zeros(HIDDEN, np.float32),
        "to_class": normal(HIDDEN, CLASSES), "class_bias": share(groups.sum(axis=1)),
        "to_group": normal(HIDDEN, CLASSES), "second": gated(share(groups)),
        "to_place": normal(HIDDEN, CLASSES), "third": gated(share(digits).reshape(IN_CLASS, CLASSES))})


def _windows(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with padding between texts, and the places of the tokens that are predicted."""
    edge = max(OFFSETS)
    places = np.arange(len(ids)) + edge * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    row = np.full(len(ids) + edge * (len(sizes) + 1), PAD, np.uint16)
    row[places] = ids
    return row, places


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z - c) of every row in place of ``z``, and c; one c for all rows where that is safe."""
    top = z.max(initial=-np.inf)
    c = top if top - z.min(initial=np.inf) < 60 else z.max(axis=1, keepdims=True)
    z -= c
    return np.exp(z, out=z), c


def _softmax(z: np.ndarray) -> np.ndarray:
    e, _ = _exp(z)
    e /= (e @ np.ones(e.shape[1], e.dtype))[:, None]
    return e


def _log_chosen(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log-softmax of one column of each row."""
    own = z[np.arange(len(z)), chosen].astype(np.float64)
    e, c = _exp(z)
    return own - np.log(e @ np.ones(e.shape[1], e.dtype)) - np.ravel(c)


def _forward(p: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """The embeddings around each position, the hidden layer as each of the three digits sees it, the gates of the last two, and the scores of all three."""
    x = p["embed"].take(around, axis=0).reshape(len(target), -1)
    h = x @ p["mix"]
    h += p["shift"]
    np.tanh(h, out=h)
    second, third = p["second"].take(target // IN_CLASS, axis=0), p["third"].take(target // CLASSES, axis=0)
    gate2, gate3 = second[:, :HIDDEN], third[:, :HIDDEN]
    h2, h3 = h * gate2, h * gate3
    z1, z2, z3 = h @ p["to_class"], h2 @ p["to_group"], h3 @ p["to_place"]
    z1 += p["class_bias"]
    z2 += second[:, HIDDEN:]
    z3 += third[:, HIDDEN:]
    return x, h, h2, h3, gate2, gate3, z1, z2, z3


def log_probabilities(net: Network, row: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The conditional log-probability of each token given both sides."""
    out, offsets = np.empty(len(places), np.float64), np.array(OFFSETS)
    for a in range(0, len(places), BATCH):
        at = places[a:a + BATCH]
        target = row[at].astype(np.int64)
        *_, z1, z2, z3 = _forward(net.parts, row[at[:, None] + offsets], target)
        out[a:a + BATCH] = (_log_chosen(z1, target // IN_CLASS) + _log_chosen(z2, target // CLASSES % CLASSES)
                            + _log_chosen(z3, target % CLASSES))
    return out


def _sums(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of sorted ``keys``, the summed rows of each and how many they are."""
    cuts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    return keys[cuts], np.add.reduceat(values, cuts), np.diff(np.append(cuts, len(keys))).astype(np.float32)


def _descend(net: Network, row: np.ndarray, places: np.ndarray, rate: float, rng: np.random.Generator) -> None:
    """One pass of stochastic gradient descent over the tokens at ``places``."""
    p, offsets = net.parts, np.array(OFFSETS)
    places = rng.permutation(places)
    for a in range(0, len(places), BATCH):
        at = places[a:a + BATCH]
        at = at[np.argsort(row[at], kind="stable")]         # positions of a class and a group lie together
        n, every = np.float32(len(at)), np.arange(len(at))
        target = row[at].astype(np.int64)
        around = row[at[:, None] + offsets]
        x, h, h2, h3, gate2, gate3, z1, z2, z3 = _forward(p, around, target)
        g1, g2, g3 = _softmax(z1), _softmax(z2), _softmax(z3)
        g1[every, target // IN_CLASS] -= 1
        g2[every, target // CLASSES % CLASSES] -= 1
        g3[every, target % CLASSES] -= 1
        back2, back3 = g2 @ p["to_group"].T, g3 @ p["to_place"].T
        back = g1 @ p["to_class"].T
        gate2 *= back2
        gate3 *= back3
        back += gate2
        back += gate3
        back *= 1 - h * h
        back2 *= h
        back3 *= h
        ones = np.ones(len(at), np.float32)
        steps = {"to_class": h.T @ g1, "class_bias": ones @ g1, "to_group": h2.T @ g2, "to_place": h3.T @ g3, "mix": x.T @ back, "shift": ones @ back}
        spread = (back @ p["mix"].T).reshape(-1, DIM)
        words = around.ravel()
        order = np.argsort(words, kind="stable")
        # Steps of a word, a class or a group are averaged over the root of its uses, so that rare ones learn as fast as frequent ones.
        for name, values, keys in (("second", np.hstack([back2, g2]), target // IN_CLASS), ("third", np.hstack([back3, g3]), target // CLASSES),
                                   ("embed", spread.take(order, axis=0), words.take(order))):
            used, summed, uses = _sums(values, keys)
            p[name][used] -= rate * summed / np.sqrt(uses * n)[:, None]
        for name, step in steps.items():
            p[name] -= SHARED * rate * step / n


def _slot() -> Column:
    """Rows that repeat a text are spread by their ids."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))


def part(k: int, share: float, slot: Column | None = None) -> Column:
    """Whether a row belongs to slice ``k``."""
    return F.floor((_slot() if slot is None else slot) / F.lit((1 << 20) * share)) == k


def start(docs: DataFrame, seed: int = 3) -> Network:
    """Count the words of the whole corpus; the frequent ones are tokens, all others are spelt with pieces and bytes."""
    counts = staged(all_counts(docs))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = [(r[0], r[1]) for r in counts.where(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    whole = {w for w, _ in top}
    room = TOKENS - RARE - len(top)
    top += [(x, n) for x, n in _pieces(counts, whole, room + len(top)) if x not in whole][:room]
    return _start(top, total, seed, _frequencies(counts, {w: i for i, (w, _) in enumerate(top)}))


def tokenized(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of ``docs``: doc_id, slot (see ``part``) and ids, the tokens of its whole text as unsigned 16-bit numbers; a null
    text has none."""
    held = docs.sparkSession.sparkContext.broadcast(net.speller)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = held.value
        for batch in batches:
            a = 0
            for found, at, words_of in _split(batch.column(2)):
                flat, size = speller.spell(found)
                ids, ends = gather(flat, np.cumsum(size) - size, size, at)
                cuts = np.append(0, ends)[np.append(0, np.cumsum(words_of))].tolist()
                part = batch.slice(a, len(words_of))
                a += len(words_of)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
                                                 names=["doc_id", "slot", "ids"])

    return docs.select("doc_id", _slot().alias("slot"), "text").mapInArrow(spell, f"doc_id {kind}, slot long, ids binary")


def _read(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Small batches, the tokens of their rows and how many each row has."""
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS):
            part = batch.slice(a, TEXTS)
            ids = part.column(column)
            yield part, np.frombuffer(b"".join(ids.to_pylist()), np.uint16), pc.binary_length(ids).to_numpy().astype(np.int64) // 2


def train(tokens: DataFrame, net: Network, share: float = 1 / 2, rounds: int = 2, rate: float = 0.5, seed: int = 3) -> Network:
    """Train on ``tokenized`` documents in ``rounds`` rounds.

    In each round every task starts from the same network, descends over its part of another ``share`` of the documents (by hash; with
    ``share * rounds`` of 1, the default, every document is trained on once) and returns its network in
    slices; slices are averaged by Spark, weighted by tokens, in two steps so that no task
    holds more than a part of them. The driver gets one network.
    """
    for k in range(rounds):
        held = tokens.sparkSession.sparkContext.broadcast(net)       # of fixed size

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value.load(held.value.vector())
            rng, seen = np.random.default_rng(seed + k), 0
            for _, ids, sizes in _read(batches, 0):
                row, places = _windows(ids, sizes)
                seen += len(places)
                _descend(own, row, places, rate / (k + 1), rng)
            if seen:
                v = own.vector()
                cuts = [v[i:i + SLICE] for i in range(0, len(v), SLICE)]
                yield table("slice int, tokens long, numbers array<float>",
                            {"slice": range(len(cuts)), "tokens": [seen] * len(cuts), "numbers": cuts})

        def average(batch: pa.Table) -> pa.Table:
            tokens = batch.column("tokens").to_numpy()
            numbers = batch.column("numbers").combine_chunks()
            mean = tokens @ numbers.flatten().to_numpy().reshape(len(tokens), -1) / tokens.sum()
            return pa.Table.from_batches([table("slice int, tokens long, numbers array<float>", {
                "slice": [batch.column("slice")[0].as_py()], "tokens": [tokens.sum()], "numbers": [mean.astype(np.float32)]})])

        kind = "slice int, tokens long, numbers array<float>"
        slices = tokens.where(part(k, share, F.col("slot"))).select("ids").mapInArrow(descend, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        slices = slices.groupBy("slice", "part").applyInArrow(average, kind).groupBy("slice").applyInArrow(average, kind)
        got = {r["slice"]: r["numbers"] for r in slices.collect()}
        if got:
            net = net.load(np.concatenate([np.asarray(got[i], np.float32) for i in sorted(got)]))
    return net


def fit(docs: DataFrame, share: float = 1 / 2, rounds: int = 2, rate: float = 0.5, seed: int = 3) -> Network:
    """A network trained on the documents (see ``start`` and ``train``)."""
    net = start(docs, seed)
    return train(staged(tokenized(docs, net)), net, share, rounds, rate, seed)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, log_likelihood (summed over every token of the whole text)
    and per_token, its mean. Null and empty texts have no tokens, a sum of 0 and a null mean."""
    return score_tokens(tokenized(docs, net), net)


def score_tokens(tokens: DataFrame, net: Network) -> DataFrame:
    """``score`` of ``tokenized`` documents."""
    held = tokens.sparkSession.sparkContext.broadcast(net)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, sizes in _read(batches, 1):
            row, places = _windows(ids, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            summed = np.bincount(owner, log_probabilities(held.value, row, places), len(sizes)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(summed)], names=["doc_id", "n_tokens", "log_likelihood"])

    found = tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double")
    return found.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on the documents and score all of them; their texts are spelt once."""
    net = start(docs)
    tokens = staged(tokenized(docs, net))
    return score_tokens(tokens, train(tokens, net))
