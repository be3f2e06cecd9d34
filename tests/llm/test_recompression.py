"""Removal of repeated windows against a plain search, and the reach of symbols against every context."""

import hashlib
import random

import numpy as np
from helpers import AWKWARD, documents

from mdframes.llm.recompression import parse, repeats_digest, rounds_for, without_repeats, word_names


def plain(rows, length):
    """The contract, literally: rows of (doc_id, text) -> (doc_id, n_words, n_removed, kept)."""
    order = lambda i: (i is None, i or 0)
    words = [(t or "").replace("\x0b", " ").replace("\x0c", " ").translate({9: 32, 10: 32, 13: 32}).split(" ") for _, t in rows]
    words = [[w for w in x if w] for x in words]
    first = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - length + 1):
            key = tuple(w[a:a + length])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - length + 1):
            if first[tuple(w[a:a + length])] < order(i):
                gone.update(range(a, a + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def texts(seed=3):
    random.seed(seed)
    word = lambda: f"w{min(int(random.expovariate(0.01)), 4000)}"
    passages = [[word() for _ in range(random.randint(40, 140))] for _ in range(8)]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(random.randint(1, 4)):
            parts += random.choice([[word() for _ in range(random.randint(0, 80))], random.choice(passages),
                                    random.choice(passages)[random.randint(0, 30):], ["same"] * random.randint(1, 130),
                                    ["a", "b"] * random.randint(1, 60)])
        out.append(random.choice([" ", "\n", " \t "]).join(parts))
    own = [word() for _ in range(400)]
    for _ in range(60):
        copy = list(own)
        for _ in range(random.randint(0, 3)):
            copy[random.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out


def check(spark, rows, length):
    got = without_repeats(documents(spark, [t for _, t in rows], [i for i, _ in rows]), length).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(rows, length)


def test_windows_of_fifty_words(spark):
    t = texts()
    check(spark, list(enumerate(t)), 50)


def test_other_lengths(spark):
    t = [" ".join(x.split()[:150]) for x in texts(4)[:80]]
    for length in (1, 7, 20):
        check(spark, list(enumerate(t)), length)


def test_awkward_rows_repeated_and_missing_ids(spark):
    t = texts(5)[:40]
    rows = [(k, x) for k, x in enumerate(AWKWARD)] + [(None, x) for x in t[:10]] * 2 + [(7, x) for x in t[5:20]] + [(-3, t[6]), (2 ** 40, t[7])]
    check(spark, rows, 50)


def test_a_third_are_copies(spark):
    t = texts(6)[:40]
    check(spark, list(enumerate(t + [t[3]] * 20 + ["long " * 300] * 3)), 50)


def test_empty_table_and_digest(spark):
    assert without_repeats(documents(spark, [])).collect() == []
    one = repeats_digest(documents(spark, ["a  b", None])).orderBy("doc_id").collect()
    assert [tuple(r) for r in one] == [(0, 2, 0, hashlib.sha256(b"a b").hexdigest()), (1, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_a_symbol_is_the_same_wherever_its_reach_stands():
    rng = np.random.default_rng(1)
    inner = " ".join(f"w{i}" for i in rng.integers(0, 30, 50))
    held = []
    for k in range(30):
        edge = [" ".join(f"w{i}" for i in rng.integers(0, 30, 20)) for _ in range(2)]
        names = word_names(f"{edge[0]} {inner} {edge[1]}".encode())
        name, _, left, right = parse(names, np.zeros(len(names), int), rounds_for(50))
        held.append({(int(n), int(a), int(b)) for n, a, b in zip(name, left, right) if a >= 20 and b <= 70})
    assert all(h == held[0] for h in held) and held[0]
