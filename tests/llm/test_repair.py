"""Repairs against a plain search over all edits."""

import hashlib
import itertools
import random
import zlib
from functools import cache

import numpy as np

from mdframes.llm import repair as R
from mdframes.llm.repair import END, GONE, STATES, closing, repair, repair_digest, tables

SCHEMA = "conv_id long, turn long, role string, text string, id long, fault int, part string, kind string, h1 long"
WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, must go, truncated): every edit is tried."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, q, inserted):
        found = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        for name in ("user", "assistant"):
            if (q, name[0]) in step and inserted < 3:
                c, a, t = best(i, name[0], inserted + 1)
                found.append((c + 3, "I" + a, (f"{name}:", *t)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, t = best(i + 1, q, 0)
            found.append((c + 4, "D" + a, t))
            if not gone:
                if (q, role[:1]) in step:
                    c, a, t = best(i + 1, role[:1], 0)
                    found.append((c + 3 * cut, "K" + a, (f"{role}:{text}", *t)))
                for name in ("user", "assistant"):
                    if (q, name[0]) in step:
                        c, a, t = best(i + 1, name[0], 0)
                        found.append((c + 3 + 3 * cut, "R" + a, (f"{name}:{text}", *t)))
        return min(found, key=lambda x: x[:2], default=(10 ** 9, "", ()))

    for i in range(len(rows), 0, -1):       # from the end, to keep the recursion flat
        for q in ("", "s", "u", "a"):
            best(i, q, 0)
    return best(0, "", 0)


def plain(conv, rows):
    """The figures of one conversation; rows (turn, role, text) in order."""
    seen, marked, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(WS)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        marked.append((role, text, fault in (0, 1), fault == 2))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest(tuple(marked))
    text = "\n".join(lines)
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)


def order(r):
    return (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())


def by_conversation(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    return {c: sorted(x, key=order) for c, x in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], SCHEMA)


def conversations(seed, n, most):
    random.seed(seed)
    out = []
    for c in range(n):
        for t in range(random.randint(1, most)):
            role = random.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "übel", None, "agent", "usher"])
            text = random.choice(["Yes.", "No!", "Why?", "cut", "", " \n", None, f"text {random.random()}.", f"text {random.random()}", "end. ", "🙂. \t"])
            out.append((c if c else None, random.choice([t, t, t, t + 5, None, -t]), role, text))
    return out


def check(spark, rows):
    got = sorted((tuple(r) for r in repair(frame(spark, rows), texts=True).collect()), key=repr)
    assert got == sorted((plain(c, x) for c, x in by_conversation(rows).items()), key=repr)


def test_against_all_edits(spark):
    check(spark, conversations(1, 150, 9))


def test_parts_of_long_conversations(spark, monkeypatch):
    long = [(5, t, random.choice(["user", "assistant", "system"]), f"{t}{random.choice('.!?x')}") for t in range(300)]
    check(spark, [*conversations(2, 20, 6), *long])


def test_blocks_and_parts_agree():
    """Rows cut into parts anywhere give the edits of the whole."""
    t, rng = tables(), np.random.default_rng(4)
    for n in range(0, 14):
        symbols = rng.integers(0, GONE + 1, n)
        whole, state = t.trace(symbols, 0, 0)
        for a in range(n + 1):
            head, q = t.trace(symbols[:a], int(t.before(symbols[a:])[0]), 0)
            tail, q = t.trace(symbols[a:], 0, q)
            assert (head + tail, q) == (whole, state)


def test_every_short_sequence():
    t = tables()
    roles = ["s", "u", "a", "x"]
    for n in range(4):
        for symbols in itertools.product(range(GONE + 1), repeat=n):
            rows = tuple((roles[min(y // 2, 3)], "t", y == GONE, y != GONE and y % 2) for y in symbols)
            audit, q = t.trace(np.array(symbols, np.int64), 0, 0)
            assert audit + closing(q) == cheapest(rows)[1]


def test_costs_behind_the_last_row():
    assert [3 * len(closing(q)) for q in range(STATES)] == list(END)


def test_damage_and_digest(spark):
    rows = [(c, t, role, f"{c} said {t}. Yes!") for c in range(200) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2:])]
    rows += [(None, None, None, None), (900, None, "user", "x."), (901, 3, None, "y.")]
    rows += [(c, 0, "user", "alone.") for c in range(1000, 1060)]
    want, ids = [], {r[0] for r in rows}
    left = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if k == 4:
            role = "user"
        left += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    kept = by_conversation(left)
    for c in ids:
        want.append(plain(c, kept.get(c, []))[:-1])
    got = [tuple(r) for r in repair_digest(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_copies(spark):
    assert repair(frame(spark, [])).collect() == [] and repair_digest(frame(spark, [])).collect() == []
    check(spark, [(1, 0, "user", "same.")] * 60 + [(2, 0, "user", "a.")])


def test_parts_within_a_task(monkeypatch):
    """A conversation of more rows than are held together is cut, and finished by the streaming step."""
    import pyarrow as pa
    monkeypatch.setattr(R, "PART", 7)
    monkeypatch.setattr(R, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    rows = [{"conv_id": c, "turn": t, "role": "user" if t % 3 else "system", "text": b"x.", "fault": t % 4} for c, n in ((1, 3), (2, 30), (3, 7), (4, 2)) for t in range(n)]
    out = [r for b in R._solved(False)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    parts = [(r["conv_id"], r["part"]) for r in out if r["kind"] == 2]
    assert parts == [(1, 0), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4), (4, 0)]
    assert [r["conv_id"] for r in out if r["kind"] == 0] == [3]
    assert sum(r["kind"] == 1 for r in out) == 3 + 30 + 2
