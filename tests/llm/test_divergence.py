"""Divergence of sources against a plain evaluation over dense tables."""

import random
import re
from collections import Counter, defaultdict

from helpers import AWKWARD

from mdframes.llm import divergence as D
from mdframes.llm.divergence import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, g string, term string, value string, h1 long, rank int"


def plain(rows, least=3, top=200):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [((g or ""), (s or ""), Counter(TERM.findall((t or "").translate(lower)))) for t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, count = Counter(), defaultdict(Counter)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        for g, s, c in docs:
            if g == lang:
                df.update(c.keys())
                count[s].update(c)
        kept = [t for t in df if df[t] >= least]
        total = {s: sum(count[s][t] for t in kept) for s in sources}
        p = lambda s, t: 1 + 10 ** 9 * (count[s][t] + 1) // (total[s] + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        q = {t: 1 + 10 ** 9 * (sum(count[s][t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            parts = {"pair": [(-sum(f(p(s, t), p(o, t)) for t in kept), o.encode(), o) for o in sources if o != s],
                     "term": [(-f(p(s, t), q[t]), t.encode(), t) for t in kept if count[s][t] and p(s, t) > q[t]]}
            for part, found in parts.items():
                for k, (value, _, item) in enumerate(sorted(found)):
                    if part == "pair" or k < top:
                        out.append((lang, s, part, item, -value, k + 1))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y", "z", 1, 2) for i, r in enumerate(rows)], SCHEMA)


def rows():
    random.seed(2)
    words = [f"w{'abcdefghij'[i % 10]}{'é' * (i % 3)}{'KLMNOP'[i % 6] * (i // 60)}" for i in range(300)]
    out = []
    for i in range(250):
        lang = random.choice(["en", "de", None, "one"])
        source = "only" if lang == "one" else random.choice(["a", "b", "B", "é", None, "c"])
        out.append((" ".join(random.choices(words, k=random.randint(0, 60))), lang, source))
    out += [random.choice(out) for _ in range(60)] + [out[3]] * 150         # copies, a third of all rows
    return out + [(x, "en", "awkward") for x in AWKWARD] + [("", "void", "a"), (None, "void", "b"), ("x", "void", "b")]


def test_against_a_plain_version(spark):
    r = rows()
    assert sorted(tuple(x) for x in divergence(frame(spark, r)).collect()) == plain(r)


def test_small_blocks_and_limits(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 20)
    monkeypatch.setattr(D, "PAIRS", 8)
    r = rows()[:120]
    assert sorted(tuple(x) for x in divergence(frame(spark, r), least=2, top=5).collect()) == plain(r, 2, 5)


def test_empty_table(spark):
    assert divergence(frame(spark, [])).collect() == []
