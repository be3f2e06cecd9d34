import random

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
from helpers import AWKWARD, documents

from mdframes.llm.common import forest
from mdframes.llm.shingles import Marks, _keyed, _pairs, _tree_pairs, parities, shingle_groups, shingle_set


def plain(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return not a | b or len(a & b) >= 0.8 * len(a | b)


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"new{random.randrange(10 ** 6)}"
    return words


def texts():
    """Pairs of all similarities, a large group of near copies, and texts that share a passage alone."""
    random.seed(5)
    word = lambda: f"w{random.randrange(5000)}"
    out = []
    for _ in range(150):
        own = [word() for _ in range(random.randint(20, 200))]
        out += [" ".join(own), " ".join(edited(own, random.randint(0, len(own) // 30 + 1)))]
    own, passage = [word() for _ in range(120)], [word() for _ in range(40)]
    out += [" ".join(edited(own, random.randint(0, 2))) for _ in range(60)]
    out += [" ".join(passage + [word() for _ in range(random.randint(5, 40))]) for _ in range(60)]
    return [*out, *AWKWARD]


def groups(all_texts):
    sets = [plain(t) for t in all_texts]
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])
    return forest(pairs[:, 0], pairs[:, 1], len(sets)).tolist()


def test_groups_are_those_of_all_pairs(spark):
    all_texts = texts()
    rows = {r["doc_id"]: r["group"] for r in shingle_groups(documents(spark, all_texts).repartition(7)).collect()}
    want = groups(all_texts)
    assert 150 < len(set(want)) < len(want) - 100
    assert len(rows) == len(want) and len(set(rows.values())) == len(set(want)) == len(set(zip(rows.values(), (want[i] for i in rows))))
    assert shingle_groups(documents(spark, [])).count() == 0


def test_the_stage_finds_near_copies_of_five_words(spark):
    random.seed(2)
    own = [f"w{random.randrange(9000)}" for _ in range(150)]
    for changed, kept in ((range(40, 120, 40), 1), (range(10, 140, 10), 2)):
        other = [f"x{i}" if i in changed else w for i, w in enumerate(own)]
        pair = [" ".join(own), " ".join(other)]
        assert near(*map(plain, pair)) == (kept == 1)
        assert P.near_duplicates(spark, documents(spark, pair), "").count() == kept
    all_texts = texts()
    left = {r["doc_id"] for r in P.near_duplicates(spark, documents(spark, all_texts), "").collect()}
    assert left == set(groups(all_texts))


def test_the_stage_decides_by_text_and_not_by_id(spark):
    words = [f"w{i}" for i in range(200)]
    copied, other, alone = (" ".join(words[a:a + 60]) for a in (0, 70, 135))
    docs = documents(spark, [copied, copied, copied, other, alone, copied, None, None], [None, None, 7, 7, None, 9, None, None])
    kept = P.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in ((7, copied), (7, other), (None, alone), (None, None)))


def test_parities_bound_the_difference_and_leave_out_what_only_shares_a_passage(spark):
    random.seed(8)
    sets = [shingle_set(" ".join(f"w{random.randrange(400)}" for _ in range(n))) for n in (0, 3, 30, 70, 75, 600, 610, 4000, 20_000)]
    sets += [np.unique(np.concatenate([s[len(s) // 20:], sets[2]])) for s in sets]
    known = Marks(np.array([parities(s).tobytes() for s in sets], object))
    assert sorted(known.order) == list(range(len(sets)))
    sets = [sets[i] for i in known.order]
    for i, s in enumerate(sets):
        differing = known.differing(i, np.arange(len(sets)))
        assert all(d <= len(np.setxor1d(s, t)) for d, t in zip(differing, sets)) and differing[i] == 0
    schema = pa.schema([("shingle", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("root", pa.int64()), ("marks", pa.binary())])
    passage = [f"p{i}" for i in range(20)]
    texts = [" ".join(passage + [f"t{i}x{j}" for j in range(80)]) for i in range(100)]
    texts.append(texts[0] + " and more")
    sets = [shingle_set(t) for t in texts]
    n, keys = [len(s) for s in sets], list(range(len(sets)))
    rows = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(
        ([7] * len(keys), keys, n, [0] * len(keys), keys, [parities(s).tobytes() for s in sets]), schema)], schema=schema)
    pairs = [tuple(p.values()) for batch in _pairs(0)(iter([rows])) for p in batch.to_pylist()]
    assert pairs == [(0, 100)]


def test_trees_link_near_copies_before_the_rarest_shingles_do(spark):
    random.seed(3)
    own = [[f"w{random.randrange(9000)}" for _ in range(300)] for _ in range(30)]
    docs = documents(spark, [" ".join(w) for w in own] + [" ".join(w[:-1]) for w in own] + ["x y", "y x"])
    keyed = _keyed(docs, 5).cache()
    key = {r["doc_id"]: r["key"] for r in keyed.collect()}
    pairs = {tuple(r) for r in _tree_pairs(keyed.select("key", "fp")).collect()}
    found = sum(tuple(sorted((key[i], key[i + 30]))) in pairs for i in range(30))
    assert found >= 25 and all(a < b for a, b in pairs)
