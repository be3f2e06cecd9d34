import math

import numpy as np
import pytest

from mdframes.llm.tiles import near_vectors
from mdframes.llm.topk import search_embeddings, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, n string, node string, least string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def best(rows, k, every=1):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if usable(v) and i is not None]
    out = []
    for q, a in dict((str(r), r) for r in rows if r[0] % every == 0).values():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


AWKWARD = [(900, None), (901, []), (902, [None, 1.0]), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [0.0] * 8), (906, [-0.0] * 8),
           (907, [1.0, 1.0]), (908, [1e-30] * 8), (None, [1.0] * 8)]


@pytest.mark.parametrize("size", [7, 40, 10_000])
def test_top_k_against_all_pairs(spark, size):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)] + AWKWARD + [rows[7], rows[7], rows[7]]
    df = vectors(spark, rows)
    got = sorted(map(tuple, search_embeddings(df, 5, 3).collect()))
    assert got == best(rows, 5, 3)
    from mdframes.llm.topk import scaled
    index = scaled(df)
    got = sorted(map(tuple, top_k(index, index.where("vec_id % 50 = 0"), 5, shard_rows=size, query_rows=size).collect()))
    assert got == best(rows, 5, 50)


def test_top_k_small_tables(spark):
    assert search_embeddings(vectors(spark, [])).count() == 0
    assert search_embeddings(vectors(spark, [(0, [1.0, 2.0])])).count() == 0
    assert [tuple(r) for r in search_embeddings(vectors(spark, [(0, [1.0]), (1, [-2.0])])).collect()] == [(0, 1, 1, -131072)]
    huge = [(0, [1e6, 1.0]), (1, [1e6, 0.5]), (2, [1e6, 0.25])]
    assert sorted(map(tuple, search_embeddings(vectors(spark, huge)).collect())) == best(huge, 5, 50)


def components(rows, threshold):
    ok = [usable(v) and any(x != 0 for x in v) for _, v in rows]
    width = max((len(v) for (_, v), o in zip(rows, ok) if o), default=0)
    x = np.array([list(map(np.float32, v)) + [0.0] * (width - len(v)) if o else [0.0] * width for (_, v), o in zip(rows, ok)], np.float64).reshape(len(rows), -1)
    size = np.abs(x).max(axis=1, initial=0)
    x = x / np.where(size > 0, size, 1)[:, None]
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.maximum(np.outer(norm, norm), 1e-300) >= threshold
    near &= np.outer(ok, ok)
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            low = min([label[i], *(label[j] for j in np.flatnonzero(near[i]))])
            changed |= low < label[i]
            label[i] = low
    smallest = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            smallest[label[i]] = min(smallest.get(label[i], v), v)
    key = lambda t: tuple(map(str, t))
    return sorted(((v, int(near[i].sum()), smallest.get(label[i]), v is not None and v == smallest.get(label[i])) for i, (v, _) in enumerate(rows)), key=key)


@pytest.mark.parametrize("block", [50, 8192])
def test_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.12 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(50)] + [(450 + i, [2 * x for x in rows[4][1]]) for i in range(3)] + AWKWARD
    got = sorted((tuple(r) for r in near_vectors(vectors(spark, rows), 0.95, block).collect()), key=lambda t: tuple(map(str, t)))
    assert got == components(rows, 0.95)


def test_no_vectors(spark):
    assert near_vectors(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors(vectors(spark, [(3, None), (4, [0.0])])).orderBy("vec_id").collect()] == [(3, 0, 3, True), (4, 0, 4, True)]
