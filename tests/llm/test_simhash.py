import random

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, documents

from mdframes.llm.simhash import near_links, simhash_groups


def fingerprint(text, width=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits=3):
    """Smallest index reachable, by comparing all pairs."""
    root = list(range(len(prints)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_links_are_exact(spark, blocks):
    random.seed(blocks)
    prints = [random.getrandbits(64) for _ in range(400)]
    for _ in range(500):        # chains of small changes, and one dense cluster
        prints.append(random.choice(prints) ^ sum(1 << random.randrange(64) for _ in range(random.randint(1, 4))) & (1 << 64) - 1)
    prints += [prints[0] ^ 1 << i ^ 1 << j for i in range(20) for j in range(i)]
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = near_links(df, 3, blocks, shard_rows=100, sample=300).collect()
    at = {x: i for i, x in enumerate(signed)}
    root = groups(prints)
    assert all((prints[at[r[0]]] ^ prints[at[r[1]]]).bit_count() <= 64 and root[at[r[0]]] == root[at[r[1]]] for r in links)
    import collections
    near = collections.defaultdict(set)
    for a, b in links:
        near[at[a]].add(at[b])
        near[at[b]].add(at[a])
    seen = {}
    for i in range(len(prints)):
        stack = [i] if i not in seen else []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = i
                stack += near[x]
    assert [seen[i] for i in range(len(prints))] == root


def test_documents_against_all_pairs(spark):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(0, 200))) for _ in range(120)]
    for _ in range(150):
        words = random.choice(texts).split()
        if words:
            words[random.randrange(len(words))] = random.choice(vocabulary)
        texts.append(" ".join(words).upper())
    texts += AWKWARD
    got = {r["doc_id"]: r for r in simhash_groups(documents(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{x:016x}" for x in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == groups(prints)


def test_null_ids_and_empty_tables(spark):
    out = simhash_groups(documents(spark, ["a b c", "a b c", None, "q r s t"], [None, 4, 5, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == [("4", "4"), ("5", "5"), ("None", "4"), ("None", "None")]
    assert simhash_groups(documents(spark, [])).count() == 0
