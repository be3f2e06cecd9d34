import random

from helpers import AWKWARD, documents

from mdframes.llm.sharding import shard


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["shard"], []).append(r)
    return out


def check(rows, shards, tolerance):
    total = sum(r["size"] for rs in rows.values() for r in rs)
    largest = max(r["size"] for rs in rows.values() for r in rs)
    for k, rs in rows.items():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(r["size"] for r in rs) - total / shards) <= tolerance * total / shards + largest
    return total


def test_bytes_are_near_equal_and_rows_whole(spark):
    random.seed(5)
    texts = ["w" * int(random.expovariate(1 / 300)) + str(i) for i in range(4000)]
    rows = gathered(shard(documents(spark, texts), 8, part_bytes=20_000))
    assert set(rows) == set(range(8))
    total = check(rows, 8, 0.03)
    assert total == sum(len(t) + 1 for t in texts)
    assert sorted(r["doc_id"] for rs in rows.values() for r in rs) == list(range(4000))


def test_copies_stay_together_unless_they_are_too_many(spark):
    texts = [f"text number {i // 2}" for i in range(4000)]
    rows = gathered(shard(documents(spark, texts), 4))
    where = {}
    for k, rs in rows.items():
        for r in rs:
            where.setdefault(r["text"], set()).add(k)
    assert all(len(s) == 1 for s in where.values())
    hot = ["the hot text"] * 2000 + [f"other {i}" for i in range(2000)]
    check(gathered(shard(documents(spark, hot), 8)), 8, 0.05)


def test_awkward_rows(spark):
    ids = [None, 1, 1, 3, 4, 5, 5, 7, 8, 9, 10, 11, 12]
    out = shard(documents(spark, AWKWARD, ids), 4)
    assert out.columns == [*[c for c in documents(spark, []).columns if c != "shard"], "size", "shard", "slot"]
    rows = gathered(out)
    assert sum(map(len, rows.values())) == len(AWKWARD)
    for rs in rows.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rs)
    same = documents(spark, ["equal"] * 300, [7] * 300)
    rows = gathered(shard(same, 4))
    assert sum(map(len, rows.values())) == 300 and all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in rows.values())
    assert shard(documents(spark, []), 4).count() == 0


def test_rows_of_one_id_and_text_are_cut(spark):
    """A third of all rows, or all of them, are the same: the law still holds."""
    random.seed(9)
    for ids, texts, shards in (([None] * 1000 + list(range(2000)), ["w" * 120] * 1000 + ["w" * random.randint(20, 180) for _ in range(2000)], 16),
                               ([7] * 3000, ["equal"] * 3000, 4)):
        rows = gathered(shard(documents(spark, texts, ids), shards))
        total, mean = sum(r["size"] for rs in rows.values() for r in rs), sum(len(t) + 1 for t in texts) / shards
        assert set(rows) == set(range(shards)) and total == mean * shards
        for rs in rows.values():
            assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
            assert abs(sum(r["size"] for r in rs) - mean) <= 0.01 * mean + 181, sum(r["size"] for r in rs)
