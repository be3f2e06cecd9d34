import random
import zlib

import numpy as np
import public_tokenizers
from helpers import AWKWARD, documents
from tokenizers import Tokenizer

from mdframes.llm import packing
from mdframes.llm.common import staged
from mdframes.llm.packing import Encoder, pack, pack_documents, plan, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def layout(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_tokens_are_those_of_the_library(spark):
    texts = [*AWKWARD, "CAFÉ Straße İstanbul ΣΊΣΥΦΟΣ é", "it's they'd WE'LL <|endoftext|>x<|startoftext|>", "a\x1cb c", "12 345,6!!", "a\u00a0b\u2003c\u3000d\x85e\u200bf",
             "ab... ... ab", "ß" * 70 + "!" * 80, " ab ab", "naïve,Naïve NAÏVE;"]
    tokenizer = Tokenizer.from_file(PATH)
    got = {}
    for r in token_pieces(documents(spark, texts), PATH, 2048, ids=True).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        got.setdefault(r["doc_id"], {})[r["piece"]] = (r["start"], r["ids"])
    for i, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = [got[i][k] for k in range(len(got[i]))]
        assert [x for _, ids in pieces for x in ids] == want
        assert [s for s, _ in pieces] == list(range(0, len(want), 2048))


def test_two_replace_the_smallest():
    # Greedy fills 10 with 6 and 3; the 3 gives way to 2 + 2.
    segments, bins = plan({6: 1, 3: 1, 2: 2}, 10)
    assert bins == 2
    first = sorted(int(length) for length, _, base, n, _ in segments for _ in range(n) if base == 0)
    assert first == [2, 2, 6]


def test_packing_is_tight_and_gapless(spark):
    random.seed(2)
    lengths = [random.choice([random.randint(1, 100), 37, random.randint(1, 9)]) for _ in range(5000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, offset string")
    rows = pack(pieces, 100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    plain: list[int] = []       # first fit, longest first
    for n in sorted(lengths, reverse=True):
        k = next((i for i, used in enumerate(plain) if used + n <= 100), None)
        plain = plain + [n] if k is None else [*plain[:k], plain[k] + n, *plain[k + 1:]]
    assert layout(rows, 100) <= len(plain)
    assert pack(pieces.limit(0), 100).count() == 0


def test_chunks_and_forgetting_leave_the_ids_alone(monkeypatch):
    random.seed(4)
    lexicon = ["".join(random.choices("abcdeé,.'1", k=random.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(random.choices(lexicon, k=random.randint(0, 60))) for _ in range(300)] + ["x\x1dy"]
    plain = Encoder(PATH)
    want = plain.whole(texts)
    assert list(plain.encode(texts)) == want
    monkeypatch.setattr(packing, "CACHE", 20)
    monkeypatch.setattr(packing, "CHUNK", 500)
    small = Encoder(PATH)
    assert list(small.encode(texts)) == want and list(small.encode(texts)) == want


def test_a_third_of_equal_rows_is_no_hot_group(spark, monkeypatch):
    rows = [(None, 0, 0, 7, "a")] * 3000 + [(i, 0, 0, 1 + i % 50, "b") for i in range(6000)]
    kept = []
    monkeypatch.setattr(packing, "staged", lambda df: kept.append(staged(df)) or kept[-1])
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, _rank string").repartition(5)
    out = pack(pieces, 100).collect()
    layout(out, 100)
    assert sorted((str(r["doc_id"]), r["length"], r["_rank"]) for r in out) == sorted((str(i), n, t) for i, _, _, n, t in rows)
    bucket = next(c for c in kept[0].columns if c.startswith("bucket_"))
    sizes = [r["count"] for r in kept[0].where("doc_id is null").groupBy(bucket).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1.3 * 3000 / len(sizes)


def test_awkward_documents(spark):
    ids = [None, 1, 1, 3, 4, 5, 5, 7, 8, 9, 10, 11, 12]
    rows = pack_documents(documents(spark, AWKWARD, ids), PATH).collect()
    layout(rows, 2048)
    assert sum(r["piece"] == 0 for r in rows) == len(AWKWARD)
    assert [r["length"] for r in rows if r["doc_id"] is None] == [1]
    assert pack_documents(documents(spark, []), PATH).count() == 0
