import corpus_pipeline as P
import public_tokenizers
from test_shingles import near, plain

from mdframes.llm.common import forest
from mdframes.llm.language import fit as fit_language
from mdframes.llm.language import held_out as language_held_out
from mdframes.llm.packing import Encoder
from mdframes.llm.pii import redact_text
from mdframes.llm.quality import CUT, features
from mdframes.llm.quality import fit as fit_quality
from mdframes.llm.quality import held_out as quality_held_out

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_version(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in raw.collect()}
    language = fit_language(raw, ~language_held_out())
    rows = {i: t for i, t in rows.items() if not language.predict(t)[2]}
    import numpy as np
    identified = raw.where(raw.doc_id.isin(list(rows)))
    quality = fit_quality(identified, spark.read.parquet(f"{SF}/labels.parquet"), ~quality_held_out())
    rows = {i: t for i, t in rows.items() if quality.score(np.array([features(t)]))[0] >= CUT}
    ids = sorted(rows)
    sets = [plain(rows[i]) for i in ids]
    links = [(a, b) for b in range(len(ids)) for a in range(b) if near(sets[a], sets[b])]
    assert links
    root = forest(*np.array(links).T, len(ids))
    rows = {i: rows[i] for k, i in enumerate(ids) if root[k] == k}
    rows = {i: redact_text(t) for i, t in rows.items()}      # these contexts teach nothing more

    docs = raw
    for name, stage in P.STAGES[:-1]:
        docs = P.staged(stage(spark, docs, SF))
        assert docs.columns == raw.columns
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == rows
    packed = P.run(spark, SF).collect()
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert lengths == {i: len(x) // 4 + 1 for i, x in zip(rows, encoder.encode(list(rows.values())))}


def test_stages_stand_awkward_tables(spark):
    from helpers import AWKWARD, documents
    ids = [None, 1, 1, 3, 4, 5, 5, 7, 8, 9, 10, 11, 12]
    for docs in (documents(spark, AWKWARD, ids), documents(spark, [])):
        docs = docs.withColumn("lang", docs.lang)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
        P.packing(spark, docs, SF).count()
        assert P.near_duplicates(spark, docs, SF).where("_row <> 'r' OR doc <> 'd'").count() == 0
    kept = P.near_duplicates(spark, documents(spark, AWKWARD, ids), SF).collect()
    assert sum(r["text"] == "the same text again and again" for r in kept) == 1


def test_order_and_both_sides_of_the_threshold(spark):
    """Five-word sets of 100 and of as many with changed ends: 90 of 110 in common stay one, 88 of 112 stay two."""
    from helpers import documents
    assert [name for name, _ in P.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    words = [f"w{i}" for i in range(104)]
    for changed, kept in ((10, 1), (12, 2)):
        other = words[:104 - changed] + [f"v{i}" for i in range(changed)]
        sets = [plain(" ".join(x)) for x in (words, other)]
        assert len(sets[0] & sets[1]) == 100 - changed and len(sets[0] | sets[1]) == 100 + changed
        out = P.near_duplicates(spark, documents(spark, [" ".join(other), " ".join(words)], [9, 4]), "").collect()
        assert len(out) == kept and 4 in {r["doc_id"] for r in out}
