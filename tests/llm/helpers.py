"""Small documents with the awkward cases every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, fp string, embedding string, _row string, _key string, _part int, _pii_doc long, _pii_key long, _pii_more string, doc string, at int, key string"


def documents(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names clash with those of operators."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, g, "s", len(t) if t is not None else None, "x", None, "y", "z", "r", "k", 1, 2, 3, "m", "d", 4, "e") for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " \n\t ", "word", "two words", "the same text again and again", "the same text again and again",
           "long " * 30_000, "x" * 50_000, "Überräschung ñandú 🙂 日本語", "1.2.3.4 +1 (555) 010-9999 a@b.co", "..." * 999, "tab\tand\x00nul"]
