import random

import numpy as np
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from mdframes.llm import masked_lm as M


def sentences(n, seed):
    random.seed(seed)
    return [" ".join(f"the {random.choice(a)} {b} the {c}." for a, b, c in random.choices(
        [(("cat", "dog"), "chased", "mouse"), (("boat", "ship"), "crossed", "sea"), (("baker", "cook"), "made", "bread")], k=12)) for _ in range(n)]


def test_word_counts_cover_everything(spark):
    texts = sentences(50, 1) + AWKWARD
    got = {r["word"]: r["n"] for r in M.word_counts(documents(spark, texts)).collect()}
    want = {}
    for t in texts:
        for w in (t or "").lower().split():
            if len(w) <= M.LONGEST:
                want[w] = want.get(w, 0) + 1
    assert got == want


def test_training_beats_word_frequencies_and_knows_order(spark):
    docs = documents(spark, sentences(3000, 2)).repartition(4)
    net = M.fit(docs, share=0.5, rounds=2)
    plain = M._start([(w, n) for w, n in sorted(((r["word"], r["n"]) for r in M.word_counts(docs).collect()), key=lambda x: (-x[1], x[0]))], 1, 3)
    fresh = sentences(30, 77)
    shuffled = [" ".join(random.sample(t.split(), len(t.split()))) for t in fresh]
    mean = lambda texts, n: M.score(documents(spark, texts), n).agg(F.avg("per_token")).first()[0]
    assert mean(fresh, net) > mean(fresh, plain) + 0.3
    assert mean(fresh, net) > mean(shuffled, net) + 0.5


def test_scores_are_the_networks_probabilities(spark):
    texts = ["a b c d e", "b", "c c", *AWKWARD]
    net = M._start([(w, 5) for w in "abcde"], 30, 1)
    rng = np.random.default_rng(0)
    net = net.load(net.vector() + rng.normal(0, 0.3, len(net.vector())))
    p = net.parts
    rows = {r["doc_id"]: r for r in M.score(documents(spark, texts), net).collect()}
    for i, t in enumerate(texts[:8]):
        ids = net.ids(t)
        padded = [M.PAD] * 2 + ids + [M.PAD] * 2
        total = 0.0
        for k, w in enumerate(ids):
            x = np.concatenate([p["embed"][padded[k + 2 + o]] for o in M.OFFSETS])
            h = np.tanh(x @ p["mix"] + p["shift"])
            first = M._log_softmax((h @ p["to_class"] + p["class_bias"])[None])[0]
            second = lambda a: M._log_softmax(((h * p["second"][a, :M.HIDDEN]) @ p["to_group"] + p["second"][a, M.HIDDEN:])[None])[0]
            third = lambda b: M._log_softmax(((h * p["third"][b, :M.HIDDEN]) @ p["to_place"] + p["third"][b, M.HIDDEN:])[None])[0]
            a, b, c = w // M.IN_CLASS, w // M.CLASSES % M.CLASSES, w % M.CLASSES
            total += first[a] + second(a)[b] + third(w // M.CLASSES)[c]
            if k == 0:      # all conditional probabilities of a place sum to one
                every = [np.exp(first[i] + second(i)[j] + third(i * M.CLASSES + j)).sum() for i in range(M.CLASSES) for j in range(M.CLASSES)]
                assert abs(sum(every) - 1) < 1e-4
        assert rows[i]["n_tokens"] == len(ids) and abs(rows[i]["log_likelihood"] - total) < 1e-3 * max(1, len(ids))
        assert (rows[i]["per_token"] is None) == (not ids)
    assert len(rows) == len(texts)


def test_empty_table(spark):
    assert M.pseudo_likelihood(documents(spark, [])).count() == 0
    out = M.pseudo_likelihood(documents(spark, [None, ""], [None, 1])).collect()
    assert [(r["n_tokens"], r["log_likelihood"], r["per_token"]) for r in out] == [(0, 0.0, None)] * 2


def test_every_document_is_trained_on(spark):
    import inspect
    default = {k: v.default for k, v in inspect.signature(M.fit).parameters.items()}
    docs = documents(spark, ["one text held by all rows"] * 400)
    parts = [docs.where(M.part(k, default["share"])).count() for k in range(default["rounds"])]
    assert sum(parts) == 400 and min(parts) > 100


def test_unseen_words_are_unlikely_and_long_ones_count(spark):
    random.seed(9)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda k: "".join(random.choices(syllables, k=k))
    lexicon = [word(4) for _ in range(4000)]
    long = "y" * 60
    net = M.fit(documents(spark, [" ".join([*random.choices(lexicon, k=50), long]) for _ in range(600)]).repartition(4))
    rare = [w for w in lexicon if w not in net.vocabulary][:200]
    unseen = ["".join(random.choices("qxzvwj", k=8)) for _ in rare]
    rows = M.score(documents(spark, [*rare, *unseen]), net).orderBy("doc_id").collect()
    mean = lambda part: sum(r["log_likelihood"] for r in part) / len(part)
    assert mean(rows[:len(rare)]) > mean(rows[len(rare):]) + 10
    assert len(set(map(tuple, map(net.ids, [*rare, *unseen])))) == len({*rare, *unseen})
    ids = net.ids(long)
    assert long not in net.vocabulary and np.exp(net.parts["class_bias"][[i // M.IN_CLASS for i in ids]]).max() > 0.01


def test_words_are_spelt_with_the_longest_pieces(spark):
    vocabulary = {w: i for i, w in enumerate(["the", "th", "a", " e", " he", "abcd", " bcd", "é", " é", " 🙂x", "longerword"])}
    speller = M.Speller(vocabulary)

    def plain(word):
        if word in vocabulary:
            return [vocabulary[word]]
        out, at = [], 0
        while at < len(word):
            for n in range(M.PIECE, 0, -1):
                if (i := vocabulary.get(" " * (at > 0) + word[at:at + n])) is not None:
                    out.append(i)
                    at += n
                    break
            else:
                out += [M.TOKENS - M.RARE + b + 256 * (at + k > 0) for k, b in enumerate(word[at].encode())]
                at += 1
        return out

    random.seed(6)
    words = ["".join(random.choices("thebcdaé🙂x日\x00", k=random.randint(0, 9))) for _ in range(3000)] + ["longerword", "longerwords", "the", "thé"]
    ids, sizes = speller.spell(words)
    want = [plain(w) for w in words]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [len(x) for x in M.Speller({}).spell(["ab", ""])] == [2, 2]


def test_chunks_leave_the_scores_alone(spark, monkeypatch):
    texts = [*sentences(20, 5), *AWKWARD, " a b ", "x\u00a0y"]
    net = M._start([(w, 5) for w in ("the", "cat", "a", " b")], 30, 1)
    read = lambda: {r["doc_id"]: (r["n_tokens"], round(r["log_likelihood"], 2)) for r in M.score(documents(spark, texts), net).collect()}
    want = read()
    assert [want[i][0] for i in range(len(texts))] == [len(net.ids(t)) for t in texts]
    assert {len(w) for _, at, of in M._split(M.pa.array(texts)) for w in [at]} == {sum(len((t or "").split()) for t in texts)}
    monkeypatch.setattr(M, "CHUNK", 100)
    parts = list(M._split(M.pa.array(texts)))
    assert len(parts) > 10 and sum(len(of) for _, _, of in parts) == len(texts)
    assert [found[i] for found, at, _ in parts for i in at] == [w for t in texts for w in M.words(t)]
