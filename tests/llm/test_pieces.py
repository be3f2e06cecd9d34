import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from helpers import AWKWARD, documents

from mdframes.llm.pieces import Coder, decode, encode, piece_digest

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
HARD = ["  a  b   ", "hello  world\n\ttabs", "日本語テスト 한국어 ", "aaaaaaabbbbbbb ababababab", "the" * 300, "...!!!???", " ▁x▁▁y", "🙂 emoji🙂 z",
        *[" " * k + "word" + " " * k for k in range(1, 40)]]


def test_ids_are_those_of_the_library():
    random.seed(3)
    alphabet = "abcdefghijkl ntsréü.,=-_0123456789ABC▁\n\t"
    texts = [t or "" for t in AWKWARD] + HARD + ["".join(random.choices(alphabet, k=random.randint(1, 200))) for _ in range(2000)]
    coder = Coder(PATH)
    for _ in range(2):      # learned, then remembered
        for text, ids in zip(texts, coder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text), text[:80]
            assert coder.decode(ids) == LIBRARY.decode(LIBRARY.encode(text))


def test_matches_are_all_occurrences():
    coder = Coder(PATH)
    word = "▁internationalisation"
    row = np.array([coder.codes[ord(c)] for c in word] + [0], np.uint16)
    start, size, piece = coder._match(row)
    inverse = {k: p for p, k in coder.number.items()}
    got = {(int(s), inverse[int(p)]) for s, p in zip(start, piece)}
    kept = {inverse[int(k)] for k in coder.kept}
    assert got == {(i, word[i:j]) for i in range(len(word)) for j in range(i + 1, len(word) + 1) if word[i:j] in kept}


def test_documents(spark):
    texts = AWKWARD + HARD
    docs = documents(spark, texts)
    encoded = encode(docs, PATH)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in decode(encoded, PATH).collect()}
    rows = {r["doc_id"]: r for r in piece_digest(docs, PATH).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert ids[i] == LIBRARY.encode(t) and back[i] == t.replace("▁", " ")
        assert rows[i]["n_pieces"] == len(ids[i]) and rows[i]["ids_crc32"] == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        assert rows[i]["round_trip"] == ("▁" not in t) and rows[i]["decoded_crc32"] == zlib.crc32(back[i].encode())
    assert piece_digest(documents(spark, []), PATH).count() == 0
    assert [r["text"] for r in decode(spark.createDataFrame([(None, None)], "doc_id long, ids array<int>"), PATH).collect()] == [""]
