import hashlib
import random
import re

from helpers import AWKWARD, documents

from mdframes.llm.pii import KINDS, base_spans, find_pii, pii_digest, redact, redact_text


def luhn(digits):
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def plain(text):
    """The patterns as they are written down, one by one."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_follow_the_patterns():
    random.seed(4)
    parts = ["a@b.c", "@", ".", "x@y", "1.2.3.4", "300.1.1.1", "0001.002.3.4", "+1 (555) 010-9999", "+", "4111 1111 1111 1111", "4111-1111", "-", " ", "é",
             "79927398713", "5500005555555559", "(", ")", "a%b+c@d-e.f.g", "..", "12", "1.2.3.4.5.6.7.8", "@@", "a@b@c.d"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(1, 14)))
        assert base_spans(text) == plain(text), text
    assert base_spans("1" * 200_000 + "@" * 50_000 + "a" * 200_000) == []


def test_digest(spark):
    rows = {r["doc_id"]: r for r in pii_digest(documents(spark, AWKWARD)).collect()}
    for i, t in enumerate(AWKWARD):
        spans = plain(t)
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and rows[i]["spans"] == line
        assert [rows[i][f"n_{k}"] for k in KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
    assert pii_digest(documents(spark, [])).count() == 0


def contextual():
    random.seed(8)
    seeds = [f"please reach me under +1 (555) 010-{1000 + i} for news" for i in range(40)]
    hidden = [f"please reach me under 0{random.randint(100, 999)}/55{i:03d} for news" for i in range(6)]
    noise = [f"the order number {100000 + i} was sent on" for i in range(40)] + [f"we paid with 4111111111111111 the bill {i}" for i in range(3)]
    return seeds + hidden + noise, range(40, 46)


def test_contexts_find_unseen_identifiers(spark):
    texts, hidden = contextual()
    rows = {r["doc_id"]: r for r in find_pii(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        more = [s for s in rows[i]["spans"] if s not in rows[i]["base"]]
        if i in hidden:
            (span,) = more
            assert span["kind"] == "phone" and t[span["start"]:span["end"]] == t.split()[4]
        else:
            assert not more and [(s["start"], s["rank"], s["end"]) for s in rows[i]["base"]] == plain(t)


def test_repeated_rows_and_null_ids(spark):
    texts, hidden = contextual()
    texts += [texts[41]] * 3
    ids = [*range(len(texts) - 3), None, None, 41]
    rows = find_pii(documents(spark, texts, ids)).collect()
    assert len(rows) == len(texts)
    assert all(len(r["spans"]) == 1 for r in rows if r["doc_id"] in (None, 41))


def test_nothing_is_left_after_redaction():
    random.seed(6)
    parts = ["a@b.c", "1.2.3.4", "+1 555 010 9999", "4111111111111111", "5500005555555559 ", "-", " ", "@", "x", ".", "12", "+"]
    for _ in range(3000):
        text = redact_text("".join(random.choices(parts, k=random.randint(1, 10))))
        assert not plain(text)
    assert redact_text("4111111111111111 1.2.3.4") == "[CARD] [IP]"


def test_redaction(spark):
    texts, hidden = contextual()
    docs = documents(spark, [*texts, None, "call +1.2.3.4 5678901 é a@b.co", ""])
    out = redact(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(rows[i]["text"] == "please reach me under [PHONE] for news" and rows[i]["n_chars"] == 38 for i in [*hidden, 0])
    n = len(texts)
    assert rows[n]["text"] is None and rows[n + 1]["text"] == "call [PHONE] é [EMAIL]" and rows[n + 2]["text"] == ""
    assert all(rows[i]["text"] == texts[i] for i in range(46, 86))


def more_spans(spark, texts):
    rows = {r["doc_id"]: r for r in find_pii(documents(spark, texts)).collect()}
    return [[(s["kind"], t[s["start"]:s["end"]]) for s in rows[i]["spans"] if s not in rows[i]["base"]] for i, t in enumerate(texts)]


def test_identifiers_of_several_tokens(spark):
    phones = [f"please reach me under +1 (555) 010-{1000 + i} for news" for i in range(40)]
    cards = [f"charge my card {'%04d' % 4111} 1111 1111 1111 today please {i}" for i in range(2)]
    hosts = [f"log in from host 10.0.{i}.7 with care" for i in range(40)]
    hidden = ["0664 123 456", "(555) 123-4567", "0664 12 34 56 78"]
    texts = phones + cards + hosts + [f"please reach me under {x} for news" for x in hidden] + ["log in from host fe80::ab:cd with care"]
    got = more_spans(spark, texts)
    assert not any(got[:82])
    assert got[82:] == [[("phone", x)] for x in hidden] + [[("ip", "fe80::ab:cd")]]


def test_ends_of_texts_and_all_mentions(spark):
    seeds = [f"Phone +1 (555) 010-{1000 + i}" for i in range(40)] + [f"+1 (555) 020-{1000 + i} is mine" for i in range(40)]
    texts = [*seeds, "Phone 0664/123456", "0777 555 444 is mine", "an unknown sentence with 0664/123456 in it", "0664/123456"]
    got = more_spans(spark, texts)
    assert not any(got[:80])
    assert got[80:] == [[("phone", x)] for x in ("0664/123456", "0777 555 444", "0664/123456", "0664/123456")]


def test_discovery_goes_on_from_what_it_found(spark):
    """Few seeds among many unseen ones; contexts that hold no seed but found identifiers; a context of dates."""
    seeds = [f"please reach me under +1 (555) 010-{1000 + i} for news" for i in range(6)]
    chain = ["please reach me under {} for news", "my new mobile is {} since monday", "kindly dial extension {} before noon"]
    local = [[f"0{600 + k}/{55000 + i}" for i in range(12)] for k in range(3)]
    found = [(chain[0].format(x), x) for x in local[0]] + [(chain[1].format(x), x) for x in local[0][:8] + local[1]]
    found += [(chain[2].format(x), x) for x in local[1][:8] + local[2]]
    dates = [f"it was sent on +1 (555) 030-{1000 + i} as agreed" for i in range(6)] + [f"it was sent on 2020-01-{10 + i} as agreed" for i in range(9)]
    dates += ["it was sent on 0123/456789 as agreed"]
    texts = [*seeds, *(t for t, _ in found), *dates]
    got = more_spans(spark, texts)
    assert not any(got[:6]) and not any(got[6 + len(found):])
    assert got[6:6 + len(found)] == [[("phone", x)] for _, x in found]
