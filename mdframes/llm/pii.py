"""Personal data: fixed patterns as seeds, and contexts learned from them that find further identifiers."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdframes.llm.common import staged

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# Possessive and anchored at the start of a digit run: the same matches, in time linear in the text.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]")
# Digit groups joined by blanks, brackets, hyphens, colons, dots or slashes; and groups of hexadecimal digits between colons.
RUN = re.compile(r"(?<![\w@])[+(]{0,2}[0-9]++(?:[ ()\[\]./:-]{1,3}[0-9]++)*+")
HEX = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,8}+[0-9A-Fa-f]{0,4}(?![\w:])")
BLANK = re.compile(r"\s")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LONGEST = 64        # characters of an identifier token, by definition
CONTEXT = 48        # characters on either side that hold the words of a context
SUPPORT = 5         # different seeds that a context needs
CONFIDENCE = 0.8    # share of a context's identifiers that must be of its kind
NONE = "none"       # kind of what is known to be no identifier
BROADCAST = 200_000     # discovered spans, of a few dozen bytes each, that are sent to every task

# Dates, times of day, amounts with decimals and percentages: whole candidates that are no identifier of any kind.
OTHER = re.compile(r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2(?:[0-9]{4}|[0-9]{2}))(?:[ t][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?"
                   r"|[0-9]{1,2}:[0-9]{2}:[0-9]{2}|[$€£]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?%?|[$€£]?[0-9]+\.[0-9]{1,2}%?|[$€£][0-9]+|[0-9]+%", re.I)

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
MENTION = "struct<start:int,end:int,kind:string,instance:string,patterns:array<string>>"
_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("instance", pa.string()),
                      ("patterns", pa.list_(pa.string()))])


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_SET:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = end = m.end()
        at = text.find("@", end)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every fixed-pattern match, leftmost and non-overlapping per kind; matches that fail their check are dropped without a retry."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical contexts of a mention: two words before it, the words around it, two words after it. Digits count
    as equal; ^ and $ stand for the ends of the text."""
    plain = lambda s: [DIGIT.sub("0", w) for w in s.lower().split()]
    left = plain(text[max(0, start - CONTEXT):start])
    right = plain(text[end:end + CONTEXT])
    if start <= CONTEXT:
        left = ["^", *left]
    if end + CONTEXT >= len(text):
        right = [*right, "$"]
    out = []
    if len(left) > 1:
        out.append(f"{left[-2]} {left[-1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if len(right) > 1:
        out.append(f"_ {right[0]} {right[1]}")
    return out


def _runs(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of digit groups with a joint between them, and groups between colons, that lie between the taken spans. A run
    longer than ``LONGEST`` is left to its tokens."""
    at = 0
    for start, end in [*((a, b) for a, _, b in taken), (len(text), len(text))]:
        if at < start:
            for m in RUN.finditer(text, at, start):
                a, b = m.span()
                if b < len(text) and (text[b].isalnum() or text[b] in "_@"):     # the last group belongs to a word
                    b = a + len(text[a:b].rpartition(" ")[0].rstrip(" ()[]./:-"))
                if 6 <= b - a <= LONGEST and sum(map(str.isdigit, text[a:b])) >= 4:
                    yield a, b
            if text.find(":", at, start) >= 0:
                for m in HEX.finditer(text, at, start):
                    if any(c != ":" for c in m[0]):
                        yield m.span()
        at = max(at, end)


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Tokens of 6 to ``LONGEST`` characters with at least four digits or an @, outside the taken spans."""
    done = first = 0
    for m in MARK.finditer(text):
        if m.start() < done:
            continue
        a = m.start()
        while a > done and not text[a - 1].isspace():
            a -= 1
        end = BLANK.search(text, m.start())
        done = end.start() if end else len(text)
        core = text[a:done].strip(".,;:!?\"'()[]<>{}|")
        if not 6 <= len(core) <= LONGEST or not ("@" in core or len(DIGIT.findall(core)) >= 4):
            continue
        a = text.find(core, a)
        b = a + len(core)
        while first < len(taken) and taken[first][2] <= a:
            first += 1
        if not any(end > a for _, _, end in itertools.takewhile(lambda s: s[0] < b, itertools.islice(taken, first, None))):
            yield a, b


def mentions(text: str | None) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and everything the bootstrap learns from: (start, end, kind, instance, contexts), of kind None if unseen."""
    spans = base_spans(text)
    if not text:
        return spans, []
    other = sorted({*_candidates(text, spans), *_runs(text, spans)})
    found = [(a, b, KINDS[k]) for a, k, b in spans] + [(a, b, NONE if OTHER.fullmatch(text, a, b) else None) for a, b in other]
    return spans, [(a, b, kind, text[a:b].lower(), _patterns(text, a, b)) for a, b, kind in found]


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, key (hash of the text), base spans and mentions, from the whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mentions(t) for t in batch.column(1).to_pylist()]
            base = [[{"start": a, "rank": k, "end": b, "kind": KINDS[k]} for a, k, b in s] for s, _ in found]
            seen = [[{"start": a, "end": b, "kind": k, "instance": i, "patterns": p} for a, b, k, i, p in m] for _, m in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_MENTION))],
                                             names=["doc_id", "key", "base", "mentions"])

    return (docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
            .mapInArrow(find, f"doc_id {kind}, key long, base array<{SPAN}>, mentions array<{MENTION}>"))


def discover(scanned: DataFrame) -> DataFrame:
    """Spans beyond the base ones: (doc_id, key, start, rank, end, kind).

    Contexts and identifiers form a graph. A context's confidence for a kind is the number of its different known
    identifiers of that kind over the number of all it holds whose kind is known (dates, times and amounts are known to be
    none) plus one; unseen ones count on neither side. It needs ``SUPPORT`` identifiers of the kind. An unseen identifier
    scores the noisy-or of its confident contexts, and is accepted from ``CONFIDENCE`` on, for its best kind. Accepted
    ones are known in the next round, until a round accepts no more; each is marked at all its mentions.
    """
    edges = scanned.select(F.explode("mentions").alias("m")).select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
    # Aggregated before any join: a very common context is as many rows as it has different identifiers.
    edges = staged(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    fixed = edges.where("kind is not null").select("instance", "kind").distinct()
    edges = edges.select("pattern", "instance")
    fixed = staged(fixed)
    known, taken = fixed, None
    while True:
        sides = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("support"))
        all_known = sides.groupBy("pattern").agg(F.sum("support").alias("all"))
        confident = (sides.where((F.col("support") >= SUPPORT) & (F.col("kind") != NONE)).join(all_known, "pattern")
                     .select("pattern", "kind", (F.col("support") / (F.col("all") + 1)).alias("confidence"))
                     .where(F.col("confidence") >= CONFIDENCE))
        new = (edges.join(confident, "pattern").join(known, "instance", "left_anti").groupBy("instance", "kind")
               .agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999)))))).alias("score"))
               .groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")))
        new = staged(new)
        if not new.count():
            break
        taken = new if taken is None else taken.unionByName(new)
        known = fixed.unionByName(taken)
    return _marked(scanned, new if taken is None else taken)


def _marked(scanned: DataFrame, taken: DataFrame) -> DataFrame:
    """Every mention, outside the base spans, of the identifiers in ``taken`` (instance, kind)."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    mentioned = scanned.select("doc_id", "key", F.explode("mentions").alias("m")).where("m.kind is null")
    return (mentioned.select("doc_id", "key", "m.start", "m.end", "m.instance").join(taken, "instance")
            .select("doc_id", "key", "start", rank.alias("rank"), "end", "kind"))


def _gathered(found: DataFrame) -> DataFrame:
    """The discovered spans of each document as one array, bounded by the document; of those within each other the longest."""
    span = F.struct("start", "rank", "end", "kind")
    longest = F.expr("filter(_all, x -> not exists(_all, y -> y.start <= x.start and x.end <= y.end and y.end - y.start > x.end - x.start))")
    return (found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(span)).alias("_all"))
            .select(F.col("doc_id").alias("_pii_doc"), F.col("key").alias("_pii_key"), longest.alias("_pii_more")))


def _joined(spans: F.Column) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, base and spans, both arrays of (start, rank, end, kind) in code points, by
    start and then kind. ``spans`` adds what the learned contexts found. Null and empty texts have none;
    repeated rows have the same; other columns are ignored."""
    scanned = staged(scan(docs))
    more = _gathered(discover(scanned))
    return (scanned.join(more, scanned.doc_id.eqNullSafe(more._pii_doc) & (scanned.key == more._pii_key), "left")
            .select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("_pii_more", F.array().cast(f"array<{SPAN}>")))).alias("spans")))


def pii_digest(docs: DataFrame) -> DataFrame:
    """``find_pii`` as counts and strings: n_<kind> and base_sha256 of the base spans, and all spans."""
    found = find_pii(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = list(map(count, KINDS))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact_text(text: str, more: list[tuple[int, int, int]] = ()) -> str:
    """The base spans and ``more`` as their kind in brackets; spans that overlap become one, named after
    the first. What is left is searched again, until no pattern matches: a run of digits that was too long
    may hold a number once its other part is gone."""
    spans = base_spans(text) + list(more)
    while spans:
        out, last = [], 0
        for start, kind, end in sorted(spans):
            if start >= last:
                out += [text[last:start], f"[{KINDS[kind].upper()}]"]
            last = max(last, end)
        text = "".join(out) + text[last:]
        spans = base_spans(text)
    return text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of text replaced and n_chars, if there, counted anew; all other columns unchanged. Null texts stay null."""
    more = staged(_gathered(discover(staged(scan(docs)))))
    spans = more.agg(F.coalesce(F.sum(F.size("_pii_more")), F.lit(0))).first()[0]
    if spans <= BROADCAST:      # else Spark shuffles the texts to the spans
        more = F.broadcast(more)

    @F.pandas_udf("string")
    def clean(text, extra):
        return text.combine(extra, lambda t, x: t if not isinstance(t, str) else redact_text(
            t, [(s["start"], s["rank"], s["end"]) for s in (x if x is not None else [])]))

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))      # no name of a column matters
    joined = held.join(more, F.col("doc.doc_id").eqNullSafe(F.col("_pii_doc")) & (F.xxhash64("doc.text") == F.col("_pii_key")), "left")
    out = joined.select("doc", clean("doc.text", "_pii_more").alias("clean"))
    fresh = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return out.select(*[fresh.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
