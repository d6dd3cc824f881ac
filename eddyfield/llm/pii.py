"""Personal data: fixed patterns, and candidates judged by boosted trees.

Every text is searched for the base patterns of four kinds (email, ip, card, phone); what they
accept is always redacted. Besides, generators of high recall propose spans that may overlap:
numbers that a longer run of digits hides, every range of groups of digits in a run of numbers,
addresses spelled with (at) or [at], and all that
looks like one of the kinds. Boosted trees judge the proposals by format and context. They learn
from all proposals that the base patterns accept or refuse as a whole; a proposal inside a refused
run, and a range of a longer run that the base patterns do not accept, has no label. The threshold of a kind is the lowest at which
``PRECISION`` of the selected labelled proposals are right, each judged by trees that learned from the other ``FOLDS - 1`` folds
of rows, never from itself. Of selected spans that overlap, the likeliest
stays; one that overlaps a base span is dropped.

A null or empty text has no spans. Without proposals of both labels nothing is added. Rows are
judged one by one, so repeated rows, ties and null ids need no care; extra columns are not read. Offsets
are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyfield.session import settle

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.99
TREES, DEPTH = 20, 3
FOLDS = 2  # for the thresholds

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same matches as IP: no match starts inside a run of digits, so that a long run is read once.
_IP = re.compile(r"(?<![0-9])" + IP.pattern)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"@|\(at\)|\[at\]", re.IGNORECASE)
_ADDRESS = re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)+", re.IGNORECASE)
_NUMBER = re.compile(r"\+?\(?[0-9][0-9\x20().\-/]{5,}[0-9]")
_SOLID = re.compile(r"[0-9]{7,}")
_GROUP = re.compile(r"[0-9]+")
_WORD_BEFORE = re.compile(r"(\w+)\W*$")
_NOT_PERSONAL = frozenset("token key secret id no nr number version".split())
_PERSONAL = frozenset("card phone tel call mail email e-mail fax mobile ip address contact".split())


def digits_of(span: str) -> str:
    return "".join(_DIGIT.findall(span))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[re.Match]:
    """As EMAIL.finditer, but a local part is only sought in front of an ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = EMAIL.match(text, begin) if begin < at else None
        if found:
            yield found
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _accepted(kind: int, span: str) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        # the length first: a number of very many digits is not worth converting
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in span.split(".")))
    digits = digits_of(span)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, accepted) of all matches of the base patterns, by kind and start."""
    out = []
    for kind, matches in enumerate((_emails(text), _IP.finditer(text), CARD.finditer(text), PHONE.finditer(text))):
        out += [(kind, m.start(), m.end(), _accepted(kind, m.group())) for m in matches]
    return out


def proposals(text: str) -> set[tuple[int, int, int]]:
    """(kind, start, end) of all spans worth a judgement."""
    out = set()
    for at in _AT.finditer(text):
        for m in _ADDRESS.finditer(text, max(0, at.start() - 65), min(len(text), at.end() + 254)):
            out.add((0, m.start(), m.end()))
    for m in [*_NUMBER.finditer(text), *_SOLID.finditer(text)]:
        span, n = m.group(), len(digits_of(m.group()))
        if span.count(".") >= 3:
            out.add((1, m.start(), m.end()))
        if 12 <= n <= 20:
            out.add((2, m.start(), m.end()))
        if 7 <= n <= 16:
            out.add((3, m.start(), m.end()))
    return out


def ranges(text: str) -> set[tuple[int, int, int]]:
    """(kind, start, end) of the ranges of groups inside the runs of numbers. A range ends before
    its digits are too many for any kind, so that a group starts a bounded number of them."""
    out = set()
    for run in _NUMBER.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, run.start(), run.end())]
        for i, (begin, _) in enumerate(groups):
            n = 0
            start = begin - (begin > run.start() and text[begin - 1] == "(")
            start -= start > run.start() and text[start - 1] == "+"
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 20:
                    break
                end = groups[j][1]
                if j == i + 3 and all(text[a[1] : b[0]] == "." for a, b in zip(groups[i:j], groups[i + 1 : j + 1])):
                    out.add((1, begin, end))
                for first in {begin, start}:
                    if 12 <= n:
                        out.add((2, first, end))
                    if 7 <= n <= 16:
                        out.add((3, first, end))
    return out


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a proposal."""
    span, digits = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - 30) : start], text[end : end + 30]
    word = _WORD_BEFORE.search(before)
    word = word.group(1).lower() if word else ""
    parts = span.split(".")
    largest = max((len(p) if len(p) > 6 else int(p) if p.isascii() and p.isdigit() else 0 for p in parts), default=0)
    return [float(v) for v in (
        *(kind == k for k in range(len(KINDS))),
        len(span), len(digits), luhn(digits), len(parts), largest, span.count(" "), span.count("-"), span.count("("), span.count("/"),
        span.startswith("+"), "@" in span, "(at)" in span.lower() or "[at]" in span.lower(), len(parts[-1]),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in {'"', "'", "=", ":", "#"},
        word in _NOT_PERSONAL, word in _PERSONAL, len(digits_of(before)) + len(digits_of(after)),
    )]


def judge(text: str) -> tuple[list, list]:
    """Accepted base spans, and proposals with label (null where there is none) and description."""
    matches = base_matches(text)
    accepted = {m[:3] for m in matches if m[3]}
    refused = [m for m in matches if not m[3]]
    described = []
    whole = proposals(text)
    for kind, start, end in sorted(whole | ranges(text)):
        label = 1.0 if (kind, start, end) in accepted else 0.0
        hidden = any(a <= start and end <= b and (a, b) != (start, end) for _, a, b, _ in refused)
        spelled = kind == 0 and "@" not in text[start:end]
        part = (kind, start, end) not in whole
        if not label and (hidden or spelled or part):
            label = None
        described.append((kind, start, end, label, describe(text, kind, start, end)))
    return sorted(accepted), described


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
PROPOSAL = pa.struct([*SPAN, ("label", pa.float64()), ("x", pa.list_(pa.float64()))])
JUDGED = "row long, doc_id long, base array<struct<kind:int,start:int,stop:int>>, proposed array<struct<kind:int,start:int,stop:int,label:double,x:array<double>>>"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        base, proposed = [], []
        for text in batch.column(1).to_pylist():
            spans, described = judge(text) if text and (_DIGIT.search(text) or _AT.search(text)) else ([], [])
            base.append([dict(zip(("kind", "start", "stop"), s)) for s in spans])
            proposed.append([dict(zip(("kind", "start", "stop", "label", "x"), d)) for d in described])
        rows = pa.array(range(row, row + batch.num_rows), pa.int64())
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [rows, batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(proposed, pa.list_(PROPOSAL))], names=["row", "doc_id", "base", "proposed"]
        )


def _string_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def _trees(labelled: DataFrame) -> GBTClassificationModel | None:
    """Trees from all the rows given; none where they do not have both labels."""
    if labelled.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(labelled.select("features", "label"))


def _judged_by(model: GBTClassificationModel, proposed: DataFrame) -> DataFrame:
    return model.transform(proposed).withColumn("p", vector_to_array("probability")[1])


def selected(proposed: DataFrame) -> DataFrame:
    """(row, kind, start, stop, p) of the proposals that the trees select. They learn from every labelled
    proposal. The thresholds come from all of them too: those of a fold are judged by trees of the other folds."""
    labelled = proposed.filter("label IS NOT NULL")
    model = _trees(labelled)
    if model is None:
        return proposed.select("row", "kind", "start", "stop", F.lit(0.0).alias("p")).limit(0)
    fold = F.pmod(F.xxhash64("row"), F.lit(FOLDS))
    counts: Counter[tuple[int, int]] = Counter()
    right: Counter[tuple[int, int]] = Counter()
    for k in range(FOLDS):
        others = _trees(labelled.filter(fold != k))
        if others is None:
            continue
        bins = _judged_by(others, labelled.filter(fold == k)).groupBy("kind", F.floor(F.col("p") * 100).cast("int").alias("bin"))
        for r in bins.agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n")).collect():
            counts[r["kind"], r["bin"]] += r["n"]
            right[r["kind"], r["bin"]] += r["right"]
    thresholds = dict.fromkeys(range(len(KINDS)), 2.0)
    for kind in thresholds:
        n = good = 0
        for at in range(100, 49, -1):
            n, good = n + counts[kind, at], good + right[kind, at]
            if counts[kind, at] and good >= PRECISION * n:
                thresholds[kind] = at / 100
    limit = F.array(*[F.lit(thresholds[k]) for k in range(len(KINDS))])[F.col("kind")]
    return _judged_by(model, proposed).filter(F.col("p") >= limit).select("row", "kind", "start", "stop", "p")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): the spans of every document, each struct(kind, start, stop) in order
    of kind and start; ``kind`` counts along ``KINDS``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    judged = settle(rows.mapInArrow(_judged, JUDGED), "pii")
    proposed = judged.select("row", F.explode("proposed").alias("s")).select("row", "s.*").withColumn("features", array_to_vector("x")).drop("x")
    chosen = selected(proposed).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop", "p")).alias("chosen"))
    both = judged.select("row", "doc_id", "base").join(chosen, "row", "left")
    both = both.withColumn("chosen", F.expr("coalesce(filter(chosen, x -> not exists(base, b -> b.start < x.stop and x.start < b.stop)), array())"))
    # the likeliest first; each stays unless it overlaps one that stays
    best = F.expr(
        "aggregate(array_sort(chosen, (x, y) -> CASE WHEN struct(-x.p, x.kind, x.start, -x.stop) < struct(-y.p, y.kind, y.start, -y.stop) THEN -1 ELSE 1 END), "
        "filter(chosen, x -> false), "
        "(kept, x) -> CASE WHEN exists(kept, y -> y.start < x.stop and x.start < y.stop) THEN kept ELSE concat(kept, array(x)) END)"
    )
    added = F.array_sort(F.transform(best, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    return both.select("doc_id", "base", added.alias("added"))


def report(found: DataFrame) -> DataFrame:
    """Counts and spans as text."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_string_of(F.col("base")), 256).alias("base_sha256"),
        _string_of(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(text: str, spans: list) -> str:
    """The text with every span replaced by its kind in brackets. Overlaps are merged."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if end > at:
            out += [text[at:start] if start > at else "", f"[{KINDS[kind]}]" if start >= at else ""]
            at = end
    return "".join(out) + text[at:]
