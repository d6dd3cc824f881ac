"""URL filter, personal data, quality, decontamination and language ID on small and awkward tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from eddyfield.llm import decontaminate, langid, pii, quality, registry, urlfilter
from llm.conftest import paragraph

SF = "/root/testdata/sf0.1"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_rules_and_list(spark):
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/2", "https://x.net/es/", "x.net/es/", None, "http://spam-farm.example.org/a",
            "ftp://notspam-farm.example.org/", "http://x.com", "http://a.b.cheap-pills.example.com?q://z", "http://other.org/bad#f", "http://net/fr/x", "://", "http://é.net/fr/ß"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS entry")
    entries = urlfilter.default_entries(spark).union(spark.createDataFrame([("other.org/bad",), (None,), ("other.org/bad",)], "entry string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) for r in urlfilter.judge(pages, entries).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block", None)
    assert got[1][2:4] == ("www.example.com/en/", "allow") and got[2][2:4] == ("net/es/", "block")
    assert got[3] == got[4] == ("", "", None, "allow", None)
    assert got[5][2:] == (None, "block", "spam-farm.example.org") and got[6][2:] == (None, "allow", None)
    assert got[7] == ("x.com", "", None, "allow", None)
    assert got[8] == ("a.b.cheap-pills.example.com", "", None, "block", "cheap-pills.example.com")
    assert got[9][2:] == (None, "block", "other.org/bad") and got[10][2:4] == ("net/fr/", "block")
    assert got[11][:2] == ("", "") and got[12][2:4] == ("net/fr/", "block")
    assert urlfilter.judge(pages.limit(0)).count() == 0
    none = urlfilter.judge(pages, entries.limit(0))
    assert none.filter("listed IS NOT NULL").count() == 0


def test_collisions_block_nothing():
    index = object.__new__(urlfilter.Index)
    index.digests, index.ends = np.array([5, 5, 9], "int64"), np.array([3, 5, 6], "int64")
    index.strings = np.frombuffer(b"abcdez", "uint8")
    asked = np.array(["de", "abc", "xx", "z", "q"], object)
    assert index.find(np.array([5, 5, 5, 9, 4]), asked).tolist() == [True, True, False, True, False]


def test_segments_in_order(spark):
    entries = spark.range(1000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("entry"))
    names = urlfilter.build_index(entries, 5)
    probe = spark.range(0, 2000, 3).select("id", urlfilter.blocked_by(names, F.array(F.concat(F.lit("h"), "id", F.lit(".org")))).alias("hit"))
    assert all((r["hit"] is not None) == (r["id"] < 1000) for r in probe.collect())


@pytest.mark.parametrize("text", [
    "mail a.b@c.example.com, x@y z@w@v.de @q.de a@b..c", "1.2.3.4.5 999.1.1.1 1.2.3 255.255.255.0", "4111 1111 1111 1111 4111-1111-1111-1111x 42",
    "call +1 (555) 010-9999 or +12 or +49 30 123456 now", "", "é" * 50 + " ü@ü.de a%b@c-d.ef.gh", "1" * 500, "@" * 300, "+" * 100 + "1 2",
])
def test_base_patterns(text):
    patterns = (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)
    want = [(k, m.start(), m.end()) for k, p in enumerate(patterns) for m in p.finditer(text)]
    assert [m[:3] for m in pii.base_matches(text)] == want


def test_luhn():
    for n in range(200):
        digits = f"4{n:014d}"
        assert sum(pii.luhn(digits + str(d)) for d in range(10)) == 1


def test_pii_query_keeps_base_and_adds_little(spark):
    rows = registry.QUERIES["op3_pii"](spark, SF).collect()
    assert len(rows) == 10_000
    base = sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows)
    spans = sum(len(r["spans"].split(",")) for r in rows if r["spans"])
    assert spans == base + sum(r["n_added"] for r in rows) and spans <= 1.02 * base


def test_pii_awkward(documents):
    docs = documents((1, None), (None, "a@b.example.com"), (2, ""), (2, ""), (3, "no digits"), (4, "x@y.example.com and 10.0.0.1"))
    got = pii.report(pii.find(docs)).collect()
    assert len(got) == 6 and sum(r["n_email"] for r in got) == 2 and {r["spans"] for r in got if r["doc_id"] == 4} == {"email:0:15,ip:20:28"}
    assert pii.report(pii.find(docs.limit(0))).count() == 0
    assert pii.redact("call +49 now, a@b.de", [(3, 5, 8), (0, 14, 20)]) == "call [phone] now, [email]"


@pytest.mark.parametrize(("text", "want"), [
    ("555-123-4567 555-123-4568", {(3, 0, 12), (3, 13, 25)}),
    ("2024-05-01 555-123-4567", {(3, 11, 23)}),
    ("2024-05-01 (555) 123-4567 8", {(3, 11, 25), (3, 12, 25)}),
    ("4111 1111 1111 1111 5500 0000 0000 0004", {(2, 0, 19), (2, 20, 39)}),
    ("555 1234 4111 1111 1111 1111", {(3, 0, 8), (2, 9, 28)}),
    ("+1 555 123 4567 555 123 4568", {(3, 0, 15), (3, 16, 28)}),
    ("7 10.0.0.1.10.0.0.2", {(1, 2, 10), (1, 11, 19)}),
])
def test_numbers_beside_numbers_are_proposed(text, want):
    assert want <= {d[:3] for d in pii.judge(text)[1]}


def test_ranges_grow_with_the_text_only():
    assert len(pii.ranges("1 " * 4000)) <= 2.2 * len(pii.ranges("1 " * 2000)) and len(pii.ranges("1 " * 4000)) <= 40 * 4000


def test_cards_in_a_row_are_all_found(documents):
    rng = random.Random(2)

    def card(right: bool) -> str:
        body = f"4{rng.randrange(10**14):014d}"
        digits = next(body + str(d) for d in range(10) if pii.luhn(body + str(d)) == right)
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4))

    docs = documents(
        *[(i, f"word {card(i % 2 == 0)} word") for i in range(3000)],
        (9000, f"word {card(True)} {card(True)} word"),
        (9001, f"word 555 1234 {card(True)} word"),
    )
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["added"]] for r in pii.find(docs).filter("doc_id >= 9000").collect()}
    assert got[9000] == [(2, 5, 24), (2, 25, 44)] and (2, 14, 33) in got[9001]


def test_trees_and_thresholds_see_every_labelled_proposal(spark, monkeypatch):
    """Also of 60,000, and of a kind that only a handful of them has."""
    label = F.when(F.col("kind") == 3, 1.0).otherwise((F.col("id") % 2).cast("double"))
    rows = spark.range(60_000).withColumn("kind", F.when(F.col("id") % 6000 == 1, 3).otherwise(2)).withColumn("label", label)
    rows = rows.select(F.col("id").alias("row"), "kind", F.lit(0).alias("start"), F.lit(9).alias("stop"), "label", array_to_vector(F.array("label")).alias("features"))
    seen, fit = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    chosen = pii.selected(rows)
    assert max(seen) == 60_000 and sum(seen) == 2 * 60_000
    assert chosen.filter("kind = 3").count() == 10 and chosen.filter("kind = 2").count() == 29_990


def test_quality_held_out(spark):
    scored = registry.QUERIES["op4_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = scored.filter("held_out").collect()
    assert all(held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    for label in (0, 1):
        of = [r for r in rows if r["quality"] == label]
        assert sum(r["predicted"] == label for r in of) >= 0.95 * len(of)


def test_quality_awkward(spark, documents):
    docs = documents((1, None), (2, ""), (None, "a b c"), (3, "x" * 200_000), (3, "\n\n"))
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    measured = quality.measure(docs)
    scores = measured.select("doc_id", quality.score_of(quality.learn(measured, labels)).alias("s")).collect()
    assert len(scores) == 5 and all(0 <= r["s"] <= 1 for r in scores)
    empty = quality.measure(docs.limit(0))
    assert empty.select(quality.score_of(quality.learn(empty, labels)).alias("s")).count() == 0


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)  # neither feature tells alone
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    once = model.intercept + sum(t[b] for t, b in zip(model.tables, model.bins(x[:1])[0]))
    once += sum(t[model.bins(x[:1])[0, i] // 4, model.bins(x[:1])[0, j] // 4] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-once)))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = registry.QUERIES["op9_language_id"](spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert all(held_out(r["doc_id"]) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)


def test_language_backoff(documents):
    german, english = "der die das und nicht mit einer straße", "the that with and not this from other"
    ids = [i for i in range(60) if not held_out(i)]
    docs = documents(*[(i, german if i % 2 else english, "de" if i % 2 else "en") for i in ids], (999, None, "xx"), (998, "la", None))
    model = langid.learn(docs)
    assert model.languages == ["de", "en"]
    asked = documents((1, "die Straßen"), (2, "others"), (3, None), (4, "123 !!!"), (5, ""), (6, "q" * 50_000), (None, "the"))
    got = {r["doc_id"]: r["j"] for r in asked.select("doc_id", langid.detect(asked, model).alias("j")).collect()}
    assert got[1]["lang"] == "de" and got[2]["lang"] == "en" and got[None]["lang"] == "en"
    assert all(got[i]["lang"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5)) and got[6]["lang"] in ("de", "en")
    nothing = langid.learn(docs.limit(0))
    assert {r["j"]["lang"] for r in asked.select(langid.detect(asked, nothing).alias("j")).collect()} == {"und"}


def test_alignment_by_brute_force():
    """Smith-Waterman against the plain recurrence."""
    rng = random.Random(3)
    for _ in range(30):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        table, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
                best = max(best, table[i][j])
        assert decontaminate.align(np.array(a, "uint64"), np.array(b, "uint64"))[0] == best


def test_leaks(spark, documents):
    item = paragraph(1, 40).split()
    edited = [w if i % 6 else "changed" for i, w in enumerate(item)]
    docs = documents(
        (1, paragraph(2, 300) + " " + " ".join(item).upper() + "! " + paragraph(3, 50)),
        (2, "* " + " | ".join(edited)),
        (3, " ".join(item[:12]) + " " + paragraph(4, 100)),
        (4, paragraph(5, 200)), (5, None), (6, ""), (None, " ".join(item)), (7, " ".join(item) + " " + " ".join(item)), (8, "tiny item"),
    )
    benchmark = spark.createDataFrame([(10, " ".join(item)), (11, paragraph(9, 30)), (12, None), (13, "tiny item"), (14, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (1, 2, 7, None) for i in (10, 14)}
    whole = next(r for r in got if r["doc_id"] == 1 and r["item_id"] == 10)
    assert whole["score"] == 1.0 and (whole["start"], whole["stop"]) == (300, 340)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs.filter("doc_id IS NOT NULL"), benchmark).collect()) == [3, 4, 5, 6, 8]
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_blocks_of_items(spark):
    benchmark = spark.createDataFrame([(i, paragraph(i, 8)) for i in range(30)], "item_id long, text string")
    parts = list(decontaminate.blocks_of(benchmark, size=7))
    assert len(parts) == 5 and sorted(i for b in parts for i in b.ids) == list(range(30))


def test_an_item_in_every_document_is_still_found(spark, documents):
    item = paragraph(1, 30)
    docs = documents(*[(i, paragraph(100 + i, 30) + " " + item) for i in range(200)])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contaminated(docs, benchmark).count() == 200


@pytest.mark.parametrize("copies", [4, 50])
def test_an_edited_item_in_many_documents_is_still_found(spark, documents, copies):
    """Every 4th or 5th word replaced: most seeds of the item occur nowhere, the rest in many documents."""
    items = {k: paragraph(k, 30).split() for k in (4, 5)}
    edited = {k: " ".join(w if i % k else f"changed{i}" for i, w in enumerate(item)) for k, item in items.items()}
    fragment = paragraph(6, 30).split()
    docs = documents(*[(100 * k + i, paragraph(1000 * k + i, 20) + " " + text) for k, text in [*edited.items(), (6, " ".join(fragment[:15]))] for i in range(copies)])
    benchmark = spark.createDataFrame([(k, " ".join(item)) for k, item in [*items.items(), (6, fragment)]], "item_id long, text string")
    want = {(100 * k + i, k) for k in (4, 5, 6) for i in range(copies)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()} == want
    assert decontaminate.clean(docs, benchmark).count() == 0


def test_the_bound_in_front_of_alignment_is_never_below_the_score():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 9, rng.integers(1, 25)).astype("uint64") for _ in range(2))
        assert decontaminate.bound(a, b) >= decontaminate.align(a, b)[0]


@pytest.mark.parametrize("text", ["a@b.²", "0" * 5000 + ".1.1.1", "1." + "0" * 5000 + "5.1.1", "²³.½.¹.⁴ 1.²", "1" * 100_000, "1" * 40_000 + ".2", "9 " * 2000])
def test_odd_numbers_do_not_break_the_search(text):
    want = [(k, m.start(), m.end()) for k, p in enumerate((pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)) for m in p.finditer(text[:6000])]
    assert [m[:3] for m in pii.base_matches(text[:6000])] == want
    accepted, described = pii.judge(text)
    assert all(len(d[4]) == len(described[0][4]) for d in described)


def test_leading_zeros_of_an_address():
    accepted = [m[:3] for m in pii.base_matches("0" * 5000 + "9.1.1.1 300.1.1.1 0.0.0.0000 0256.1.1.1") if m[3]]
    assert accepted == [(1, 0, 5007), (1, 5018, 5028)]


def test_span_survives_a_rival_that_falls_itself(documents, monkeypatch):
    """Of A > B > C, where B overlaps both others, A and C stay."""
    docs = documents((1, "aaaa@ bbbb 7 cccc"))
    spans = [(3, 0, 4, 0.9), (3, 3, 8, 0.8), (3, 7, 12, 0.7), (3, 12, 14, 0.7), (2, 12, 14, 0.7)]

    seen = {}

    original = pii.settle

    def settle(df, name):
        out = original(df, name)
        seen["rows"] = out.select(pii.F.lit(1).alias("dummy"), pii.F.col("row").alias("at"))
        return out

    monkeypatch.setattr(pii, "settle", settle)

    def selected(proposed):
        rows = proposed.sparkSession.createDataFrame([(1, *s) for s in spans], "dummy int, kind int, start int, stop int, p double")
        return rows.join(seen["rows"], "dummy").select(pii.F.col("at").alias("row"), "kind", "start", "stop", "p")

    monkeypatch.setattr(pii, "selected", selected)
    added = pii.find(docs).first()["added"]
    assert [tuple(s) for s in added] == [(2, 12, 14), (3, 0, 4), (3, 7, 12)]


def test_number_signs_are_no_letters(documents):
    docs = documents(*[(i, text, lang, "s") for i in range(60) for text, lang in [("der hund und die katze", "de"), ("the dog and the cat", "en")]])
    model = langid.learn(docs)
    odd = documents((1, "½ ²"), (2, "Ⅷ ①"), (3, "½ the dog"), (4, "1 2 _"), (5, "the dog " * 40_000))
    got = {r["doc_id"]: r["j"] for r in odd.select("doc_id", langid.detect(odd, model).alias("j")).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "en", "und", "en"] and got[1]["score"] == 0


def test_a_rare_language_is_learned(documents):
    """Also where the sample holds a small share of the others."""
    docs = documents(*[(i, "the dog and the cat", "en", "s") for i in range(3000)], *[(5000 + i, "der hund und die katze", "de", "s") for i in range(6)])
    assert langid.learn(docs, max_rows=20).languages == ["de", "en"]


def test_few_texts_at_once_wait_for_decontamination(spark, documents, monkeypatch):
    """Whatever the session allows, a bounded number of texts is handed over together, and rows are whole after it."""
    seen, item = [], paragraph(1, 30)
    rows = [(i, paragraph(i, 5) if i % 3 else item, None, f"s{i}") for i in range(2, 40)] + [(None, item), (None, None), (3, paragraph(3, 5))]
    docs = documents(*rows).coalesce(1)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    original = decontaminate.leaks_in

    def batches(docs, block):
        limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        seen.append(int(limit))
        return original(docs, block)

    monkeypatch.setattr(decontaminate, "leaks_in", batches)
    got = decontaminate.clean(docs, benchmark)
    assert got.columns == docs.columns
    want = sorted((str(r[0]), str(r[1])) for r in rows if r[1] != item)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()  # no row waits for Python beside its text
    assert decontaminate.contaminated(docs, benchmark).count() == 14
    assert seen[-1] <= decontaminate.ROWS_PER_BATCH


def test_the_language_model_is_shared_by_its_detector():
    model = langid.Model(["a", "b"], {"one": 0, "two": 1}, [{} for _ in range(langid.LONGEST)], np.array([[-1, -2], [-3, -1]], "float32"))
    model.grams[0] = {"x": 0}
    detector = langid._Detector(model)
    got = [detector(" ".join(["one", *(f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(n))])) for n in (0, 3, 1500, 3)]
    assert not np.shares_memory(detector.table, model.table) and len(model.words) == 2 and len(detector.unseen) == 1500
    assert {g[0] for g in got} == {"a"} and got[1] == got[3]
