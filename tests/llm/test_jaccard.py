"""The Jaccard join against brute force, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eddyfield.llm import jaccard
from llm.conftest import paragraph


def sets_of(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows: list[tuple]) -> dict:
    """Smallest id of each component."""
    sets = {i: sets_of(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(words: list[str], changes: int, rng: random.Random) -> str:
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, documents, monkeypatch, seed):
    """Families of copies around the limit, passages that many share, and boxes of every kind."""
    monkeypatch.setattr(jaccard, "COMMON", 6)
    monkeypatch.setattr(jaccard, "PAIRED", 4)
    rng = random.Random(seed)
    rows = []
    passage = paragraph(7, 60)
    for family in range(6):
        base = paragraph(1000 + family, 60 + 40 * family).split()
        rows += [edited(base, rng.randrange(0, 6), rng) for _ in range(25)]
    rows += [passage + " " + paragraph(2000 + i, 25) for i in range(40)]
    rows += [" ".join(paragraph(3000 + i, rng.randrange(1, 9)).split()[: rng.randrange(1, 9)]) for i in range(20)]
    rows += [None, "", " \t\n", "One two", "one\ttwo", "a b c d e f g h", "a b c d e f g h i", "x", "X"]
    rng.shuffle(rows)
    numbered = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(documents(*numbered)).collect()}
    assert got == brute_force(numbered)


def test_awkward(spark, documents):
    docs = documents((5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (9, None), (9, "z z z z z z z"), (8, "z z z z z z z"))
    rows = [tuple(r) for r in jaccard.near_groups(docs.selectExpr("*", "1 AS n", "2 AS point", "3 AS box")).collect()]
    assert sorted(rows, key=str) == sorted([(5, 2, 3), (5, 2, 3), (None, 2, None), (3, 2, 3), (9, 0, 8), (9, 1, 8), (8, 1, 8)], key=str)
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in jaccard.representatives(docs).collect() if r["doc_id"] is not None)
    assert [k[1] for k in kept] == [3, 8] and jaccard.representatives(docs).filter("doc_id IS NULL").count() == 1
    assert jaccard.near_groups(docs.limit(0)).count() == 0


def test_a_doc_id_with_several_texts_links_by_each(documents):
    """The text of another row of the same doc_id never stands in for the one that links."""
    texts = {k: paragraph(500 + k, 60) for k in range(12)}
    docs, want = [], {}
    for k, text in texts.items():
        other = None if k % 3 == 0 else paragraph(700 + k, 20 + k)
        rows = [(10 + k, other), (10 + k, text)]
        docs += [*(rows if k % 2 else rows[::-1]), (100 + k, text + " extra")]
        want |= {10 + k: 10 + k, 100 + k: 10 + k}
    table = documents(*docs)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(table).collect()} == want
    kept = {(r["doc_id"], r["text"]) for r in jaccard.representatives(table).collect()}
    assert kept == {d for d in docs if d[0] < 100}


def test_near_texts_of_one_doc_id_stay_once(documents):
    near, other = paragraph(1, 60), paragraph(2, 60)
    docs = documents((1, near + " extra"), (1, other), (1, near), (1, near), (2, "other words here"))
    assert sorted((r["doc_id"], r["text"]) for r in jaccard.representatives(docs).collect()) == [(1, near), (1, other), (2, "other words here")]


def test_a_row_that_comes_twice_stays_once(documents):
    docs = documents((1, "a b c d e f"), (1, "a b c d e f"), (2, "other words here"))
    assert sorted(r["doc_id"] for r in jaccard.representatives(docs).collect()) == [1, 2]


def test_lead_holds_for_all_sizes():
    for n in range(1, 3000):
        assert jaccard.lead(n) == n - -(-8 * n // 10) + 1


def test_pipeline(spark, tmp_path, documents):
    """Stage by stage: columns stay, planted cases go, clean documents stay."""
    item = paragraph(1, 40)
    clean = [(i, paragraph(100 + i, 80), "en", "big" if i % 3 else "small") for i in range(60)]
    docs = documents(*clean, (70, clean[0][1] + " extra", "en", "big"), (71, clean[1][1], "en", None), (72, None, None, None), (73, "!!! 123", "en", "big"), (74, paragraph(9, 50) + " " + item, "en", "big"))
    odd = docs.selectExpr("*", "1 AS score", "'x' AS lang_pred", "2 AS epoch", "3 AS n")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = spark.createDataFrame(stage(spark, odd, str(tmp_path)).collect(), odd.schema)
        left.append({r["doc_id"] for r in odd.select("doc_id").collect()})
        assert odd.columns == [*docs.columns, "score", "lang_pred", "epoch", "n"]
    everything = set(range(60))
    assert left == [everything | {70, 71, 74}, everything | {74}, everything, everything]
    assert odd.count() >= 60  # the small source is repeated
    last = corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path))
    assert last.count() == odd.count() and last.select(F.max("shard")).first()[0] == 7
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fine_counts_bound_what_is_shared():
    """Never below the shared shingles, and far below the need for unrelated texts, at every size and ratio of sizes."""
    rng = np.random.default_rng(6)
    for n in (1, 5, 60, 64, 700, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype="uint64"))
        for share in (0.0, 0.5, 0.9, 1.0):
            for m in {n, max(1, int(0.8 * n)), int(1.25 * n)}:
                kept = x[: int(share * min(n, m))]
                y = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, m - len(kept), dtype="uint64")]))
                both = len(np.intersect1d(x, y))
                row = [pa.array([v]) for v in (1, 2, len(x), len(y))] + [pa.array([jaccard.fine_counts(v)]) for v in (x, y)]
                passed = sum(b.num_rows for b in jaccard._finely(iter([pa.RecordBatch.from_arrays(row, names=list("abcdef"))])))
                linked = 100 * both >= 80 * (len(x) + len(y) - both)
                assert passed or not linked
                assert not passed or share > 0 or n < 60


def test_a_count_beyond_a_byte_passes():
    s = np.arange(300, dtype="uint64") << np.uint64(20)
    assert jaccard.fine_counts(s) == b""
    row = [pa.array([v]) for v in (1, 2, 300, 300)] + [pa.array([b""]), pa.array([jaccard.fine_counts(s + np.uint64(1))])]
    assert [b.num_rows for b in jaccard._finely(iter([pa.RecordBatch.from_arrays(row, names=list("abcdef"))]))] == [1]


def test_what_a_task_remembers_is_bounded_by_bytes():
    """Sets of long texts, too, and many words."""
    held = jaccard._Held()
    for point in range(300):
        held[point] = np.zeros(20_000)
        assert sum(a.nbytes for a in held.values()) <= jaccard.HELD
    assert 299 in held
    hashes = jaccard._Hashes()
    jaccard.shingles(" ".join(map(str, range(3 * jaccard._Hashes.MOST))).encode(), hashes)
    assert len(hashes) == jaccard._Hashes.MOST


def test_few_texts_go_to_python_at_once(documents, monkeypatch):
    docs = documents(*[(i, f"a b c d e f{i}") for i in range(20)])
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, points = docs.sparkSession.conf.get(name), jaccard.points
    monkeypatch.setattr(jaccard, "points", lambda docs: seen.append(docs.sparkSession.conf.get(name)) or points(docs))
    assert jaccard.near_groups(docs).count() == 20
    assert seen == [str(jaccard.ROWS_PER_BATCH)] and docs.sparkSession.conf.get(name) == before
