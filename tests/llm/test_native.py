"""Mixing, line dedup, exact dedup and sharding on small and awkward tables."""

from __future__ import annotations

import math
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from eddyfield.llm import exactdedup, linededup, mixing, registry, sharding
from eddyfield.llm.components import components
from eddyfield.session import new_path
from llm.conftest import paragraph


def test_exact_groups(documents):
    rows = documents((3, "a  b"), (1, "a\tb"), (2, "a b "), (2, "a b "), (9, None), (8, ""), (None, "a b"), (7, "x" * 300 + "1"), (6, "x" * 300 + "2"))
    found = {}
    for r in exactdedup.exact_groups(rows, digest_all=True).collect():
        found.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert found[1] == [(1, 3, True)] and found[3] == [(1, 3, False)] and found[None] == [(1, 3, False)]
    assert sorted(found[2]) == [(2, 2, False), (2, 2, True)]  # one of two like rows stays
    assert found[9] == [(8, 2, False)] and found[8] == [(8, 2, True)]
    assert found[7] == [(7, 1, True)] and found[6] == [(6, 1, True)]  # one prefix, other texts
    lone = {r["doc_id"]: r["digest"] for r in exactdedup.exact_groups(rows).collect()}
    assert lone[2] is not None and exactdedup.exact_groups(documents((1, "a"))).first()["digest"] is None
    assert exactdedup.exact_groups(rows.limit(0)).count() == 0


def test_extra_columns(spark, documents):
    odd = documents((1, "a b"), (2, "a b")).selectExpr("*", "1 AS n", "'x' AS head", "2 AS keep_id", "3 AS copies", "4 AS shard", "5 AS line")
    assert exactdedup.exact_groups(odd).count() == 2
    assert sharding.assign(odd).count() == 2
    assert linededup.line_groups(odd).filter("kept").count() == 1
    rows, sources = mixing.plan(odd)
    assert mixing.draw(odd, sources).columns[:-1] == odd.columns


def test_sharding_laws(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = registry.QUERIES["op7_sharding"](spark, sf_dir).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) for r in rows)
    sizes, slots, shard_of = Counter(), {}, {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert shard_of.setdefault(docs[r["doc_id"]], r["shard"]) == r["shard"]
    assert sorted(sizes) == list(range(8))
    assert max(sizes.values()) <= 1.01 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_rebalancing_moves_few_slots(spark, documents):
    docs = documents(*[(i, paragraph(i, 5 + i % 40)) for i in range(3000)])
    rows = sharding.records(docs)
    path = new_path(spark, "map")
    first = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(rows, path, 8).collect()}
    second = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(rows, path, 8).collect()}
    assert first == second and len(first) == sharding.SLOTS
    grown = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(rows, path, 9).collect()}
    moved = [s for s in first if first[s] != grown[s]]
    # the new shard is filled up; a few more moves level what is left
    assert sum(grown[s] == 8 for s in moved) >= 0.9 * len(moved) and len(moved) < 0.2 * sharding.SLOTS
    assert sorted(r[0] for r in spark.read.parquet(path).select("version").distinct().collect()) == [1, 2, 3]
    gone = {r["virtual_slot"]: r["shard"] for r in sharding.rebalance(rows, path, 8).collect()}
    assert set(gone.values()) == set(range(8))


def test_sharding_awkward(documents):
    rows = documents((None, None), (None, None), (1, ""), (1, "a"), (2, "b" * 100_000))
    placed = sharding.assign(rows).collect()
    assert len(placed) == 5 and sorted(r["size"] for r in placed) == [1, 1, 1, 2, 100_001]
    hot = sharding.assign(documents(*[(i, "the same text") for i in range(400)])).collect()
    assert max(Counter(r["shard"] for r in hot).values()) < 70  # a text that is too heavy is spread
    assert sharding.assign(rows.limit(0)).count() == 0


def test_mixing(documents):
    docs = documents(*[(i, paragraph(i, 10), None, "big" if i < 80 else "small" if i < 95 else None) for i in range(100)], (100, None, None, "none"))
    mix = mixing.Mix(entropy_share=0.95, max_epochs=100.0, block_tokens=100)
    rows, sources = mixing.plan(docs, mix)
    table = {r["source"]: r for r in sources.collect()}
    weights = [r["weight"] for r in table.values() if r["weight"] > 0]
    entropy = -sum(w * math.log(w) for w in weights)
    assert abs(entropy - 0.95 * math.log(3)) < 1e-4 and abs(sum(weights) - 1) < 1e-8
    times = Counter(r["doc_id"] for r in mixing.draw(rows, sources, mix).collect())
    assert set(times) == set(range(101))  # none is lost
    drawn = mixing.blocks(rows, sources, mix)
    assert drawn.count() == sum(times.values())
    per = {r["source"]: r["t"] for r in drawn.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    for name, r in table.items():
        assert abs(per[name] - r["quota"]) <= 10
    whole = drawn.groupBy("block", "source").agg(F.sum("tokens").alias("t")).filter("source = 'big'").collect()
    assert all(abs(r["t"] - 100 * table["big"]["weight"]) <= 20 for r in whole if r["block"] < max(w["block"] for w in whole))


def test_mixing_limits(documents):
    docs = documents(*[(i, paragraph(i, 10), None, "big" if i < 97 else "small") for i in range(100)])
    _, sources = mixing.plan(docs, mixing.Mix(entropy_share=1.0, max_epochs=2.0))
    small = sources.filter("source = 'small'").first()
    assert small["quota"] / small["source_tokens"] == pytest.approx(2.0, abs=0.05)
    rows, few = mixing.plan(docs, mixing.Mix(budget=200))
    assert 150 <= mixing.draw(rows, few, mixing.Mix(budget=200)).agg(F.sum("tokens")).first()[0] <= 220
    rows, none = mixing.plan(docs.limit(0))
    assert mixing.blocks(rows, none).count() == 0
    rows, one = mixing.plan(documents((1, "", None, None), (None, None, None, None)))
    assert mixing.draw(rows, one).count() == 2


def test_running_total(spark):
    from eddyfield.llm import common

    rows = spark.range(20_000).select("id", (F.col("id") % 3 == 0).alias("k"), common.id_hash(F.col("id")).alias("u"))
    got = common.running_total(rows, "k", "u", F.col("id"), "before").collect()
    for key in (True, False):
        total = 0
        for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["u"]):
            assert r["before"] == total
            total += r["id"]


def test_sieve(spark):
    from eddyfield.llm import common

    keys = spark.range(0, 5000, 7)
    passed = spark.range(5000).filter(common.sieve(keys, "id")(F.col("id"))).count()
    assert len(range(0, 5000, 7)) <= passed <= len(range(0, 5000, 7)) + 20


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 5), (9, 7), (7, 8), (3, 4), (4, 9)]])
def test_components(spark, links):
    table = spark.createDataFrame(links, "a long, b long")
    parent = {n: n for e in links for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {r["node"]: r["component"] for r in components(table).collect()} == {n: root(n) for n in parent}


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_groups(documents):
    long = paragraph(1, 120).split()
    near = [*long[:60], "other", *long[61:]]
    far = [*long[:60], *paragraph(2, 60).split()]
    docs = documents(
        (1, " ".join(long) + "\n!!!\nshort line"),
        (2, "SHORT,  line\n" + " ".join(near).upper()),
        (3, " ".join(far) + "\n"),
        (4, None), (5, ""), (6, "short line\nshort line"), (None, "short line"),
    )
    got = {(r["doc_id"], r["line_no"]): r for r in linededup.line_groups(docs).collect()}
    assert len(got) == 12 - 1 + 1 - 1 and (4, 0) not in got
    assert got[(1, 0)]["kept"] and not got[(2, 1)]["kept"] and got[(2, 1)]["group_id"] == got[(1, 0)]["group_id"]
    assert got[(3, 0)]["kept"] and got[(1, 1)]["kept"] and got[(5, 0)]["kept"] and got[(3, 1)]["kept"]
    short = [k for k, r in got.items() if r["group_id"] == got[(1, 2)]["group_id"]]
    assert len(short) == 5 and [k for k in short if got[k]["kept"]] == [(1, 2)] and got[(1, 2)]["group_size"] == 5
    assert {r["doc_id"]: r["text"] for r in linededup.without_repeats(docs).collect()}[1] == " ".join(long) + "\n!!!\nshort line"
    assert linededup.line_groups(docs.limit(0)).count() == 0


def test_line_links_are_right_and_mostly_found(spark):
    """Against brute force over the lines of 8 to 80 words: every linked pair is similar; recall by distance."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = linededup.lines_of(docs).filter("norm <> ''").select("doc_id", "line_no", F.xxhash64("norm").alias("line"), "norm")
    group = {r["line"]: r["group_id"] for r in lines.join(linededup.line_groups(docs), ["doc_id", "line_no"]).select("line", "group_id").distinct().collect()}
    texts = sorted((r["norm"].split(), r["line"]) for r in lines.select("line", "norm").distinct().collect() if 8 <= len(r["norm"].split()) <= 80)
    by_word: dict[str, list[int]] = {}
    pairs = Counter()
    for i, (words, _) in enumerate(texts):
        for w in set(words):
            for j in by_word.get(w, []):
                pairs[(j, i)] += 1
            by_word.setdefault(w, []).append(i)
    prints = {r["line"]: (r["print0"], r["print1"]) for r in linededup.prints(lines.select("line", "norm").distinct()).collect()}
    found, total, missed = Counter(), Counter(), 0
    for (i, j), shared in pairs.items():
        longer = max(len(texts[i][0]), len(texts[j][0]))
        if shared < 0.5 * longer or (edits := edit_distance(texts[i][0], texts[j][0])) > longer // 5:
            continue
        a, b = texts[i][1], texts[j][1]
        share = "5 %" if edits <= 0.05 * longer else "10 %" if edits <= 0.1 * longer else "20 %"
        total[share] += 1
        found[share] += group[a] == group[b]
        apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(prints[a], prints[b]))
        missed += apart < linededup.BLOCKS and group[a] != group[b]
    print("line links together, by share of edited words:", {k: (found[k], total[k]) for k in total})
    assert missed == 0  # what the pigeonhole principle promises
    assert total["5 %"] == 0 or found["5 %"] >= 0.6 * total["5 %"]


def test_every_line_link_is_found(documents):
    """Brute force over lines with edits up to the limit, of few and of many words, also of four against five."""
    rng = np.random.default_rng(8)
    lines = []
    for n in [4, 5, 6, 9, 10, 14, 19, 24, 40, 60] * 4:
        words = [f"v{i}" for i in rng.integers(0, 60, n)]
        lines.append(words)
        for edits in {1, (n + 1) // 5, n // 5, n // 5 + 1}:
            other = list(words)
            for _ in range(edits):
                at = int(rng.integers(0, len(other)))
                kind = rng.integers(0, 3)
                other[at : at + (kind != 2)] = [] if kind == 0 else [f"v{rng.integers(0, 60)}"]
            lines.append(other)
    lines += [["p", "q"] * 5, ["p", "q"] * 3 + ["r", "q"] + ["p", "q"], ["p"] * 10, ["p"] * 8 + ["s", "s"]]
    lines = sorted({" ".join(words) for words in lines})
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(lines):
        for j in range(i):
            a, b = x.split(), lines[j].split()
            if edit_distance(a, b) <= max(len(a), len(b)) // 5:
                root[top(i)] = top(j)
    docs = documents(*enumerate(lines))
    got = {r["doc_id"]: r["group_id"] for r in linededup.line_groups(docs).collect()}
    first: dict[int, int] = {}
    assert [top(i) for i in range(len(lines))] == [top(first.setdefault(got[i], i)) for i in range(len(lines))]
    assert len(set(got.values())) == len({top(i) for i in range(len(lines))})


def test_line_groups_hold_no_shuffle_files_and_few_tables(spark, documents, monkeypatch):
    """The shuffle files of a step go when it ends, and tables that nothing reads any more go too."""
    rng = np.random.default_rng(3)
    docs = documents(*[(i, "\n".join(" ".join(f"v{j}" for j in rng.integers(0, 300, 12)) for _ in range(20))) for i in range(40)])
    settle = linededup.settle
    folders = [Path(str(d)) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for folder in folders for f in folder.rglob("shuffle_*")}

    held, made = [], []

    def watched(df, name):
        before = shuffles()
        made.append(settle(df, name))
        for _ in range(100):  # the executors remove them a moment later
            if not shuffles() - before:
                break
            time.sleep(0.1)
        held.append((name, len(shuffles() - before)))
        return made[-1]

    monkeypatch.setattr(linededup, "settle", watched)
    assert linededup.line_groups(docs).count() == 800
    # a task that Spark gave up may still write one
    assert len(held) > 15 and sum(files for _, files in held) <= 8
    there = [Path(f.removeprefix("file:")).exists() for table in made for f in table.inputFiles()[:1]]
    assert there.count(False) >= 7


def test_line_blocks_meet_part_by_part(documents, monkeypatch):
    """No table holds the members of all blocks at once, and each goes before the next is made."""
    rng = np.random.default_rng(5)
    docs = documents(*[(i, " ".join(f"v{j}" for j in rng.integers(0, 60, 12))) for i in range(400)])
    settle, sizes, tables = linededup.settle, [], []

    def watched(df, name):
        table = settle(df, name)
        if name == "told_members":
            assert not any(Path(f.removeprefix("file:")).exists() for f in tables)
            sizes.append(table.count())
            tables.extend(table.inputFiles())
        return table

    monkeypatch.setattr(linededup, "settle", watched)
    assert linededup.line_groups(docs).count() == 400
    assert min(sizes) > 0 and max(sizes) <= 0.5 * sum(sizes)


def test_line_prints_of_few_and_many_words(spark):
    """Each bit by its own counter, also where the words fill or overflow the packed ones."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{j}" for j in rng.integers(0, 9, n)) for n in (1, 2, 3, 4, 63, 126, 127, 128, 129, 254, 255, 700, 40_000)]
    texts += [" ".join(["a"] * n) for n in (127, 128, 5000)]
    lines = spark.createDataFrame(list(enumerate(texts)), "line long, norm string")
    words = lines.select("line", F.explode(F.split("norm", " ")).alias("word")).select("line", F.xxhash64("word"), F.xxhash64("word", F.lit(1)))
    hashes: dict[int, list] = {}
    for line, *pair in words.collect():
        hashes.setdefault(line, []).append([h % 2**64 for h in pair])
    rows = {r["line"]: r for r in linededup.prints(lines).collect()}
    assert len(rows) == len(texts)
    for line, pairs in hashes.items():
        assert rows[line]["words"] == len(pairs)
        for half in range(2):
            bits = sum(1 << b for b in range(64) if 2 * sum(p[half] >> b & 1 for p in pairs) > len(pairs))
            assert rows[line][f"print{half}"] % 2**64 == bits
        odd = [0] * linededup.BAGS
        for h, _ in pairs:
            odd[h >> 6 & 3] ^= 1 << (h & 63)
        assert [rows[line][f"bag{k}"] % 2**64 for k in range(linededup.BAGS)] == odd
