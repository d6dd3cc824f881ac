"""Clustering, SimHash and hard negatives against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eddyfield.llm import clustering, negatives, queries, simhash  # noqa: F401
from eddyfield.llm.registry import QUERIES

EMBEDDINGS = "vec_id long, embedding array<double>, label int, row string, fp int"


def brute_kmeans(rows, k=40, rounds=5, width=64):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centroids[n] = [sum(column) // len(members) for column in zip(*members)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    return placed, centroids


def test_lists_equal_brute_force_with_ties_and_wide_numbers():
    rng = np.random.default_rng(3)
    for reach in (3, 200, 1 << 40):
        centroids = rng.integers(-reach, reach + 1, (17, 8))
        centroids[9] = centroids[4]
        vectors = np.concatenate([rng.integers(-reach, reach + 1, (1500, 8)), centroids])
        distance = ((vectors[:, None].astype(object) - centroids[None]) ** 2).sum(axis=2)
        who, best, looked = clustering.Lists(centroids).nearest(vectors)
        assert (who == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
        assert looked <= 17 * len(vectors)


def test_walk_stops_early():
    """Where clusters lie apart, most distances are never worked out."""
    rng = np.random.default_rng(4)
    centroids = np.arange(40)[:, None] * 1000 + rng.integers(0, 100, (40, 64))
    vectors = centroids[rng.integers(0, 40, 2000)] + rng.integers(-20, 20, (2000, 64))
    assert clustering.Lists(centroids).nearest(vectors)[2] <= 3 * len(vectors)


def test_clusters_of_small_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3)], None, "r", i) for i in range(60)]
    rows += [(7, rows[7][1], 1, "r", 0), (None, [1.0, 2.0, 3.0], 1, "", 1), (91, None, 1, "", 1), (92, [], 1, "", 1), (93, [1.0, None, 2.0], 1, "", 1)]
    rows += [(94, [1.0, float("nan"), 2.0], 1, "", 1), (95, [1.0, float("inf"), 2.0], 1, "", 1), (96, [1.0] * 4, 1, "", 1), (97, [3e30, -3e30, 0.0], 1, "", 1)]
    df = spark.createDataFrame(rows, EMBEDDINGS)
    got = clustering.cluster(df, centroids=5, width=3).collect()
    want, centroids = brute_kmeans([(r[0], [min(max(x, -(2.0**54)), 2.0**54) for x in r[1]] if r[0] == 97 else r[1]) for r in rows], 5, 5, 3)
    assert sorted((r["vec_id"] or -1, r["cluster"], r["distance"]) for r in got) == sorted((i or -1, c, min(d, 2**63 - 1)) for i, c, d in want)
    digest = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(centroids)}
    assert all(r["centroid_sha256"] == digest[r["cluster"]] for r in got)
    assert {r["inertia"] for r in got} == {min(sum(d for _, _, d in want), 2**63 - 1)}
    few = clustering.cluster(df.filter("vec_id < 3"), width=3).collect()
    assert sorted(r["distance"] for r in few) == [0, 0, 0]
    assert clustering.cluster(df.limit(0), width=3).count() == 0
    assert clustering.cluster(df.filter("vec_id is null"), width=3).count() == 0


def plain_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints: list[tuple[int, int]]) -> dict[int, int]:
    """Smallest id reachable, by point."""
    points = np.array(sorted({p for _, p in prints}), "uint64")
    label = np.arange(len(points))
    u, v = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        if (label == before).all():
            break
    of = {int(p): int(n) for p, n in zip(points, label)}
    least: dict[int, int] = {}
    for i, p in prints:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return {p: least.get(n) for p, n in of.items()}


def test_simhash_query_equals_brute_force(spark):
    for size in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").collect()
        prints = [(d["doc_id"], plain_fingerprint(d["text"])) for d in docs]
        groups = brute_groups(prints)
        want = sorted((i, f"{p:016x}", groups[p]) for i, p in prints)
        assert sorted(map(tuple, QUERIES["op12_simhash"](spark, f"/root/testdata/{size}").collect())) == want


def test_simhash_of_awkward_texts(documents):
    long = " ".join(f"w{i % 997}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One TWO"), (5, "one\ttwo"), (6, long), (6, long), (None, "One TWO"), (None, "ünïcode wörds here Ä"), (9, "ünïcode wörds here Ä")]
    got = sorted(simhash.near_groups(documents(*rows)).collect(), key=str)
    want = brute_groups([(i, plain_fingerprint(t)) for i, t in rows])
    assert got == sorted(((i, f"{plain_fingerprint(t):016x}", want[plain_fingerprint(t)]) for i, t in rows), key=str)
    assert simhash.near_groups(documents(*rows).limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 3])
def test_tiles_lose_no_link(spark, monkeypatch, chunk):
    """Points at every distance up to six bits from others, with tiles of one and of many chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    base = rng.integers(0, 1 << 63, 60, dtype="uint64")
    points = set(base.tolist())
    for p in base.tolist():
        for bits in range(1, 7):
            q = p
            for b in rng.choice(64, bits, replace=False):
                q ^= 1 << int(b)
            points.add(q)
    points |= {int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}  # a dense family
    points = sorted(points)
    signed = [(int(np.uint64(p).view("int64")),) for p in points]
    df = spark.createDataFrame(signed, "fp long")
    stars = simhash.links(df).collect()
    label = {p: p for (p,) in signed}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for s in stars:
        label[max(root(s["a"]), root(s["b"]))] = min(root(s["a"]), root(s["b"]))
    got = {int(np.int64(p).view("uint64")): root(p) for (p,) in signed}
    want = brute_groups([(i, p) for i, p in enumerate(points)])
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[p], want[p]) for p in points}) == len(set(want.values()))
    assert len(stars) <= 40 * len(points)


def brute_negatives(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (id, label, whole numbers)."""
    out = []
    for a, (i, label, v) in enumerate(rows):
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(rows) if b != a)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(s, k) for s, k, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fits[:3])]
    return sorted(out)


@pytest.mark.parametrize("bucket,block", [(negatives.BUCKET, negatives.BLOCK), (64, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, bucket, block):
    """Clustered vectors of different lengths, so that buckets and ranges prune, with ties and copies."""
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(bucket)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = (centres[i % 6] + 0.4 * rng.normal(size=8)) * rng.choice([0.0, 5.0, 50.0, 300.0], p=[0.02, 0.38, 0.4, 0.2])
        rows.append((i, int(rng.integers(0, 4)), [int(x) for x in v]))
    rows += [(i + 1000, l, v) for i, l, v in rows[:60]] + [(50, rows[50][1], rows[50][2])]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_ranges_prune():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    plain = centres[np.arange(2000) % 20] + 0.1 * rng.normal(size=(2000, 16))  # of about one length, as in a bucket
    vectors = np.floor(1000 * plain / np.linalg.norm(plain, axis=1)[:, None]).astype("int64")
    bucket = negatives.Bucket(np.arange(2000), np.arange(2000), np.zeros(2000, "int64"), vectors)
    scores = vectors @ vectors[0]
    least = int(np.sort(scores)[-20])
    places = bucket.feasible(vectors[0], least)
    assert len(places) < 500 and set(np.flatnonzero(scores >= least)) <= set(places)
    for least in (-5000, 0, 1, 10**9):
        places = bucket.feasible(vectors[0], least)
        assert places is None or set(np.flatnonzero(scores >= least)) <= set(places)


def test_negatives_of_awkward_rows(spark):
    rows = [(None, [1.0], 1, "", 0), (0, None, 1, "", 0), (50, [1.0, 2.0], None, "", 0), (100, [1.0, None], 1, "", 0), (150, [float("nan")], 1, "", 0)]
    rows += [(200, [1.0, 2.0, 0.5], 1, "", 0), (201, [1.0, 2.0], 1, "", 0), (203, [0.5, 1.4], 3, "", 0), (205, [], 3, "", 0), (250, [0.0, 0.0], 3, "", 0), (251, [0.0], 3, "", 0), (252, [4e30, 1.0], 7, "", 0)]
    df = spark.createDataFrame(rows, EMBEDDINGS)
    plain = [(r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], [min(max(int(np.floor(256 * x)), -(2**62)), 2**62) for x in r[1]]) for r in rows[5:]]
    got = negatives.hard_negatives(negatives.prepared(df), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_negatives(plain)
    assert negatives.hard_negatives(negatives.prepared(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(negatives.prepared(df.filter("vec_id > 200")), F.col("vec_id") == 0).count() == 0
