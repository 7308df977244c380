"""Top-k, near duplicates and leaks against brute force."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, jaccard, topk
from spanloom.llm.components import connected_components
from spanloom.llm.hashing import shingles
from spanloom.llm.queries import op2_topk_search


def brute_top(rows, k):
    vectors = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(64 * float(np.float32(x)))) for x in v]
        vectors[key] = max(vectors.get(key, q), q)
    out = []
    for a, u in vectors.items():
        if a % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(u, v)), b) for b, v in vectors.items() if b != a)[:k]
            out += [(a, i + 1, b, -s) for i, (s, b) in enumerate(scored)]
    return sorted(out)


def test_top_k_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_VECTORS", 64)
    monkeypatch.setattr(topk, "TILE_QUERIES", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 6), 1)]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (None, [1.0] * 6), (20, rows[20][1]), (40, [9.0] * 6), (480, []), (500, [0.5, 0.5])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=20)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 20)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = table.where("vec_id IN (0, 1)")
    assert topk.top_k(few, F.col("vec_id") % 20 == 0).count() == 1


def test_top_k_over_many_tasks(spark, monkeypatch):
    """Both sides of a tile meet where Spark doesn't merge small partitions."""
    monkeypatch.setattr(topk, "TILE_VECTORS", 40)
    monkeypatch.setattr(topk, "TILE_QUERIES", 6)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 5)]) for i in range(260)]
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 20)
    finally:
        spark.conf.unset(name)


def test_reading_stops_early_and_loses_nothing():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-40, 40, (4000, 8)).astype(np.float64)
    order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
    read = []
    for _ in range(40):
        query = rng.integers(-40, 40, 8)
        rest = topk.aggregate_lists(query, vectors, order, 10)
        best = np.argsort(-(vectors @ query), kind="stable")[:10]
        assert set((vectors @ query)[best]) <= set((vectors @ query)[rest]) and set(best) <= set(rest) | set(np.flatnonzero(vectors @ query == (vectors @ query)[best[-1]]))
        read.append(len(rest))
    assert np.median(read) <= topk.FEW


def test_a_floor_from_elsewhere_stops_reading_sooner():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-40, 40, (3000, 8)).astype(np.float64)
    order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
    for _ in range(20):
        query = rng.integers(-40, 40, 8)
        scores = vectors @ query
        floor = np.sort(scores)[-5]
        rest = topk.aggregate_lists(query, vectors, order, 50, float(floor))
        assert set(np.flatnonzero(scores >= floor)) <= set(rest)
        assert len(topk.aggregate_lists(query, vectors, order, 50, 1e9)) == 0


def test_query_of_top_k_is_brute_force_at_sf01(spark):
    """2000 vectors, where lists are read: all rows are those of a plain product."""
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    rows = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    v = np.array([np.floor(64 * np.asarray(x, np.float64)) for x in rows.embedding]).astype(np.int64)
    ids = rows.vec_id.to_numpy()
    found = op2_topk_search(spark, path).toPandas().sort_values(["query_id", "rank"])
    for qid, own in found.groupby("query_id"):
        scores = v @ v[ids == qid][0]
        order = np.lexsort((ids, -scores))
        order = order[ids[order] != qid][:20]
        assert own.vec_id.tolist() == ids[order].tolist() and own.score.tolist() == scores[order].tolist() and own["rank"].tolist() == list(range(1, 21))
    assert set(found.query_id) == {i for i in ids if i % 20 == 0}


WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(text, size):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent):
    sets = [(doc, word_set(text, size)) for doc, text in rows]
    parent = {doc: doc for doc, _ in sets if doc is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and a != b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((doc, len(s), None if doc is None else find(doc)) for doc, s in sets), key=str)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_components_of_a_small_corpus(docs, size, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.jaccard_components(docs, words=size, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, size, percent)


def test_chains_and_frequent_shingles(make, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(jaccard, "LOCALLY", 2)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows, current = [], list(base)
    for i in range(40):
        current = list(current)
        current[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(current)))
    passage = " ".join(f"p{i}" for i in range(20))
    rows += [(100 + i, passage + " " + " ".join(f"x{i}y{j}" for j in range(30))) for i in range(30)]
    rows += [(200, ""), (201, None), (202, "a b c"), (203, "A  b\tc"), (204, "a b"), (205, "x" * 5000 + " y"), (206, "x" * 5000 + " Y")]
    table = make(rows).withColumn("cls", F.lit(1)).withColumn("n", F.lit(2)).withColumn("component_id", F.lit(3))
    got = jaccard.jaccard_components(table).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4, 85)
    assert jaccard.jaccard_components(make([])).collect() == []


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}


def hashed(text):
    table = pa.array([text])
    return np.concatenate([h for h, _ in decontaminate.hashed_words(decontaminate.pc.utf8_lower(table), decontaminate.PUNCTUATION)])


def brute_leaks(rows, items, least):
    best = {}
    for item, text in items:
        words = hashed(text or "")
        size = min(5, len(words))
        if not size:
            continue
        wanted = Counter(shingles(words, size).tolist())
        for doc, body in rows:
            own = hashed(body or "")
            if len(own) < size:
                continue
            for start in range(max(1, len(own) - len(words) + 1)):
                value = decontaminate.similarity(Counter(shingles(own[start : start + len(words)], size).tolist()), wanted)
                if value >= least and value > best.get((doc, item), (0,))[0]:
                    best[doc, item] = (value, start, min(len(words), len(own)))
    return sorted(((*k, v[1], v[2], round(v[0], 9)) for k, v in best.items()), key=str)


def test_leaks_of_a_small_corpus(spark, docs, sf, make):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = items[0][1].split()
    changed = " ".join([*long[: len(long) // 2], "extra", *long[len(long) // 2 :]])
    items += [(50, "one two three"), (51, None), (52, ""), (53, " ".join(long * 3)), (0, items[0][1])]
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id % 3 = 0 OR doc_id IS NULL").collect()]
    rows += [(900, "So: one, TWO three!"), (901, " ".join(long * 3 + long[:3])), (902, changed), (903, " ".join(long[:-1])), (904, "one two")]
    table = make(rows).withColumn("item_id", F.lit(1)).withColumn("similarity", F.lit(2))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(table, benchmark).collect()
    found = sorted(((r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 9)) for r in got), key=str)
    assert found == brute_leaks(rows, items, 0.8) and len(found) > 10
    assert decontaminate.find_leaks(table.limit(0), benchmark).collect() == []
    assert decontaminate.find_leaks(table, benchmark.limit(0)).collect() == []


def test_benchmark_in_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(5)]
    got = decontaminate.find_leaks(make([(1, " ".join(t for _, t in items))]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.item_id, r.start_word) for r in got.collect()) == [(i, 12 * i) for i in range(5)]


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(0, 2**63, 30).astype(np.uint64)) for i in range(50)]
    items = decontaminate.Items(rows, 5)
    for i in range(50):
        bits = np.unpackbits(items.prints[i].view(np.uint8))
        flipped = bits.copy()
        flipped[rng.choice(128, decontaminate.RADIUS, replace=False)] ^= 1
        assert i in items.candidates(np.packbits(flipped).view(np.uint16))
