"""Merkle manifests against a plain version."""

import random
from collections import defaultdict
from functools import partial
from hashlib import sha256
from zlib import crc32

import duckdb
from pyspark.sql import functions as F

from spanloom.llm import queries
from spanloom.llm.merkle import merkle_manifest, proof_text, row_digest
from spanloom.llm.queries import ORACLE, op12_merkle_manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    """(left, right) siblings on each level."""
    found = []
    for level in levels[:-1]:
        run = level[at - at % 16 : at - at % 16 + 16]
        found.append((run[: at % 16], run[at % 16 + 1 :]))
        at //= 16
    return found


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[source] = tree([leaf_of(r) for r in own])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for number, source in enumerate(order):
        for at, row in enumerate(groups[source]):
            proof = path(trees[source], at) + path(top, number)
            i = row["doc_id"]
            bad = i is not None and crc32(str(i).encode()) % 5 == 0
            now = leaf_of(row | {"text": row["text"] and row["text"].translate(LOWER)}) if bad else leaf_of(row)
            for left, right in proof:
                now = h(*left, now, *right)
            siblings = h(*(d for left, right in proof for d in left + right))
            out.append((i, leaf_of(row), trees[source][-1][0], top[-1][0], siblings, now, now == top[-1][0], at))
    return sorted(out, key=str)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    rows, number = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            number += rng.randint(1, 3)
            text = rng.choice([None, "", "É Upper ÀB", "lower", "X" * rng.randint(1, 500)])
            rows.append({"doc_id": number, "text": text, "lang": rng.choice([None, "", "en"]), "source": source, "n_chars": rng.choice([None, 0, -7, 12])})
    rng.shuffle(rows)
    return rows


def manifest(spark, rows, folder):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(5).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    found = op12_merkle_manifest(spark, str(folder))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position"]
    return sorted((tuple(r) for r in found.collect()), key=str)


SIZES = {f"s{i}": i for i in (1, 2, 15, 16, 17, 255, 256, 257)} | {None: 40, "": 3, "É": 20, "ß": 1, "z": 700} | {f"t{i}": 1 for i in range(10)}


def test_small_superblocks(spark, tmp_path, monkeypatch):
    """Blocks of 16 nodes: sources of several rounds, of one row, and at every border; 19 sources."""
    monkeypatch.setattr(queries, "merkle_manifest", partial(merkle_manifest, depth=1))
    rows = corpus(SIZES)
    assert manifest(spark, rows, tmp_path) == expected(rows)


def test_production_superblocks_and_sql(spark, tmp_path):
    rows = corpus(SIZES | {"big": 4097 + 300, "even": 4096}, seed=2)
    found = manifest(spark, rows, tmp_path)
    assert found == expected(rows)
    assert any(r[6] for r in found) and not all(r[6] for r in found)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    named = con.execute(ORACLE["op12_merkle_manifest"])
    names = [c[0] for c in named.description]
    at = [names.index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position")]
    assert sorted((tuple(r[i] for i in at) for r in named.fetchall()), key=str) == found


def test_edges(spark, tmp_path, docs):
    """NULL ids, repeated rows, one row, none."""
    rows = [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in ((None, "A"), (3, "B"), (3, "B"), (3, "C"), (None, None))]
    assert manifest(spark, rows, tmp_path) == expected(rows)
    assert manifest(spark, rows[1:2], tmp_path) == expected(rows[1:2])
    assert manifest(spark, [], tmp_path) == []


def test_general_interface(spark, docs):
    """Other ids and groups, clashing columns, no claims: every proof leads to the root."""
    frame = docs.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("name"), "text", F.lit(1).alias("g"), F.lit(2).alias("digest"), F.lit(3).alias("position"))
    found = merkle_manifest(frame, [F.col("name"), F.col("text")], F.length("text") % 7, id_col="name").collect()
    assert len(found) == docs.count() and all(r.verified for r in found)
    for r in found[:50]:
        now = r.leaf
        for left, right in zip(r.lefts, r.rights):
            now = h(left, now, right)
        assert now == r.root and r.folded_root == now
    text = spark.createDataFrame([(["a", "b"], ["c", ""])], "x array<string>, y array<string>").select(proof_text(F.col("x"), F.col("y"))).head()[0]
    assert text == "acb"
    lone = spark.createDataFrame([("É", None)], "a string, b long")
    assert lone.select(row_digest([F.col("a"), F.col("b")])).head()[0] == h("2:É-")
