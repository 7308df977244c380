"""Spelling variants against a plain version and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from spanloom.llm import spelling
from spanloom.llm.queries import ORACLE, op11_spelling_variants
from spanloom.llm.spelling import count_vectors, kd_tree, letter_rows, near_pairs, near_words, one_edit, search, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

CHAIN = "abcdefg " * 5 + "abcdefh " * 25 + "abcdefhi " * 125 + "abcdxfhi " * 625 + "unlike " * 9


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, drop_every=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop_every and h % drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def expected(words, ratio=5):
    forms, out = {}, []
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        forms[w] = (close[0][1], -close[0][0]) if close and -close[0][0] >= ratio * n else (None, None)
        out.append([w, forms[w][0], None, n, len(close), forms[w][1]])
    for row in out:
        row[2] = row[0]
        while forms[row[2]][0] is not None:
            row[2] = forms[row[2]][0]
    return sorted(map(tuple, out))


def texts(seed, n_words=120, n_docs=60):
    """Frequent words with rarer variants of them and variants of these, accents and capitals among them."""
    rng = random.Random(seed)
    letters = "abcdeéèÀ×ÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(n_words)]
    for w in list(words):
        k = rng.randrange(len(w))
        words += [w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]]
    weights = [rng.choice([1, 3, 20, 120]) for _ in words]
    between = [" ", "\n", "-", "1", "Ā", "€", "ı"]
    return [(i, "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice(between) for w in rng.choices(words, weights, k=250))) for i in range(n_docs)]


def rows_of(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in frame.collect())


def test_query_and_sql(spark, make, tmp_path):
    rows = [*texts(1), (None, "wordlike " * 7), (70, None), (71, ""), (72, "x" * 5000 + " wordlike"), (3, "wordlikes " * 6), (3, "wordlikes " * 6), (5, "Ã" * 300 + " é"), (81, CHAIN)]
    make(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_of(op11_spelling_variants(spark, str(tmp_path)))
    assert found == expected(counted(rows))
    assert any(r[1] and r[1] != r[2] for r in found)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE["op11_spelling_variants"]).fetchall()) == found


def test_many_cells_and_parts(spark, make):
    """Cells of 8 words, parts of 16 queries: each near pair meets in exactly one place."""
    rows = texts(2)
    assert rows_of(spelling_variants(make(rows), cell=8, crowd=8)) == expected(counted(rows, None))


def test_anagrams_share_one_place_of_the_tree(spark):
    """Words of equal letter counts can't be told apart by boxes; their cell is dealt into parts."""
    rng = random.Random(3)
    words = {"".join(rng.sample("aabbccdd", 8)) for _ in range(150)}
    words |= {w[:3] + "z" + w[4:] for w in words} | {w[:5] + w[6:] for w in words}
    counts = {w: rng.randint(5, 300) for w in words}
    found = near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), cell=10, crowd=20).collect()
    want = {}
    for w in words:
        close = sorted((-counts[x], x) for x in words if near(w, x))
        if close:
            want[w] = (len(close), -close[0][0], close[0][1])
    assert {r.word: (r.n_near, r.form_n, r.form) for r in found} == want


def test_chains_of_forms(make):
    """Each word of the chain is five times as frequent as the one before."""
    rows = [(1, CHAIN)]
    found = {r[0]: r[1:3] for r in rows_of(spelling_variants(make(rows)))}
    assert found == {
        "abcdefg": ("abcdefh", "abcdxfhi"), "abcdefh": ("abcdefhi", "abcdxfhi"), "abcdefhi": ("abcdxfhi", "abcdxfhi"),
        "abcdxfhi": (None, "abcdxfhi"), "unlike": (None, "unlike"),
    }


def test_edges(spark, make, docs):
    assert rows_of(spelling_variants(make([]))) == []
    assert rows_of(spelling_variants(make([(1, None), (2, "a b c")]))) == []
    long = [(i, "Ã" * 70_000 + "x" + "Ã" * i) for i in (3, 3, 3, 3, 3, 4, 4, 4, 4, 4)]
    assert rows_of(spelling_variants(make(long))) == expected(counted(long, None))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    clashing = docs.selectExpr("doc_id AS n", "text AS word", "1 AS length", "2 AS id", "3 AS text")
    assert rows_of(spelling_variants(clashing, id_col="n", text_col="word", drop_every=7)) == expected(counted(rows, 7))


def test_trees_lose_nothing():
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcdefgé") for _ in range(7)) for _ in range(900)})
    shorter = list({w[:3] + w[4:] for w in words})
    rows = letter_rows(words, 7)
    vectors = count_vectors(rows)
    tree, leaves = kd_tree(vectors, 20)
    assert leaves > 30
    homes = [(leaf.number, i) for leaf, own in search(tree, vectors, 0, 0) for i in own]
    assert sorted(i for _, i in homes) == list(range(len(words)))  # one home each
    reached = sum(len(own) * len(leaf.points) for leaf, own in search(tree, vectors, 1, 1))
    assert reached < len(words) ** 2 / 4  # boxes are pruned
    for asked, length in ((words, 7), (shorter, 6)):
        found = [(asked[i], words[k]) for x, y in near_pairs(tree, rows, vectors, letter_rows(asked, length), False) for i, k in zip(x, y)]
        want = {(a, b) for a in asked for b in words if near(a, b)}
        assert len(found) == len(set(found)) and set(found) == want
    once = [(i, k) for x, y in near_pairs(tree, rows, vectors, rows, True) for i, k in zip(x.tolist(), y.tolist())]
    assert len(once) == sum(near(a, b) for a in words for b in words) / 2 and all(i < k for i, k in once)


def test_checksums():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    begins = np.sort(rng.integers(0, 4000, 300))
    ends = begins + rng.integers(0, 200, 300)
    seeds = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    want = [zlib.crc32(data[b:e].tobytes(), int(s)) for b, e, s in zip(begins, ends, seeds)]
    assert spelling.checksums(data, begins, ends, seeds).tolist() == want
    assert one_edit(letter_rows(["abcdef"], 6), letter_rows(["abcxdef"], 7)).all()
