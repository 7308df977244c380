import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs, or of (doc_id, text, lang)."""

    def made(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return made


@pytest.fixture(scope="session")
def sf(tmp_path_factory, spark, make):
    """A small folder of tables, with copies, leaks, nulls, empty and repeated rows."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(12, 40))) for i in range(12)]
    rows = []
    for i in range(160):
        body = text(rng.randint(3, 220))
        if i % 9 == 0:
            body += " " + items[i % 12][1].upper().replace(" ", ", ") + " " + text(20)
        rows.append((i, body))
    for i in range(160, 200):
        parts = rows[i % 40][1].split(" ")
        for _ in range(i % 3):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i, " ".join(parts)))
    shared = text(14)
    rows = [(i, t + "\n" + shared if i % 4 == 0 else t) for i, t in rows]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "12 34 !!"), (204, text(9000)), (204, text(5)), (205, "a b"), (206, "a b"), (None, text(30)), (3, rows[3][1])]
    folder = tmp_path_factory.mktemp("sf")
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
