"""The pipeline against a version by brute force, stage by stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_models import check_packing, reference  # noqa: F401
from .test_native import expected_lines
from .test_search import brute_components, brute_leaks


def test_stages(spark, sf, docs, reference):  # noqa: F811
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    current = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, sf)
        if name == "language":
            rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
        elif name == "lines":
            rows = [(d, t) for d, _, _, t in expected_lines(rows)]
        elif name == "near_duplicates":
            losers = {d for d, _, c in brute_components(rows, 5, 80) if d is not None and c != d}
            rows = [(d, t) for d, t in rows if d not in losers]
        elif name == "benchmark":
            leaks = {d for d, *_ in brute_leaks(rows, items, 0.8)}
            rows = [(d, t) for d, t in rows if d not in leaks]
        if number == len(corpus_pipeline.STAGES) - 1:
            check_packing(rows, out.collect(), reference, 2048)
        else:
            assert out.columns == columns
            current = out.cache()
            assert sorted(((r.doc_id, r.text) for r in current.collect()), key=str) == sorted(rows, key=str), name


def test_run(spark, sf):
    first, second = (corpus_pipeline.run(spark, sf).drop("sequence_id", "offset") for _ in range(2))
    assert first.count() > 100 and first.exceptAll(second).isEmpty()


def test_every_query_runs(spark, tmp_path):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names}
    assert set(entry.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["language", "lines", "near_duplicates", "benchmark", "pack"])
def test_stages_take_empty_tables(spark, sf, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_texts_stay_where_no_language_can_be_learned(spark, sf, make):
    rows = [(1, "a plain text", None), (2, "another one", None), (3, "12 34", None), (4, None, None)]
    kept = corpus_pipeline.keep_languages(spark, make(rows), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_columns_that_clash_with_an_operators_own_pass_unchanged(spark, sf, docs):
    names = ("lang_pred", "score", "mixture", "_text", "row", "n_lines", "n_dropped", "component_id", "id", "rid", "c0", "item_id", "a.b")
    current = docs.withColumns({c: F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")) for c in names})
    columns = current.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf).cache()
        assert current.columns == columns
    for row in current.collect():
        assert all(row[c] == (None if row.doc_id is None else f"{c}={row.doc_id}") for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, current, sf).count() >= current.count()


def test_run_leaves_no_files_behind(spark, sf):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    corpus_pipeline.run(spark, sf).count()
    assert not list(folder.glob("pipeline-*"))
