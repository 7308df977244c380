"""Selectors of any kind, and correction processes on a stream."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.model import JSON_SELECTOR, TEXT_SELECTOR
from spanloom.operators import selectors
from spanloom.streaming import sweep

CITED = "property_shape_iri string, selector_type string, selector_value string, content_hash string, doc_uri string"


def test_json_pointers(spark):
    document = json.dumps({"a": {"b/c": [1, {"é": None}], "~": "t"}, "": 2})
    documents = spark.createDataFrame([("d", document), ("twice", "{}"), ("twice", "{}"), ("broken", "{"), ("null", None)], "doc_uri string, content string")
    wanted = {
        ("d", ""): ("RESOLVED", json.dumps(json.loads(document), sort_keys=True, separators=(",", ":"), ensure_ascii=False)), ("d", "/a/b~1c/0"): ("RESOLVED", "1"),
        ("d", "/a/b~1c/1/é"): ("RESOLVED", "null"), ("d", "/a/~0"): ("RESOLVED", '"t"'), ("d", "/"): ("RESOLVED", "2"), ("d", "/a/x"): ("NOT_FOUND", None), ("d", "/a/b~1c/01"): ("NOT_FOUND", None),
        ("d", "a"): ("UNCITABLE", None), ("d", "/~2"): ("UNCITABLE", None), ("d", None): ("UNCITABLE", None), ("twice", "/a"): ("AMBIGUOUS", None),
        ("broken", "/a"): ("NOT_FOUND", None), ("null", "/a"): ("NOT_FOUND", None), ("absent", "/a"): ("NOT_FOUND", None),
    }
    rows = spark.createDataFrame([(str(i), JSON_SELECTOR, p, None, d) for i, (d, p) in enumerate(wanted)], CITED)
    found = {int(r.property_shape_iri): (r.status, r.content) for r in selectors.resolve_any(rows, {"json": documents}).collect()}
    assert [found[i] for i in range(len(wanted))] == list(wanted.values())


def test_json_documents_are_not_copied_to_their_citations(spark):
    """Each document is read once, however many citations it has and in whatever batches they come."""
    held = {d: {f"k{i}": {"v": f"{d}{i}"} for i in range(6000)} for d in ("a", "b")}
    documents = spark.createDataFrame([*((d, json.dumps(v)) for d, v in held.items()), ("c", "{}"), ("c", "[]"), (None, "{}")], "doc_uri string, content string")
    rows = [(f"{d}{i}", f"/k{i}/v", d) for d in ("a", "b", "c", None) for i in range(0, 6600, 2)]
    found = selectors.resolve_json(spark.createDataFrame(rows, "property_shape_iri string, selector_value string, doc_uri string"), documents)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.property_shape_iri: (r.status, r.content) for r in found.collect()}
    want = {"c": ("AMBIGUOUS", None), None: ("NOT_FOUND", None)}
    assert got == {k: want.get(d, ("RESOLVED", f'"{k}"') if int(p[2:-2]) < 6000 else ("NOT_FOUND", None)) for k, p, d in rows}


def test_registry(spark):
    rows = spark.createDataFrame([("a", "mine", "x", "x", "d"), ("b", TEXT_SELECTOR, "", "h", "d")], CITED)
    texts = spark.createDataFrame([("d", "text")], "doc_uri string, text string")
    with pytest.raises(LookupError, match="mine"):
        selectors.resolve_any(rows, {"texts": texts})
    selectors.register("mine", lambda own, _: own.select("property_shape_iri", F.lit("RESOLVED").alias("status"), F.col("selector_value").alias("content"), F.col("selector_value").alias("current_hash")))
    try:
        with pytest.raises(ValueError, match="already"):
            selectors.register("mine", None)
        found = {r.property_shape_iri: (r.changed, r.current_status) for r in selectors.check_any_drift(rows, {"texts": texts}).collect()}
        assert found == {"a": (False, "RESOLVED"), "b": (True, "RESOLVED")}
        assert selectors.resolve_any(rows.limit(0), {}).collect() == []
    finally:
        selectors.unregister("mine")


def test_correction_processes_over_restarts(spark, tmp_path):
    """State outlives the query; rejection pauses, completion deletes; the batch plan agrees."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "fact_key string, leaf_ref string, drift_kind string, fingerprint string, verdict string, at long"
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    batches = [
        [("a", "REJECTED", 1), ("b", "REJECTED", 1), ("b", "APPROVED", 2), ("c", "APPROVED", 1)],
        [("a", "APPROVED", 5), ("b", "REJECTED", 7), ("d", "REJECTED", 1)],
        [("a", "REJECTED", 3), ("d", "APPROVED", 2), ("b", "REJECTED", 7)],  # the first is late, the last is repeated
    ]
    try:
        for rows in batches:
            spark.createDataFrame([(k, "l", "CONTENT", "f", v, at) for k, v, at in rows], schema).coalesce(1).write.mode("append").parquet(source)
            stream = sweep.correction_process(spark.readStream.schema(schema).parquet(source))
            run = stream.writeStream.outputMode("update").option("checkpointLocation", marks).foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
            assert run.awaitTermination(120)
        last = spark.read.parquet(out).groupBy("process").agg(F.max_by("paused", "n").alias("paused"))
        paused = {r.process for r in last.where("paused").collect()}
        assert paused == {r.process for r in sweep.correction_state(spark.read.parquet(source)).collect()}
        assert last.count() == 4 and len(paused) == 1
    finally:
        spark.conf.unset(name)
