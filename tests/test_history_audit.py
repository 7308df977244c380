import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanloom.errors import CorpusIntegrityError, ReviewLoadError, UnsupportedConstructError
from spanloom.functions import pointer
from spanloom.operators import audit, drift, history, schemas
from spanloom.sources import snapshots
from spanloom.sources.xml_nodes import parse_documents
from spanloom.streaming import sweep


def rows(frame, *columns):
    return sorted(tuple(r) for r in (frame.select(*columns) if columns else frame).collect())


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.manifest(spark, root).count() == 0
    (tmp_path / "_current").write_text("1.02\n")
    with pytest.raises(CorpusIntegrityError, match="no manifest"):
        snapshots.manifest(spark, root)
    folder = tmp_path / "1.02"
    folder.mkdir()
    (folder / "a.xsd").write_text("<a/>")
    (folder / "_manifest.json").write_text(json.dumps({"b": "a.xsd", "a": "a.xsd"}))
    current = snapshots.manifest(spark, root)
    assert [r.family for r in snapshots.families(current).collect()] == ["a", "b"]
    wanted = spark.createDataFrame([("a",), ("zz",)], "family string")
    assert rows(snapshots.resolve_families(wanted, current), "family", "location_status") == [("a", "RESOLVED"), ("zz", "NOT_FOUND")]
    for bad in ({"a": "../x"}, {"a": "none"}):
        (folder / "_manifest.json").write_text(json.dumps(bad))
        with pytest.raises(CorpusIntegrityError):
            snapshots.manifest(spark, root)


def test_catalog_and_reviews(spark, tmp_path):
    path = str(tmp_path / "c.json")
    snapshots.write_catalog({"k": [{"a": 1}, {"a": 2}]}, path)
    assert rows(snapshots.read_catalog(spark, path)) == [("k", 0, '{"a":1}'), ("k", 1, '{"a":2}')]
    for bad in ("[]", '{"k": 1}'):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(PySparkException):
            snapshots.read_catalog(spark, path).collect()
    assert snapshots.read_reviews(spark, str(tmp_path / "none")).count() == 0
    folder = tmp_path / "reviews"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"fact_key": "k", "verdict": "APPROVED"}))
    assert snapshots.read_reviews(spark, str(folder)).count() == 1
    (folder / "2.json").write_text("{nope")
    with pytest.raises(ReviewLoadError):
        snapshots.read_reviews(spark, str(folder))


def test_classification_and_suppression(spark):
    found = spark.createDataFrame(
        [("a", False, "RESOLVED", "h"), ("b", True, "RESOLVED", "h2"), ("c", True, "NOT_FOUND", None)], "fact_key string, changed boolean, current_status string, current_hash string"
    )
    problems = drift.classify(found)
    assert rows(problems, "fact_key", "drift_kind", "fingerprint") == [("b", "CONTENT", "h2"), ("c", "STRUCTURAL", "NOT_FOUND")]
    review = "fact_key string, drift_kind string, reviewed_fingerprint string, verdict string"
    approved = [("b", "CONTENT", "h2", "APPROVED"), ("c", "STRUCTURAL", "OTHER", "APPROVED")]
    assert rows(drift.suppress_reviewed(problems, spark.createDataFrame(approved, review)), "fact_key") == [("c",)]
    rejected = [*approved, ("b", "CONTENT", "h2", "REJECTED")]
    assert drift.suppress_reviewed(problems, spark.createDataFrame(rejected, review)).count() == 2
    assert drift.grouped(problems).count() == 2


def test_sweep_leaves_out_references_with_a_lost_family(spark):
    references = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "fact_key string, family string")
    checked, excluded = drift.sweep(references, spark.createDataFrame([("x",)], "family string"))
    assert rows(checked) == [("b", "x")] and rows(excluded) == [("a",)]


def test_proposals(spark):
    correction = "correction string, s string, p string, o_lang string, value string"
    decision = "correction string, outcome string, decider string, generated_at string"
    old = spark.createDataFrame([("1-ann", "s", "p", "en", "a"), ("2-bob", "t", "p", "en", "b")], correction)
    new = spark.createDataFrame([("3-eve", "s", "p", "en", "c")], correction)
    corrections, decisions = history.propose(old, spark.createDataFrame([], decision), new, "2026-01-01")
    assert rows(decisions) == [("1-ann", "rejected", "system", "2026-01-01")]
    assert rows(history.pending(corrections, decisions), "correction", "proposer") == [("2-bob", "bob"), ("3-eve", "eve")]


def test_locators_and_provenance(spark):
    facts = spark.createDataFrame([("a", "u#page=196"), ("b", "u#page=1960"), ("c", "u#x=1&page=196&y=2")], "s string, source string")
    assert rows(history.facts_at(facts, "page", "196"), "s") == [("a",), ("c",)]
    iris = spark.createDataFrame([("u#A",), ("u#A.b",), ("u",)], "s string")
    assert rows(history.global_constructs(iris)) == [("u#A",)]
    parts = spark.createDataFrame([("r", "a"), ("r", "q"), ("q", "b")], "ref_id string, part_ref_id string")
    assert rows(history.leaves(parts, spark.createDataFrame([("r",)], "ref_id string"))) == [("r", "a"), ("r", "b")]


def test_pointers(spark):
    document = '{"a/b": {"~": [10, null, false]}, "k": "v"}'
    cases = {"": True, "/a~1b/~0/0": "10", "/a~1b/~0/1": "null", "/a~1b/~0/2": "false", "/a~1b/~0/01": None, "/a~1b/~0/3": None, "/none": None, "/a~2b": None, "/k": '"v"'}
    for path, wanted in cases.items():
        got = pointer.at_pointer(document, path)
        assert (got is not None) if wanted is True else got == wanted, path
    frame = spark.createDataFrame([(document, p) for p in cases], "d string, p string")
    assert [r[0] for r in frame.select(pointer.resolve_dynamic("d", "p")).collect()] == [pointer.at_pointer(document, p) for p in cases]
    assert frame.select(pointer.resolve_constant(F.col("d"), "/a~1b/~0/0")).first()[0] == "10"


def test_lines_and_sections(spark):
    words = spark.createDataFrame(
        [("d", 1, "Id", 0.0, 1.0, 10.0, 11.0), ("d", 1, "Head", 2.0, 3.0, 10.02, 11.0), ("d", 1, "text", 0.0, 1.0, 20.0, 21.0), ("d", 2, "more", 0.0, 1.0, 5.0, 6.0), ("d", 2, "Id", 0.0, 1.0, 9.0, 10.0), ("d", 2, "Two", 2.0, 3.0, 9.0, 10.0)],
        "doc_uri string, page int, text string, x0 double, x1 double, top double, bottom double",
    )
    found = audit.sections(audit.text_lines(words), "^Id ")
    assert rows(found, "heading", "text") == [("Id Head", "text more"), ("Id Two", "")]


def test_task_documents(spark, tmp_path):
    sha = "a" * 40
    tasks = [
        {"id": "1", "status": "done", "subtasks": [{"id": "1", "status": "done", "evidence": {"commits": [sha], "prs": ["https://github.com/o/r/pull/1"]}}]},
        {"id": "2", "status": "cancelled", "subtasks": [{"id": "1", "status": "done", "evidence": {"commits": ["short"], "prs": ["x"]}}]},
        {"id": "3", "status": "pending", "subtasks": [{"id": "1", "status": "done"}, {"id": "2", "status": "pending"}]},
        {"id": "4", "status": "done", "subtasks": []},
    ]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"master": {"tasks": tasks, "metadata": {"taskCount": 9, "completedCount": 2}}}))
    documents = snapshots.read_task_documents(spark, str(path))
    assert rows(audit.task_faults(documents), "item", "fault") == [
        ("2", "cancelled with done subtasks"), ("2.1", "commit is no full hash"), ("2.1", "pull request is no address"),
        ("3", "status does not follow from subtasks"), ("3.1", "done without evidence"), ("4", "done without evidence"), ("metadata", "taskCount is wrong"),
    ]
    assert rows(audit.task_counts(documents), "tasks", "subtasks", "evidence") == [(4, 4, 2)]


def test_schemas(spark):
    xsd = (
        '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:t"><xs:complexType name="T"><xs:sequence>'
        '<xs:element name="E"><xs:simpleType><xs:restriction base="xs:string"><xs:maxLength value="3"/></xs:restriction></xs:simpleType></xs:element>'
        '<xs:element name="E"/></xs:sequence><xs:attribute name="a"/></xs:complexType><xs:element name="G"><xs:annotation><xs:documentation xml:lang="en">Doc</xs:documentation></xs:annotation>'
        '<xs:key name="K"><xs:selector xpath="x"/><xs:field xpath="b"/><xs:field xpath="a"/></xs:key></xs:element></xs:schema>'
    )
    nodes = parse_documents(spark.createDataFrame([("d", bytearray(xsd.encode()))], "doc_uri string, content binary")).cache()
    uris = {r.uri for r in schemas.components(nodes).collect()}
    assert {"urn:t#T", "urn:t#T.E", "urn:t#T.@a", "urn:t#T.E.Type", "urn:t#G"} <= uris
    assert rows(schemas.facets(nodes), "facet", "value") == [("maxLength", "3")]
    kept, left = schemas.candidates(nodes)
    assert "/xs:schema/xs:complexType[@name='T']" in {r.xpath for r in kept.collect()}
    assert {(r.name, r.matches) for r in left.collect()} == {("E", 2)}
    assert [(r.kind, r.selector, r.fields) for r in schemas.identity_constraints(nodes).collect()] == [("key", "x", ["a", "b"])]
    assert rows(schemas.documentation(nodes), "name", "lang", "text") == [("G", "en", "Doc")]
    schemas.refuse_unsupported(nodes)
    wild = parse_documents(spark.createDataFrame([("d", bytearray(b'<xs:any xmlns:xs="http://www.w3.org/2001/XMLSchema"/>'))], "doc_uri string, content binary"))
    with pytest.raises(UnsupportedConstructError, match="any"):
        schemas.refuse_unsupported(wild)


def test_cases(spark):
    few = schemas.structural_cases(spark, [("a", 0, None), ("b", 1, 2)])
    assert {tuple(sorted(r.case.items())) for r in few.collect()} == {(("a", i), ("b", j)) for i in (0, 1, 5) for j in (1, 2)}
    many = schemas.structural_cases(spark, [(f"p{i}", 0, 1) for i in range(15)])
    cases = [r.case for r in many.collect()]
    pairs = {(i, j, c[f"p{i}"], c[f"p{j}"]) for c in cases for i in range(15) for j in range(i)}
    assert len(pairs) == 15 * 14 // 2 * 4 and len(cases) < 200
    built = schemas.build_documents(few.where("case['a'] = 1 AND case['b'] = 2"), "r", ["a", "b"]).first()
    assert built.xml == "<r><a/><b/><b/></r>"
    leaf = spark.range(1).select(F.struct(F.array().cast("array<string>").alias("enumeration"), F.lit(2).alias("minLength"), F.lit(3).alias("maxLength"), F.lit(None).cast("int").alias("minInclusive"), F.lit(None).cast("int").alias("maxInclusive"), F.lit(None).cast("int").alias("totalDigits")).alias("leaf"))
    values = leaf.select(F.explode(schemas.boundary_values(F.col("leaf"))).alias("v")).select("v.*")
    assert rows(values) == [("a", False), ("aa", True), ("aaa", True), ("aaaa", False)]


def test_drift_stream(spark, tmp_path):
    schema = "doc_uri string, text string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "same  text"), ("b", "other")], schema).write.parquet(source)
    from spanloom.functions.terms import text_hash

    stored = spark.createDataFrame([("a", "same text"), ("b", "text")], schema).select(
        F.col("doc_uri").alias("source_uri"), F.concat(F.lit("p"), "doc_uri").alias("property_shape_iri"), text_hash(F.col("text")).alias("content_hash")
    )
    changes = spark.readStream.schema(schema).parquet(source)
    sweep.start(sweep.drift_stream(changes, stored), out, str(tmp_path / "ck")).awaitTermination(60)
    assert [r.property_shape_iri for r in spark.read.parquet(out).collect()] == ["pb"]
    events = spark.createDataFrame([("k", "l", "CONTENT", "f", "REJECTED", 1), ("k", "l", "CONTENT", "f", "APPROVED", 2), ("k", "m", "CONTENT", "f", "REJECTED", 1)], "fact_key string, leaf_ref string, drift_kind string, fingerprint string, verdict string, at int")
    assert sweep.correction_state(events).count() == 1


def test_cases_at_finite_bounds(spark):
    assert schemas.occurrence_options(0, 10) == [0, 1, 10] and schemas.occurrence_options(10, 20) == [10, 11, 20]
    bounds = [(0, 10), (10, 20), (0, 1), (1, 1), (2, None), (7, None), (2, 2)]
    given = spark.createDataFrame([(i, *b) for i, b in enumerate(bounds)], "i int, low int, high int")
    found = given.select("i", F.explode(schemas.option_column(F.col("low"), F.col("high"))).alias("o")).select("i", "o.n", "o.valid")
    assert rows(found) == sorted((i, n, v) for i, b in enumerate(bounds) for n, v in schemas.marked_options(*b))
    cases = schemas.structural_cases(spark, [("a", 0, 10), ("b", 1, 1)], beyond=True).collect()
    assert {(r.case["a"], r.should_be_valid) for r in cases} == {(0, True), (1, True), (10, True), (11, False)}
    many = schemas.structural_cases(spark, [(f"p{i}", 0, 2) for i in range(8)], beyond=True).collect()
    assert all(r.should_be_valid == (max(r.case.values()) <= 2) for r in many) and any(not r.should_be_valid for r in many)


def test_boundary_values_of_lengths_patterns_and_fractions(spark):
    null = "cast(NULL AS int)"
    leaf = f"struct(cast(array() AS array<string>) AS enumeration, {null} AS minLength, {null} AS maxLength, least AS minInclusive, {null} AS maxInclusive, total AS totalDigits)"
    given = spark.createDataFrame(
        [(0, 2, None, None, None, None), (1, None, "[A-Z]{2}(x|y)+", None, 1, None), (2, None, r"\p{Lu}", None, None, None), (3, None, None, 2, None, 5), (4, None, None, 2, None, 2), (5, None, None, None, None, None), (6, None, None, 1, None, None)],
        "i int, length int, pattern string, fraction int, least int, total int",
    )
    values = schemas.boundary_values(F.expr(leaf), F.col("length"), F.col("pattern"), F.col("fraction"))
    found = rows(given.select("i", F.explode(values).alias("v")).select("i", "v.value", "v.valid"))
    of = lambda i: [(v, valid) for n, v, valid in found if n == i]
    assert of(0) == [("a", False), ("aa", True), ("aaa", False)]
    assert of(1) == [("AAx", True), ("AAx\x01", False)] and of(2) == []
    assert of(3) == [("111.11", True), ("111.111", False), ("1111.11", False)] and of(4) == [("0.11", True), ("0.111", False), ("1.11", False)]
    assert of(5) == [("value", True)] and of(6) == [("1" * 17 + ".1", True), ("1" * 17 + ".11", False)]


def test_add_citations_appends_what_resolves(spark, tmp_path):
    from spanloom import queries

    stored = spark.createDataFrame([("a", "h0")], "doc_id string, reference string")
    resolved = spark.createDataFrame([("a", "RESOLVED", "h1"), ("b", "AMBIGUOUS", None), ("c", "NOT_FOUND", None)], "doc_id string, status string, current_hash string")
    appended, refused = history.add_citations(stored, resolved)
    assert rows(appended) == [("a", "h0"), ("a", "h1")] and rows(refused, "doc_id", "status") == [("b", "AMBIGUOUS"), ("c", "NOT_FOUND")]
    spark.createDataFrame([(i, f"text {i}", "src1") for i in range(60)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["q_add_citations_appended"](spark, str(tmp_path)).groupBy("status").count().collect()
    counts = {r["status"]: r["count"] for r in out}
    assert counts["STORED"] == 60 and counts["RESOLVED"] > 0 and sum(counts.values()) == 120
