"""Schema components, and paths that find them again."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import history, schemas
from spanloom.plans.lineage import cut_unsized
from spanloom.sources.xml_nodes import parse_documents

HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:t" targetNamespace="urn:t">'


def nodes(spark, *texts):
    rows = [(f"d{i}", bytearray((HEAD + t + "</xs:schema>").encode())) for i, t in enumerate(texts)]
    return parse_documents(spark.createDataFrame(rows, "doc_uri string, content binary")).cache()


def test_candidates_are_what_resolution_finds(spark):
    foreign = '<xs:annotation><xs:appinfo><f:w xmlns:f="urn:f"><xs:element name="F"/></f:w>{}</xs:appinfo></xs:annotation>'
    table = nodes(
        spark,
        foreign.format("") + '<xs:element name="A"/><xs:element name="it\'s"/>',
        foreign.format('<w><xs:element name="F"/></w>'),
        '<xs:element name="B"><xs:complexType><xs:sequence><xs:element name="C"/></xs:sequence></xs:complexType>'
        '<xs:complexType name="N"><xs:sequence><xs:element name="C"/></xs:sequence></xs:complexType></xs:element>',
    )
    kept, left = schemas.candidates(table)
    assert {(r.doc_uri, r.name) for r in kept.collect()} == {("d0", "A"), ("d1", "F"), ("d2", "B"), ("d2", "N"), ("d2", "C")}
    assert sorted((r.doc_uri, r.name, r.matches) for r in left.collect()) == [("d0", "F", 0), ("d0", "it's", 0), ("d1", "F", 1), ("d2", "C", 2)]


def test_ancestor_chains_of_deep_documents(spark):
    depth = 70
    text = "".join(f'<xs:element name="e{i}">' for i in range(depth)) + "</xs:element>" * depth
    found = {r.name: r.uri for r in schemas.components(nodes(spark, text)).collect()}
    assert found == {f"e{i}": "urn:t#" + ".".join(f"e{k}" for k in range(i + 1)) for i in range(depth)}


def test_members_of_types(spark):
    """Groups in place, base types first, attribute groups, unnamed types, several documents; cycles are told apart."""
    one = (
        '<xs:group name="G"><xs:sequence><xs:element name="g"/><xs:group ref="t:H" minOccurs="0"/></xs:sequence></xs:group>'
        '<xs:group name="H"><xs:choice><xs:element ref="t:h" maxOccurs="unbounded"/></xs:choice></xs:group>'
        '<xs:attributeGroup name="AG"><xs:attribute name="x"/></xs:attributeGroup>'
        '<xs:complexType name="Base"><xs:sequence><xs:group ref="t:G"/><xs:element name="b"><xs:complexType><xs:attribute name="inner"/></xs:complexType></xs:element></xs:sequence></xs:complexType>'
        '<xs:complexType name="Mid"><xs:complexContent><xs:extension base="t:Base"/></xs:complexContent></xs:complexType>'
        '<xs:complexType name="Top"><xs:complexContent><xs:extension base="t:Mid"><xs:sequence><xs:element name="t" minOccurs="2" maxOccurs="3"/></xs:sequence>'
        '<xs:attributeGroup ref="t:AG"/></xs:extension></xs:complexContent></xs:complexType>'
        '<xs:complexType name="Text"><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="y"/></xs:extension></xs:simpleContent></xs:complexType>'
    )
    circle = (
        '<xs:group name="G"><xs:sequence><xs:element name="other"/><xs:group ref="t:G"/></xs:sequence></xs:group>'
        '<xs:complexType name="C"><xs:sequence><xs:group ref="t:G"/><xs:group ref="t:absent"/></xs:sequence></xs:complexType>'
    )
    members, cycles = schemas.type_members(nodes(spark, one, circle))
    got = {}
    for r in members.orderBy("doc_uri", "pre", "position").collect():
        got.setdefault((r.doc_uri, r.type_name), []).append((r.member, r.owner))
    base = [("g", "G"), ("h", "H"), ("b", "Base")]
    assert got == {
        ("d0", "Base"): base, ("d0", "Mid"): base, ("d0", "Top"): [*base, ("t", "Top"), ("x", "AG")], ("d0", None): [("inner", None)], ("d0", "Text"): [("y", "Text")],
        ("d1", "C"): [("other", "G"), ("absent", "C")],
    }
    bounds = {r.member: (r.low, r.high) for r in members.where("type_name = 'Top'").collect()}
    assert bounds["t"] == (2, 3) and bounds["h"] == (1, None)
    assert cycles.count() == 1


def test_members_of_unions(spark):
    text = (
        '<xs:simpleType name="U"><xs:union memberTypes="t:V  xs:date"><xs:simpleType><xs:restriction base="xs:string"/></xs:simpleType></xs:union></xs:simpleType>'
        '<xs:simpleType name="V"><xs:union memberTypes="t:W xs:int"/></xs:simpleType><xs:simpleType name="W"><xs:restriction base="xs:string"/></xs:simpleType>'
        '<xs:simpleType name="R"><xs:union memberTypes="t:R xs:int"/></xs:simpleType>'
    )
    found = schemas.union_members(nodes(spark, text)).orderBy("type_name", "position").collect()
    assert [(r.type_name, r.member) for r in found] == [("R", "xs:int"), ("U", "W"), ("U", "xs:int"), ("U", "xs:date"), ("U", None), ("V", "W"), ("V", "xs:int")]


def test_covering_rows():
    rng = random.Random(2)
    for sizes in ([2] * 15, [3] * 12, [2, 3, 4, 1, 2, 4, 3, 3], [5, 2], [4], [], [2] * 60):
        table = schemas.covering_rows(sizes)
        for i in range(len(sizes)):
            for j in range(i):
                assert len({(a, b) for a, b in table[:, [i, j]].tolist()}) == sizes[i] * sizes[j]
        assert (table < np.array(sizes)).all()
    assert len(schemas.covering_rows([2] * 15)) < 20 and len(schemas.covering_rows([2] * 60)) < 30
    for _ in range(20):
        sizes = [rng.randint(1, 5) for _ in range(rng.randint(2, 9))]
        assert len(schemas.covering_rows(sizes)) <= 4 * max(a * b for i, a in enumerate(sizes) for b in sizes[:i])


def test_cases_of_many_models(spark):
    rows = [("few", i, f"p{i}", 0, 1) for i in range(3)] + [("many", i, f"p{i}", 0, 1) for i in range(15)] + [("high", i, f"p{i}", 0, 2) for i in range(9)]
    models = spark.createDataFrame(rows, "model string, place int, name string, low int, high int")
    cases = {}
    for r in schemas.model_cases(models, beyond=True).collect():
        cases.setdefault((r.model, r.case_id), []).append((r.place, r.n, r.should_be_valid))
    count = lambda m: sum(k[0] == m for k in cases)
    assert count("few") == 8 and count("many") < 100 and count("high") < 100
    for (model, _), case in cases.items():
        assert len(case) == sum(r[0] == model for r in rows) and all(v == all(n <= (2 if model == "high" else 1) for _, n, _ in case) for *_, v in case)
    single = schemas.one_factor_cases(models.where("model = 'few'")).collect()
    assert sorted((r.name, r.n, tuple(c.n for c in r.case)) for r in single) == sorted((f"p{i}", n, tuple(n if k == i else 0 for k in range(3))) for i in range(3) for n in (0, 1))


def test_references_of_references(spark):
    """Leaves in order with their checks, as deep as one likes in a plan of one size; a circle is an error."""
    parts = [("u", 1, "b"), ("u", 2, "v"), ("v", 2, "a"), ("v", 1, "u2"), ("u2", 1, "c"), ("w", 1, "w1"), ("w1", 1, "w")]
    deep = [(f"n{i}", 0, f"n{i + 1}") for i in range(40)]
    frame = spark.createDataFrame(parts + deep, "ref_id string, place int, part_ref_id string")
    checked = spark.createDataFrame([("a", False, "RESOLVED"), ("c", True, "AMBIGUOUS"), ("n40", True, "RESOLVED")], "leaf string, changed boolean, current_status string")
    roots = lambda *names: spark.createDataFrame([(n,) for n in names], "ref_id string")
    found = history.check_references(frame, roots("u", "alone"), checked)
    assert sorted(tuple(r) for r in found.collect()) == [
        ("alone", 0, "alone", True, "NOT_FOUND"), ("u", 0, "b", True, "NOT_FOUND"), ("u", 1, "c", True, "AMBIGUOUS"), ("u", 2, "a", False, "RESOLVED"),
    ]
    far = history.check_references(frame, roots("n0"), checked)
    size = lambda f: len(f._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert [tuple(r) for r in far.collect()] == [("n0", 0, "n40", True, "RESOLVED")] and size(far) == size(found)
    with pytest.raises(ValueError, match="circle"):
        history.check_references(frame, roots("w"), checked)
    with pytest.raises(ValueError, match="deeper"):
        history.check_references(frame, roots("n0"), checked, depth=5)


def test_references_folded_from_their_leaves(spark):
    parts = spark.createDataFrame([("u", 2, "v"), ("u", 1, "a"), ("v", 1, "b"), ("v", 2, "c"), ("w", 1, "u"), ("w", 2, "a")], "ref_id string, place int, part_ref_id string")
    leaves = spark.createDataFrame([(k, json.dumps({"family": k}), f"h{k}") for k in "abc"], "ref_id string, document string, digest string")
    found = {r.ref_id: (json.loads(r.document), r.digest) for r in history.fold_references(parts, leaves).collect()}
    a, b, c = ({"family": k} for k in "abc")
    digest = lambda *d: hashlib.sha256("|".join(d).encode()).hexdigest()
    v = digest("hb", "hc")
    assert found["v"] == ({"parts": [b, c]}, v) and found["u"] == ({"parts": [a, {"parts": [b, c]}]}, digest("ha", v))
    assert found["w"] == ({"parts": [{"parts": [a, {"parts": [b, c]}]}, a]}, digest(digest("ha", v), "ha")) and len(found) == 6
    with pytest.raises(ValueError, match="circle"):
        history.fold_references(parts.union(spark.createDataFrame([("x", 1, "y"), ("y", 1, "x")], parts.schema)), leaves)


def test_documentation_pairs(spark):
    told = [("d", "A", "de", "x"), ("d", "A", "en", "y"), ("d", "B", None, "x"), ("d", "C", "de", "x"), ("d", "D", "de", "x"), ("d", "E", "en", "only")]
    seen = [("B", "one"), ("B", "two"), ("B", "one"), ("C", "one"), ("A", "p"), ("A", "q")]
    pairs = schemas.documentation_pairs(
        spark.createDataFrame(told, "doc_uri string, name string, lang string, text string"), spark.createDataFrame(seen, "name string, text string"),
        spark.createDataFrame([("A", ["empty"]), ("C", ["empty"])], "name string, issues array<string>"),
    )
    assert {r.name: (r.state, r.candidates, r.issues) for r in pairs.collect()} == {
        "A": ("matched", None, ["empty"]), "B": ("ambiguous", ["one", "two"], None), "C": ("unmatched", None, None), "D": ("unmatched", None, None),
    }


def test_texts_of_pages_are_not_broadcast_on_an_estimate(spark):
    told = spark.createDataFrame([("d", "A", "de", "x")], "doc_uri string, name string, lang string, text string")
    seen = spark.createDataFrame([("A", "p")], "name string, text string")
    plan = schemas.documentation_pairs(told, seen, spark.createDataFrame([], "name string, issues array<string>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 1 and "SortMergeJoin" in plan


def test_exclusive_bounds(spark):
    null = "cast(NULL AS int)"
    leaf = F.expr(f"struct(cast(array() AS array<string>) AS enumeration, {null} AS minLength, {null} AS maxLength, {null} AS minInclusive, 9 AS maxInclusive, {null} AS totalDigits)")
    frame = spark.range(1).select(F.explode(schemas.boundary_values(leaf, above=F.lit(3), below=F.lit(100))).alias("v")).select("v.*")
    assert sorted((int(r.value), r.valid) for r in frame.collect()) == [(3, False), (4, True), (9, True), (10, False)]
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_paths_are_joined_by_what_was_measured(spark):
    """Node tables that have been cut, with whatever small estimate, aren't planned to go through the driver."""
    table = cut_unsized(nodes(spark, '<xs:element name="A"/>'))
    plan = schemas.minted_paths(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "Broadcast" not in schemas.type_members(table)[0]._jdf.queryExecution().executedPlan().toString()


def test_large_models_have_few_cases(spark):
    """Rows grow with the logarithm of the particles, and covered pairs are counted by blocks."""
    rng = random.Random(3)
    for sizes in ([3, 2, 2] * 60, [rng.randint(1, 4) for _ in range(90)], [rng.randint(1, 6) for _ in range(70)]):
        table = schemas.covering_rows(sizes)
        assert (table >= 0).all() and (table < np.array(sizes)).all()
        for i in range(len(sizes)):
            for j in range(i):
                assert len({(a, b) for a, b in table[:, [i, j]].tolist()}) == sizes[i] * sizes[j]
    assert len(schemas.covering_rows([2, 2, 3] * 800)) < 60
    rows = [("a", i, f"p{i}", 0, (1, None)[i % 2]) for i in range(70)] + [("b", i, f"p{i}", 1, 3) for i in range(4)] + [("c", 1, "p", 1, 1)]
    cases = schemas.model_cases(spark.createDataFrame(rows, "model string, place int, name string, low int, high int"), beyond=True).cache()
    by_case = {}
    for r in cases.collect():
        by_case.setdefault((r.model, r.case_id), []).append((r.place, r.n, r.should_be_valid))
    pairs = {m: {(*a[:2], *b[:2]) for k, c in by_case.items() if k[0] == m for a in c for b in c if a[0] < b[0]} for m in "abc"}
    options, strip = schemas.OPTIONS, schemas.STRIP
    try:
        schemas.OPTIONS, schemas.STRIP = 7, 3
        found = {r.model: (r.particles, r.cases, r.all_valid, r.pairs) for r in schemas.case_report(cases).collect()}
    finally:
        schemas.OPTIONS, schemas.STRIP = options, strip
    assert found == {
        m: (n, sum(k[0] == m for k in by_case), all(v for k, c in by_case.items() if k[0] == m for *_, v in c), len(pairs[m])) for m, n in (("a", 70), ("b", 4), ("c", 1))
    }
