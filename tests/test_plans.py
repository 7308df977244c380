import io
import zipfile

import pytest

from spanloom.errors import TransformationError
from spanloom.plans import patterns, transform

SCHEMA = "graph string, s string, p string, o string"


@pytest.fixture
def triples(spark):
    rows = [("", "x", "urn:p", "y"), ("", "y", "urn:p", "z"), ("", "x", "urn:n", "X"), ("g", "z", "urn:n", "Z")]
    return spark.createDataFrame(rows, SCHEMA)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_patterns(triples):
    chain = patterns.match(triples, [("?a", "urn:p", "?b"), ("?b", "urn:p", "?c")])
    assert [r.asDict() for r in chain.collect()] == [{"a": "x", "b": "y", "c": "z"}]
    assert rows(patterns.one(triples, ("?a", "urn:n", "?n"), graph="g")) == [("z", "Z")]
    assert rows(patterns.path_star(triples, "urn:p")) == [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    edges, names = patterns.one(triples, ("?a", "urn:p", "?b")), patterns.one(triples, ("?a", "urn:n", "?n"))
    assert rows(patterns.optional(edges, names)) == [("x", "y", "X"), ("y", "z", None)]
    assert rows(patterns.minus(edges, names)) == [("y", "z")]
    assert rows(patterns.minus(edges, names.select("n"))) == rows(edges)
    assert rows(patterns.exists(edges, names)) == [("x", "y")]
    with pytest.raises(ValueError, match="share no variable"):
        patterns.match(triples, [("?a", "urn:p", "?b"), ("?c", "urn:n", "?d")])


@pytest.fixture
def registered():
    names = []

    def add(name, **options):
        names.append(name)
        return transform.register(transform.Transformation(name, **options))

    yield add
    for name in names:
        transform.unregister(name)


def test_registry(registered):
    one = registered("one", query=lambda t: t, renderer=len)
    assert transform.get("one") is one
    with pytest.raises(ValueError, match="already registered"):
        transform.register(one)
    transform.register(one, replace=True)
    with pytest.raises(KeyError, match="one"):
        transform.get("two")
    transform.unregister("two")
    for bad in (-1, True, 1.5):
        with pytest.raises(ValueError, match="min_rows"):
            transform.Transformation("x", len, len, bad)


def test_stages_of_failure(triples, registered):
    def names(t):
        return patterns.one(t, ("?a", "urn:n", "?n"))

    registered("good", query=names, renderer=transform.text_renderer("{{ a }}={{n}}\n"))
    assert sorted(transform.apply_transformation(triples, "good").split()) == ["x=X", "z=Z"]
    registered("no frame", query=lambda t: True, renderer=len)
    with pytest.raises(TransformationError, match="SELECT"):
        transform.apply_transformation(triples, "no frame")
    registered("lazy", query=lambda t: t.selectExpr("raise_error('boom')"), renderer=len)
    with pytest.raises(TransformationError, match="lazy: query failed"):
        transform.apply_transformation(triples, "lazy")
    registered("few", query=lambda t: names(t).limit(0), renderer=len)
    with pytest.raises(TransformationError, match="returned 0 row.*at least 1"):
        transform.apply_transformation(triples, "few")
    registered("none", query=lambda t: names(t).limit(0), renderer=len, min_rows=0)
    assert transform.apply_transformation(triples, "none") == 0
    registered("unbound", query=lambda t: names(t).selectExpr("a", "CAST(NULL AS string) AS n"), renderer=transform.text_renderer("{{ n }}"))
    with pytest.raises(TransformationError, match="renderer failed: KeyError"):
        transform.apply_transformation(triples, "unbound")
    with pytest.raises(KeyError):
        transform.apply_transformation(triples, "unknown")


def test_renderers():
    with pytest.raises(ValueError, match="template"):
        transform.text_renderer("{{ a.__class__ }}")
    book = transform.workbook_renderer(["a", "b"])([{"a": "<x>", "b": 2}])
    sheet = zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet1.xml").decode()
    assert "&lt;x&gt;" in sheet and "<v>2</v>" in sheet
    with pytest.raises(KeyError):
        transform.workbook_renderer(["a"])([{}])


def test_matches_are_not_broadcast_on_an_estimate(spark, tmp_path):
    """Triples unfolded from a small file are not sent through the driver."""
    path = f"{tmp_path}/cited"
    spark.range(20000).selectExpr("concat('urn:x', id % 7) AS s", "id").write.parquet(path)
    triples = spark.read.parquet(path).selectExpr("'' AS graph", "concat(s, '/', id) AS s", "explode(array('urn:p', 'urn:q')) AS p", "repeat(s, 50) AS o")
    found = patterns.match(triples, [("?a", "urn:p", "?x"), ("?a", "urn:q", "?y")])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 20000
