import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from spanloom.errors import PropertyShapeNotFoundError, StoreError
from spanloom.model import iri
from spanloom.operators import annotate
from spanloom.plans.store import CitationStore, git_commit, unchanged

NEW = "standard string, shape_name string, property_name string, xpath string, source_uri string, content_hash string"


def citations(spark, *rows):
    return annotate.annotate_xpath(spark.createDataFrame(rows, NEW))


def test_stars(spark):
    rows = citations(spark, ("S", "N", "p", "/a", "urn:x", "sha256:1"), ("S", "N", "q", "/b", "urn:x", "sha256:2"))
    triples = annotate.star_triples(rows)
    assert triples.count() == 12 + 11  # the node shape is one
    assert annotate.union_graphs(triples, triples).count() == 23
    assert triples.where(triples.p == iri("sh:property")).count() == 2
    region = spark.createDataFrame([("S", "N", "r", 3, "0,0 1,0 1,1", "urn:x", "h")], "standard string, shape_name string, property_name string, page int, points string, source_uri string, content_hash string")
    pages = annotate.star_triples(annotate.annotate_svg(region))
    assert pages.count() == 13 and pages.where(pages.p == iri("gen:page")).first().o_dt == iri("xsd:integer")
    with pytest.raises(PySparkException, match="three points"):
        annotate.annotate_svg(region.selectExpr("* EXCEPT (points)", "'0,0 1,1' AS points")).collect()


def test_upsert_replaces_whole_and_patches_keep(spark):
    old = citations(spark, ("S", "N", "p", "/a", "urn:x", "h1"), ("S", "N", "q", "/b", "urn:x", "h2"))
    shape = old.where("property_name = 'p'").first().property_shape_iri
    hints = "property_shape_iri string, sh_name string, sh_order int, dash_editor string"
    named = annotate.patch_hints(old, spark.createDataFrame([(shape, "Name", 1, None)], hints))
    again = annotate.patch_hints(named, spark.createDataFrame([(shape, None, 2, None)], hints))
    row = again.where("property_name = 'p'").first()
    assert (row.sh_name, row.sh_order, row.dash_editor) == ("Name", 2, None)
    merged = annotate.upsert(again, citations(spark, ("S", "N", "p", "/c", "urn:x", "h3"))).orderBy("property_name").collect()
    assert [(r.content_hash, r.sh_name) for r in merged] == [("h3", None), ("h2", None)]
    with pytest.raises(PropertyShapeNotFoundError):
        annotate.patch_hints(old, spark.createDataFrame([("urn:none", "x", None, None)], hints))


def test_order_only_where_all_have_one(spark):
    rows = spark.createDataFrame([("n", "n/b", 1), ("n", "n/a", 2), ("m", "m/b", 1), ("m", "m/a", None)], "node_shape_iri string, property_shape_iri string, sh_order int")
    got = annotate.property_order(rows).orderBy("node_shape_iri", "place").collect()
    assert [r.property_shape_iri for r in got] == ["m/a", "m/b", "n/b", "n/a"]


def test_store(spark, tmp_path, monkeypatch):
    for who in ("AUTHOR", "COMMITTER"):
        monkeypatch.setenv(f"GIT_{who}_NAME", "t")
        monkeypatch.setenv(f"GIT_{who}_EMAIL", "t@example.org")
    store = CitationStore(spark, str(tmp_path / "store")).open()
    first = citations(spark, ("A_B", "N", "p", "/a", "urn:x", "h1"), ("A-B", "N/§ ü", "p", "/a", "urn:x", "h2"))
    assert store.write(first) and not store.write(first)
    assert store.write(citations(spark, ("A_B", "N", "q", "/a", "urn:x", "h3")))
    assert {r.property_name for r in store.read_shape("A_B", "N").collect()} == {"p", "q"}
    assert store.read_shape("A-B", "N/§ ü").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_shape("A_B", "other")
    store.export_turtle(str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("*.ttl"))
    assert len(files) == 2 and all("@prefix sh:" in f.read_text() for f in files)
    from spanloom.sources.graphs import read_turtle

    wanted = annotate.star_triples(store.read())
    again = read_turtle(spark, str(tmp_path / "out" / "shapes" / "*" / "*.ttl"))
    assert unchanged(again, wanted.select(*again.columns)), (again.exceptAll(wanted).collect()[:2], wanted.exceptAll(again).collect()[:2])
    assert git_commit(str(tmp_path / "out"), "shapes", "first") and not git_commit(str(tmp_path / "out"), "shapes", "again")
    with pytest.raises(StoreError, match="git add"):
        git_commit(str(tmp_path / "out"), "nowhere", "x")
    (tmp_path / "file").write_text("x")
    with pytest.raises(StoreError, match="existing file"):
        CitationStore(spark, str(tmp_path / "file")).open()
    assert not unchanged(first, first.limit(1))


def test_writes_touch_their_standards_only(spark, tmp_path):
    """Other standards' files stay; a write that breaks before its manifest leaves the old state; a second writer is refused."""
    place = tmp_path / "store"
    store = CitationStore(spark, f"file://{place}").open()
    assert store.read().count() == 0
    store.write(citations(spark, ("A", "N", "p", "/a", "urn:x", "h1"), ("B", "N", "p", "/a", "urn:x", "h2")))
    before = store.manifest()[1]
    store.write(citations(spark, ("B", "N", "q", "/a", "urn:x", "h3")))
    after = store.manifest()[1]
    a, b = (store.read().where(F.col("standard") == k).first().standard_slug for k in "AB")
    assert before[a] == after[a] and before[b] != after[b] and store.read().count() == 3

    def broken(*_):
        raise OSError("the machine is gone")

    put, store.folder.put = store.folder.put, broken
    with pytest.raises(OSError, match="gone"):
        store.write(citations(spark, ("B", "N", "q", "/b", "urn:x", "h4")))
    assert {r.content_hash for r in store.read().collect()} == {"h1", "h2", "h3"}
    store.folder.put = lambda text, *parts: put("{}", *parts) and put(text, *parts)  # another writer takes the number
    with pytest.raises(StoreError, match="came first"):
        store.write(citations(spark, ("B", "N", "q", "/b", "urn:x", "h4")))
    store.folder.put = put
    (place / "_manifest" / "000000000003.json").unlink()
    moved = store.read().where("content_hash = 'h1'").drop("standard_slug", "shape_slug").withColumn("standard", F.lit("B"))
    assert store.write(moved)  # a property shape moves to another standard: both are written, one is left without rows
    assert store.manifest()[1].keys() == {b} and store.read().count() == 3
    store.clean()
    assert len(list(place.rglob("*.parquet"))) == 1 and store.read().count() == 3
