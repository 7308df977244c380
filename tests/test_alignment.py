import pytest

from spanloom.errors import EmptyVocabularyError, SssomParseError, UnresolvedObjectError, UnresolvedSubjectError
from spanloom.model import NAMESPACES, iri
from spanloom.operators import align
from spanloom.sources import graphs, sssom

HEAD = "#curie_map:\n#  a: urn:a#\n#  b: urn:b#\n#mapping_set_id: urn:set\n#license: CC0\n"
COLUMNS = "subject_id\tsubject_label\tpredicate_id\tobject_id\tobject_label\tmapping_justification\tconfidence\tauthor_id\n"
ROW = "a:x\tX\tskos:exactMatch\tb:y\tY\tsemapv:ManualMappingCuration\t0.95\ta:me\n"


def load(spark, tmp_path, text):
    path = tmp_path / "m.sssom.tsv"
    path.write_bytes(text.encode())
    return sssom.load_mappings(spark, str(path)).collect()


def test_a_good_row(spark, tmp_path):
    (row,) = load(spark, tmp_path, HEAD + COLUMNS + ROW + "\n  \n")
    assert (row.subject_id, row.object_id, row.confidence, row.line_num) == ("urn:a#x", "urn:b#y", 0.95, 7)
    assert row.predicate_id == NAMESPACES["skos"] + "exactMatch" and row.author_id == "a:me"
    assert sssom.load_header(spark, str(tmp_path / "m.sssom.tsv")) == {"mapping_set_id": "urn:set", "license": "CC0"}


def test_optional_columns_and_extra_ones(spark, tmp_path):
    text = HEAD + "subject_id\tpredicate_id\tobject_id\tmapping_justification\textra\na:x\tskos:exactMatch\tb:y\tsemapv:X\t?\n"
    (row,) = load(spark, tmp_path, text)
    assert (row.subject_label, row.object_label, row.confidence, row.author_id) == (None, None, None, None)


@pytest.mark.parametrize(
    ("text", "said"),
    [
        (HEAD + COLUMNS.replace("predicate_id", "other") + ROW, "predicate_id"),
        (HEAD + COLUMNS + ROW + ROW.replace("0.95", "high"), ":8.*confidence.*high"),
        (HEAD + COLUMNS + "a:x\tX\n", ":7.*columns"),
        (HEAD.replace("b: urn:b#", "broken") + COLUMNS + ROW, ":3.*colon"),
        (HEAD.replace("  b: urn:b#", "  a: urn:c#") + COLUMNS + ROW, "twice"),
        (HEAD + COLUMNS + ROW.replace("b:y", "c:y"), "unknown prefix.*skos"),
        (HEAD + COLUMNS + ROW.replace("b:y", "plain"), "unknown prefix"),
        ("", "no column header"),
        (HEAD, "no column header"),
        (HEAD + ROW, "subject_id"),
        (HEAD + COLUMNS + ROW + ROW.replace("a:x", ""), ":8.*subject_id"),
    ],
)
def test_faults_name_file_and_line(spark, tmp_path, text, said):
    with pytest.raises(SssomParseError, match=said) as caught:
        load(spark, tmp_path, text)
    assert "m.sssom.tsv" in str(caught.value)


def test_built_in_prefixes_win(spark, tmp_path):
    text = HEAD.replace("#  b:", "#  skos: urn:no#\n#  b:") + COLUMNS + ROW
    assert load(spark, tmp_path, text)[0].predicate_id == NAMESPACES["skos"] + "exactMatch"


def graph(spark, *rows):
    return spark.createDataFrame([("", s, "iri", align.TYPE, iri(o), "iri", "", "") for s, o in rows], graphs.TRIPLES)


def test_validation_checks_in_order_and_lists_all(spark, tmp_path):
    path = tmp_path / "m.sssom.tsv"
    path.write_text(HEAD + COLUMNS + ROW + ROW.replace("a:x", "a:z").replace("b:y", "b:w"))
    mappings = sssom.load_mappings(spark, str(path))
    shapes = graph(spark, ("urn:a#x", "sh:PropertyShape"), ("urn:a#z", "sh:PropertyShape"))
    terms = graph(spark, ("urn:b#y", "owl:Class"), ("urn:b#w", "owl:NamedIndividual"))
    align.validate_mappings(mappings, shapes, terms)
    empty = terms.limit(0)
    with pytest.raises(UnresolvedSubjectError, match="urn:a#x.*; .*urn:a#z"):
        align.validate_mappings(mappings, empty, empty)
    with pytest.raises(EmptyVocabularyError):
        align.validate_mappings(mappings, shapes, shapes)
    with pytest.raises(EmptyVocabularyError):
        align.validate_mappings(mappings.limit(0), shapes, empty)
    with pytest.raises(UnresolvedObjectError, match="urn:b#w"):
        align.validate_mappings(mappings, shapes, terms.limit(1))
    assert align.mapping_triples(mappings.union(mappings)).count() == 2


def test_vocabulary(spark, tmp_path, monkeypatch):
    text = (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
        '<owl:Class rdf:about="urn:c"><rdfs:label xml:lang="en">All &amp; given</rdfs:label><rdfs:subClassOf rdf:resource="urn:d"/></owl:Class></rdf:RDF>'
    )
    path = tmp_path / "v.owl"
    path.write_text(text)
    monkeypatch.setenv(graphs.VOCABULARY_VARIABLE, str(path))
    rows = {(r.p.split("#")[1], r.o, r.o_kind, r.o_lang) for r in graphs.load_vocabulary(spark).collect()}
    assert rows == {("type", iri("owl:Class"), "iri", ""), ("label", "All & given", "literal", "en"), ("subClassOf", "urn:d", "iri", "")}
