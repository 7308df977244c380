"""Schemas and fixed names of the data model."""

from __future__ import annotations

from enum import Enum

#: Namespaces of the vocabularies in use.
NAMESPACES = {
    "sh": "http://www.w3.org/ns/shacl#",
    "prov": "http://www.w3.org/ns/prov#",
    "oa": "http://www.w3.org/ns/oa#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "dash": "http://datashapes.org/dash#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "semapv": "https://w3id.org/semapv/vocab/",
    "gen": "urn:spanloom:annotation#",
}
XS = "http://www.w3.org/2001/XMLSchema"


def iri(curie: str) -> str:
    """The IRI of a prefixed name of :data:`NAMESPACES`."""
    prefix, _, local = curie.partition(":")
    return NAMESPACES[prefix] + local


class ResolutionStatus(str, Enum):
    RESOLVED = "RESOLVED"
    NOT_FOUND = "NOT_FOUND"
    AMBIGUOUS = "AMBIGUOUS"
    UNCITABLE = "UNCITABLE"


XPATH_SELECTOR, SVG_SELECTOR, JSON_SELECTOR, TEXT_SELECTOR = "oa:XPathSelector", "oa:SvgSelector", "json", "text"

#: '' and not NULL for datatype and language, so that every pattern is a plain equi-join.
TRIPLES = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
CITATION = (
    "property_shape_iri string, node_shape_iri string, standard string, shape_name string, property_name string, "
    "selector_type string, selector_value string, page int, source_uri string, content_hash string, "
    "sh_name string, sh_order int, dash_editor string"
)
XML_NODE = (
    "doc_uri string, pre int, size int, level int, parent_pre int, kind string, ns string, local string, "
    "prefix string, value string, attrs map<string,string>"
)
PDF_WORD = "doc_uri string, page int, text string, x0 double, x1 double, top double, bottom double"
PDF_BOX = "doc_uri string, page int, kind string, x0 double, top double, x1 double, bottom double"
PDF_PAGE = "doc_uri string, page_count int"
MAPPING = (
    "subject_id string, subject_label string, predicate_id string, object_id string, object_label string, "
    "mapping_justification string, confidence double, author_id string, src_path string, line_num int"
)
