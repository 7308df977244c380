"""Vocabulary graphs in RDF/XML, and Turtle text of citations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAMESPACES, TRIPLES
from .xml_nodes import parse_documents

_RDF = NAMESPACES["rdf"]
_XML = "http://www.w3.org/XML/1998/namespace"
#: Names a vocabulary file when the caller passes none; read when the plan is built.
VOCABULARY_VARIABLE = "SPANLOOM_VOCABULARY"


def vocabulary_path(path: str | None = None, default: str = "vocabulary.owl") -> str:
    return path or os.environ.get(VOCABULARY_VARIABLE) or default


def triples_of_nodes(nodes: DataFrame, graph: str = "") -> DataFrame:
    """Triples of RDF/XML node tables: typed nodes with rdf:about, one level of property elements."""
    about = F.coalesce(F.element_at("attrs", "rdf:about"), F.concat(F.lit("_:"), F.sha2(F.concat_ws("|", "doc_uri", "pre"), 256)))
    subjects = nodes.where((F.col("kind") == "element") & (F.col("level") == 1)).select(
        "doc_uri", "pre", about.alias("s"), F.concat("ns", "local").alias("type")
    )
    text = nodes.where("kind = 'text'").groupBy("doc_uri", F.col("parent_pre").alias("pre")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("text")
    )
    properties = (
        nodes.where((F.col("kind") == "element") & (F.col("level") == 2))
        .select("doc_uri", "pre", "parent_pre", F.concat("ns", "local").alias("p"), "attrs")
        .join(subjects.select("doc_uri", F.col("pre").alias("parent_pre"), "s"), ["doc_uri", "parent_pre"])
        .join(text, ["doc_uri", "pre"], "left")
    )
    resource = F.element_at("attrs", "rdf:resource")
    s_kind = F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri").alias("s_kind")
    none = F.lit("")
    typed = subjects.where(F.col("type") != _RDF + "Description").select(
        F.lit(graph).alias("graph"), "s", s_kind, F.lit(_RDF + "type").alias("p"), F.col("type").alias("o"),
        F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"),
    )
    stated = properties.select(
        F.lit(graph).alias("graph"), "s", s_kind, "p", F.coalesce(resource, "text", none).alias("o"),
        F.when(resource.isNotNull(), "iri").otherwise("literal").alias("o_kind"),
        F.coalesce(F.element_at("attrs", "rdf:datatype"), none).alias("o_dt"),
        F.coalesce(F.element_at("attrs", "xml:lang"), none).alias("o_lang"),
    )
    return typed.unionByName(stated).dropDuplicates()


def load_vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    files = spark.read.format("binaryFile").load(vocabulary_path(path))
    return triples_of_nodes(parse_documents(files.select(F.col("path").alias("doc_uri"), "content")))


def turtle_lines(triples: DataFrame) -> DataFrame:
    """(graph, subject, text): one Turtle statement for each subject, predicates and objects in order."""
    escaped = F.col("o")
    for found, better in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(found), F.lit(better))

    def node(kind: str, value: str):
        return F.when(F.col(kind) == "iri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(F.concat(F.lit("_:b"), F.substr(value, F.lit(3))))

    literal = F.concat(
        F.lit('"'), escaped, F.lit('"'),
        F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt") != "", F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise(""),
    )
    target = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o_kind", "o"))
    pairs = F.array_sort(F.collect_set(F.struct(F.concat(F.lit("<"), "p", F.lit("> ")).alias("p"), target.alias("o"))))
    return triples.groupBy("graph", "s", "s_kind").agg(pairs.alias("pairs")).select(
        "graph",
        "s",
        F.concat(node("s_kind", "s"), F.lit(" "), F.array_join(F.transform("pairs", lambda x: F.concat(x["p"], x["o"])), " ;\n    "), F.lit(" .\n")).alias("text"),
    )


def turtle_header() -> str:
    return "".join(f"@prefix {p}: <{NAMESPACES[p]}> .\n" for p in ("sh", "gen", "prov", "oa", "rdf", "dash")) + "\n"


#: A statement of the written subset: a subject, then predicates in angle brackets with one object each.
_STATEMENT = r"(?s)^(<[^>]*>|_:\S+) (.*) \.$"
_PAIR = r"(?s)<([^>]*)> (<[^>]*>|_:\S+|\"(?:[^\"\\\\]|\\\\.)*\"(?:@[\w-]+|\^\^<[^>]*>)?)"


def read_turtle(spark: SparkSession, path: str, graph: str = "") -> DataFrame:
    """Triples of files in the form that :func:`turtle_lines` writes; other Turtle is not read."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", " \\.\n")).alias("text"))
    body = F.concat(F.regexp_replace("text", r"(?m)^@prefix .*\.$|^\s+", ""), F.lit(" ."))
    found = text.select(F.regexp_extract(body, _STATEMENT, 1).alias("subject"), F.regexp_extract(body, _STATEMENT, 2).alias("rest")).where("subject <> ''")
    pairs = found.select("subject", F.explode(F.arrays_zip(F.regexp_extract_all("rest", F.lit(_PAIR), F.lit(1)).alias("p"), F.regexp_extract_all("rest", F.lit(_PAIR), F.lit(2)).alias("o"))).alias("x"))
    o = F.col("x.o")
    literal = o.startswith('"')
    plain = F.regexp_extract(o, r'(?s)^"(.*)"(?:@[\w-]+|\^\^<[^>]*>)?$', 1)
    for found_, better in (("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        plain = F.replace(plain, F.lit(found_), F.lit(better))
    iri_ = F.regexp_replace(o, "^<|>$", "")
    bare = lambda c: F.when(c.startswith("_:b"), F.concat(F.lit("_:"), F.substr(c, F.lit(4)))).otherwise(F.regexp_replace(c, "^<|>$", ""))
    return pairs.select(
        F.lit(graph).alias("graph"), bare(F.col("subject")).alias("s"), F.when(F.col("subject").startswith("_:"), "bnode").otherwise("iri").alias("s_kind"),
        F.col("x.p").alias("p"), F.when(literal, plain).when(o.startswith("_:"), bare(o)).otherwise(iri_).alias("o"),
        F.when(literal, "literal").when(o.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.when(literal, F.regexp_extract(o, r'\^\^<([^>]*)>$', 1)).otherwise("").alias("o_dt"),
        F.when(literal, F.regexp_extract(o, r'"@([\w-]+)$', 1)).otherwise("").alias("o_lang"),
    ).dropDuplicates()


__all__ = ["read_turtle", "TRIPLES", "load_vocabulary", "triples_of_nodes", "turtle_header", "turtle_lines", "vocabulary_path"]
