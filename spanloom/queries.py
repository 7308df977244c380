"""The registered queries of the library over the driver's tables, and their SQL.

Roles of the tables: ``documents`` are source documents (``source`` the family, ``text`` the
span), ``pages`` markup, ``labels`` reviews (quality 1 approves, toxic 1 rejects), ``events``
decisions and revisions, ``conversations`` ordered parts of a union, ``part`` citations
(p_brand the standard, p_type the shape, p_name with the key the property), ``nation`` and ``region`` the
vocabulary, ``supplier`` and ``customer`` mappings. Today's documents are a fixed mutation of
the stored ones: of ten ids, 3 is changed, 5 doubled and 7 gone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, pointer, terms
from .model import NAMESPACES, iri
from .operators import align, annotate, audit, drift, history, resolve, schemas
from .plans import patterns
from .plans.lineage import cut
from .plans.store import unchanged
from .sources.xml_nodes import parse_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
GEN = NAMESPACES["gen"]

#: SQL for the canonical text and its hash, and for a citation's IRI.
_CANON = r"trim(regexp_replace({0}, '[ \t\n\r\f\x0b]+', ' ', 'g'))"
_HASH = "'sha256:' || sha256(" + _CANON + ")"
_SHAPE = f"'{GEN}' || url_encode(p_brand) || '/' || url_encode(p_type) || '/' || url_encode(p_name || ' ' || p_partkey)"
#: SQL for the documents of today.
_TODAY = (
    "today AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 3 THEN text || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7 "
    "UNION ALL SELECT doc_id, source, text FROM documents WHERE doc_id % 10 = 5)"
)
_DRIFT = (
    f"{_TODAY}, c AS (SELECT doc_id, count(*) AS n, min({_HASH.format('text')}) AS h FROM today GROUP BY doc_id), "
    f"s AS (SELECT d.doc_id, d.source, {_HASH.format('d.text')} AS stored, coalesce(c.n, 0) AS n, c.h FROM documents d LEFT JOIN c USING (doc_id)), "
    "r AS (SELECT doc_id, source, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS current_status, stored, h, "
    "n <> 1 OR h IS DISTINCT FROM stored AS changed FROM s)"
)
_PROBLEMS = (
    f"{_DRIFT}, p AS (SELECT doc_id AS fact_key, CASE WHEN current_status <> 'RESOLVED' THEN 'STRUCTURAL' ELSE 'CONTENT' END AS drift_kind, "
    "CASE WHEN current_status = 'RESOLVED' THEN h ELSE current_status END AS fingerprint FROM r WHERE changed)"
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def property_name() -> Column:
    """A part's property: its name with its key, so that each part is a citation of its own."""
    return F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- citations


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """A citation for each part, the hash over its canonical name."""
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("standard"),
        F.col("p_type").alias("shape_name"),
        property_name().alias("property_name"),
        F.concat(F.lit("/part["), F.col("p_partkey").cast("string"), F.lit("]")).alias("xpath"),
        F.concat(F.lit("urn:part:"), (F.col("p_partkey") % 50).cast("string")).alias("source_uri"),
        terms.text_hash(F.col("p_name")).alias("content_hash"),
    )
    return annotate.annotate_xpath(rows)


_PART_TRIPLES = f"""
c AS (SELECT DISTINCT {_SHAPE} AS shape, '{GEN}' || url_encode(p_brand) || '/' || url_encode(p_type) AS node,
             '/part[' || p_partkey || ']' AS value, 'urn:part:' || (p_partkey % 50) AS src, {_HASH.format('p_name')} AS h FROM part),
t AS (SELECT node AS s, '{iri("rdf:type")}' AS p, '{iri("sh:NodeShape")}' AS o FROM c UNION
      SELECT node, '{iri("sh:property")}', shape FROM c UNION
      SELECT shape, '{iri("rdf:type")}', '{iri("sh:PropertyShape")}' FROM c UNION
      SELECT shape, '{iri("sh:path")}', shape || '/path' FROM c UNION
      SELECT shape, '{iri("prov:wasDerivedFrom")}', shape || '/annotation' FROM c UNION
      SELECT shape || '/annotation', '{iri("rdf:type")}', '{iri("oa:Annotation")}' FROM c UNION
      SELECT shape, '{iri("gen:contentHash")}', h FROM c UNION
      SELECT shape || '/annotation', '{iri("oa:hasTarget")}', '_:' || sha256(shape || '|target') FROM c UNION
      SELECT '_:' || sha256(shape || '|target'), '{iri("oa:hasSource")}', src FROM c UNION
      SELECT '_:' || sha256(shape || '|target'), '{iri("oa:hasSelector")}', '_:' || sha256(shape || '|selector') FROM c UNION
      SELECT '_:' || sha256(shape || '|selector'), '{iri("rdf:type")}', '{iri("oa:XPathSelector")}' FROM c UNION
      SELECT '_:' || sha256(shape || '|selector'), '{iri("rdf:value")}', value FROM c)"""


@query("q_iri_mint", f"SELECT p_partkey, {_SHAPE} AS iri FROM part")
def iri_mint(spark, sf):
    names = [F.col("p_brand"), F.col("p_type"), property_name()]
    return table(spark, sf, "part").select("p_partkey", terms.shape_iri(*names).alias("iri"))


@query(
    "q_slug",
    "SELECT p_partkey, CASE WHEN b = '' THEN h ELSE b || '-' || h END AS slug FROM (SELECT p_partkey, "
    "trim(regexp_replace(lower(p_name), '[^a-zA-Z0-9]+', '-', 'g'), '-') AS b, left(sha256(p_name), 8) AS h FROM part)",
)
def slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", terms.slug(F.col("p_name")).alias("slug"))


@query("q_content_hash", f"SELECT doc_id, {_HASH.format('text')} AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", terms.text_hash(F.col("text")).alias("content_hash"))


@query("q_star_triples", f"WITH {_PART_TRIPLES} SELECT * FROM t")
def star_triples(spark, sf):
    return annotate.star_triples(citations(spark, sf)).select("s", "p", "o")


@query("q_triples_by_predicate", f"WITH {_PART_TRIPLES} SELECT p, count(*) AS n FROM t GROUP BY p")
def triples_by_predicate(spark, sf):
    return annotate.star_triples(citations(spark, sf)).groupBy("p").agg(F.count("*").alias("n"))


@query("q_bgp_fields", f"SELECT DISTINCT {_SHAPE} AS property, {_SHAPE} || '/path' AS path FROM part")
def bgp_fields(spark, sf):
    triples = annotate.star_triples(citations(spark, sf))
    return patterns.match(triples, [("?property", "a", "sh:PropertyShape"), ("?property", "sh:path", "?path")]).orderBy("property")


_PROVENANCE = f"SELECT DISTINCT {_SHAPE} AS property, {_HASH.format('p_name')} AS hash, 'urn:part:' || (p_partkey % 50) AS source, '/part[' || p_partkey || ']' AS value FROM part"


@query("q_bgp_provenance", _PROVENANCE)
def bgp_provenance(spark, sf):
    triples = annotate.star_triples(citations(spark, sf))
    wanted = [
        ("?property", "prov:wasDerivedFrom", "?note"),
        ("?property", "gen:contentHash", "?hash"),
        ("?note", "oa:hasTarget", "?target"),
        ("?target", "oa:hasSource", "?source"),
        ("?target", "oa:hasSelector", "?selector"),
        ("?selector", "rdf:value", "?value"),
    ]
    return patterns.match(triples, wanted).select("property", "hash", "source", "value")


@query("q_bgp_star_rewrite", _PROVENANCE)
def bgp_star_rewrite(spark, sf):
    wanted = {"property": "shape", "hash": "content_hash", "source": "source_uri", "value": "selector_value"}
    return patterns.match_star(citations(spark, sf), wanted).distinct()


@query(
    "q_upsert",
    f"SELECT {_SHAPE} AS property_shape_iri, CASE WHEN p_partkey % 4 = 0 THEN 'sha256:new' ELSE {_HASH.format('p_name')} END AS content_hash FROM part",
)
def upsert(spark, sf):
    old = citations(spark, sf)
    keys = table(spark, sf, "part").where("p_partkey % 4 = 0").select(terms.shape_iri(F.col("p_brand"), F.col("p_type"), property_name()).alias("property_shape_iri"))
    new = old.join(keys, "property_shape_iri", "left_semi").withColumn("content_hash", F.lit("sha256:new"))
    return annotate.upsert(old, new.select(*old.columns)).select("property_shape_iri", "content_hash")


@query(
    "q_hint_patch",
    f"SELECT {_SHAPE} AS property_shape_iri, CASE WHEN p_size % 2 = 0 THEN p_name END AS sh_name, CASE WHEN p_size % 3 = 0 THEN p_size END AS sh_order FROM part",
)
def hint_patch(spark, sf):
    part = table(spark, sf, "part")
    shape = terms.shape_iri(F.col("p_brand"), F.col("p_type"), property_name())
    hints = part.where("p_size % 2 = 0 OR p_size % 3 = 0").select(
        shape.alias("property_shape_iri"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("sh_name"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("sh_order"),
        F.lit(None).cast("string").alias("dash_editor"),
    )
    return annotate.patch_hints(citations(spark, sf), hints).select("property_shape_iri", "sh_name", "sh_order")


@query("q_unchanged_skip", "SELECT p_brand AS standard, true AS unchanged FROM part GROUP BY p_brand")
def unchanged_skip(spark, sf):
    rows = citations(spark, sf)
    same = unchanged(rows, rows.select("*"))
    return rows.select("standard").distinct().withColumn("unchanged", F.lit(same))


_ORDERED = (
    f"SELECT p_brand AS standard, {_SHAPE} AS property_shape_iri, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY "
    "CASE WHEN every_one THEN p_size END NULLS FIRST, " + _SHAPE + ")::INTEGER AS place FROM (SELECT *, "
    "bool_and(p_size % 7 <> 0) OVER (PARTITION BY p_brand, p_type) AS every_one FROM part)"
)


@query("q_property_order", _ORDERED)
def property_order(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_brand").alias("standard"),
        terms.shape_iri(F.col("p_brand"), F.col("p_type")).alias("node_shape_iri"),
        terms.shape_iri(F.col("p_brand"), F.col("p_type"), property_name()).alias("property_shape_iri"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("sh_order"),
    )
    return annotate.property_order(part).select("standard", "property_shape_iri", "place")


# ---------------------------------------------------------------- resolution and drift


@query(
    "q_resolve_status",
    "SELECT page_id, n::BIGINT AS n, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status "
    "FROM (SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n FROM pages)",
)
def resolve_status(spark, sf):
    n = F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0)))
    return table(spark, sf, "pages").select("page_id", n.cast("long").alias("n"), resolve.status_of(n, F.lit(True)).alias("status"))


_WELL_FORMED = (
    "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'NOT_FOUND' WHEN page_id % 4 = 1 THEN 'RESOLVED' WHEN page_id % 4 = 2 THEN 'AMBIGUOUS' ELSE 'UNCITABLE' END AS status FROM pages"
)


@query("q_xpath_nodes", _WELL_FORMED)
def xpath_nodes(spark, sf):
    """XML made of each page's address: no item, one, two, or a path to an attribute."""
    pages = table(spark, sf, "pages").withColumn("k", F.col("page_id") % 4)
    address = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item ref='1'>"), address, F.lit("</item>"))
    body = F.when(F.col("k") == 0, "").when(F.col("k") == 2, F.concat(item, item)).otherwise(item)
    documents = pages.select(
        F.col("page_id").cast("string").alias("doc_uri"), F.concat(F.lit("<page>"), body, F.lit("</page>")).cast("binary").alias("content")
    )
    wanted = pages.select(
        F.col("page_id").cast("string").alias("property_shape_iri"),
        F.col("page_id").cast("string").alias("doc_uri"),
        F.when(F.col("k") == 3, "/page/item/@ref").otherwise("/page/item").alias("selector_value"),
    )
    found = resolve.resolve_xpath(wanted, cut(parse_documents(documents)))
    return found.select(F.col("property_shape_iri").cast("long").alias("page_id"), "status")


def today(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    rest = F.col("doc_id") % 10
    edited = docs.where(rest != 7).withColumn("text", F.when(rest == 3, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return edited.unionByName(docs.where(rest == 5))


def text_drift(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), terms.text_hash(F.col("text")).alias("content_hash"))
    now = today(spark, sf).select(F.col("doc_id").alias("key"), terms.text_hash(F.col("text")).alias("current_hash"))
    return drift.text_drift(stored, now)


@query("q_drift", f"WITH {_DRIFT} SELECT doc_id, changed, current_status FROM r")
def drift_report(spark, sf):
    return text_drift(spark, sf).select(F.col("key").alias("doc_id"), "changed", "current_status")


@query(
    "q_drift_sweep",
    f"WITH {_DRIFT} SELECT doc_id, changed, current_status FROM r WHERE source NOT IN ('src3', 'src7')",
)
def drift_sweep(spark, sf):
    """The snapshot has lost two families; references that touch them are left out."""
    docs = table(spark, sf, "documents")
    snapshot = docs.select(F.col("source").alias("family")).distinct().where(~F.col("family").isin("src3", "src7"))
    checked, _ = drift.sweep(docs.select(F.col("doc_id").alias("fact_key"), F.col("source").alias("family")), snapshot)
    return text_drift(spark, sf).join(checked, F.col("key") == F.col("fact_key"), "left_semi").select(F.col("key").alias("doc_id"), "changed", "current_status")


def problems(spark: SparkSession, sf: str) -> DataFrame:
    return drift.classify(text_drift(spark, sf)).select(F.col("key").alias("fact_key"), "drift_kind", "fingerprint")


@query("q_drift_classify", f"WITH {_PROBLEMS} SELECT * FROM p")
def drift_classify(spark, sf):
    return problems(spark, sf)


@query("q_review_suppress", f"WITH {_PROBLEMS}, v AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING bool_or(quality = 1) AND NOT bool_or(toxic = 1)) SELECT p.* FROM p WHERE fact_key NOT IN (SELECT doc_id FROM v)")
def review_suppress(spark, sf):
    found = problems(spark, sf)
    labels = table(spark, sf, "labels")
    verdicts = labels.select("doc_id", F.explode(F.array(F.when(F.col("quality") == 1, "APPROVED"), F.when(F.col("toxic") == 1, "REJECTED"))).alias("verdict"))
    reviews = found.join(verdicts.where("verdict IS NOT NULL"), F.col("fact_key") == F.col("doc_id")).select(
        "fact_key", "drift_kind", F.col("fingerprint").alias("reviewed_fingerprint"), "verdict"
    )
    return drift.suppress_reviewed(found, reviews)


@query("q_drift_families", f"WITH {_DRIFT} SELECT source, current_status, count(*) AS n, count(*) FILTER (changed) AS n_changed FROM r GROUP BY ALL")
def drift_families(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "source")
    return text_drift(spark, sf).join(docs, "key").groupBy("source", "current_status").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


# ---------------------------------------------------------------- alignment


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Nations 0 to 19 as classes, regions as individuals."""
    kind, none = F.lit(align.TYPE).alias("p"), F.lit("").alias("x")

    def typed(rows: DataFrame, name: str, cls: str) -> DataFrame:
        return rows.select(F.lit("").alias("graph"), F.concat(F.lit("urn:term:"), F.col(name)).alias("s"), F.lit("iri").alias("s_kind"), kind, F.lit(iri(cls)).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))

    nations = table(spark, sf, "nation").where("n_nationkey < 20")
    return typed(nations, "n_name", "owl:Class").unionByName(typed(table(spark, sf, "region"), "r_name", "owl:NamedIndividual"))


@query("q_ref_integrity_subject", "SELECT s_suppkey, s_name AS subject_id FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def ref_integrity_subject(spark, sf):
    shapes = table(spark, sf, "nation").where("n_regionkey < 3").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    graph = shapes.select(F.col("s_name").alias("s"), F.lit(align.TYPE).alias("p"), F.lit(iri("sh:PropertyShape")).alias("o"))
    mappings = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("subject_id"))
    return align.unresolved_subjects(mappings, graph)


@query("q_ref_integrity_object", "SELECT c_custkey, 'urn:term:' || n_name AS object_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey >= 20")
def ref_integrity_object(spark, sf):
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mappings = customers.select("c_custkey", F.concat(F.lit("urn:term:"), F.col("n_name")).alias("object_id"))
    return align.unresolved_objects(mappings, vocabulary(spark, sf))


@query(
    "q_alignment_traverse",
    f"SELECT DISTINCT {_SHAPE} AS property, {_SHAPE} || '/path' AS path FROM part WHERE p_size % 5 = 2",
)
def alignment_traverse(spark, sf):
    """Properties mapped to one concept: citations and mappings in one graph, joined through a constant."""
    shape = terms.shape_iri(F.col("p_brand"), F.col("p_type"), property_name())
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "k")
    mapped = table(spark, sf, "part").withColumn("k", F.col("p_size") % 5).join(regions, "k").select(
        shape.alias("subject_id"), F.lit(iri("skos:exactMatch")).alias("predicate_id"), F.concat(F.lit("urn:region:"), F.col("k").cast("string")).alias("object_id")
    )
    graph = annotate.union_graphs(annotate.star_triples(citations(spark, sf)), align.mapping_triples(mapped))
    return patterns.match(graph, [("?property", "skos:exactMatch", "urn:region:2"), ("?property", "sh:path", "?path")])


@query("q_all_failures_message", "SELECT string_agg(s_suppkey || ': ' || s_name, '; ' ORDER BY s_suppkey) AS message FROM supplier WHERE s_nationkey % 5 = 0")
def all_failures_message(spark, sf):
    bad = table(spark, sf, "supplier").where("s_nationkey % 5 = 0")
    return align.all_failures(bad, F.concat(F.col("s_suppkey").cast("string"), F.lit(": "), F.col("s_name")), "s_suppkey")


@query(
    "q_curie_expand",
    "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'http://www.w3.org/2004/02/skos/core#' || n_name WHEN 1 THEN 'http://www.w3.org/2002/07/owl#' || n_name END AS iri FROM nation",
)
def curie_expand(spark, sf):
    prefixes = F.create_map(F.lit("skos"), F.lit(NAMESPACES["skos"]), F.lit("owl"), F.lit(NAMESPACES["owl"]))
    prefix = F.when(F.col("n_regionkey") == 0, "skos:").when(F.col("n_regionkey") == 1, "owl:").when(F.col("n_regionkey") == 2, "nope:").otherwise("")
    return table(spark, sf, "nation").select("n_nationkey", terms.expand_curie(F.concat(prefix, F.col("n_name")), prefixes).alias("iri"))


@query(
    "q_confidence_parse",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN c_custkey * 1000.0 WHEN 2 THEN c_acctbal END AS confidence FROM customer",
)
def confidence_parse(spark, sf):
    text = F.col("c_acctbal").cast("string")
    written = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), text, F.lit("\t")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit("_000")))
        .when(F.col("c_custkey") % 4 == 2, text)
        .otherwise(F.concat(text, F.lit("d")))
    )
    return table(spark, sf, "customer").select("c_custkey", terms.python_float(written).alias("confidence"))


# ---------------------------------------------------------------- geometry and reading order

_POLYGON = "-0.3,-0.25 0.2,-0.3 0.3,0.2 -0.1,0.35"


def _half_planes(x: str, y: str) -> str:
    points = [tuple(map(float, p.split(","))) for p in _POLYGON.split()]
    return " AND ".join(f"({bx} - ({ax})) * ({y} - ({ay})) - ({by} - ({ay})) * ({x} - ({ax})) > 0" for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]))


@query("q_polygon_contains", f"SELECT vec_id, {_half_planes('x', 'y')} AS inside FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)")
def polygon_contains(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), geometry.parse_points(F.lit(_POLYGON)).alias("polygon"))
    return rows.select("vec_id", geometry.inside(F.col("x"), F.col("y"), F.col("polygon")).alias("inside"))


@query(
    "q_box_overlap",
    "SELECT vec_id, x <= 0.25 AND x + 0.1 >= -0.25 AND y <= 0.2 AND y + 0.05 >= -0.2 AS overlaps FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)",
)
def box_overlap(spark, sf):
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    rows = table(spark, sf, "embeddings").select("vec_id", x.alias("x"), y.alias("y"), geometry.parse_points(F.lit("-0.25,-0.2 0.25,-0.2 0.25,0.2 -0.25,0.2")).alias("polygon"))
    return rows.select("vec_id", geometry.box_overlap(F.col("x"), F.col("y"), F.col("x") + 0.1, F.col("y") + 0.05, F.col("polygon")).alias("overlaps"))


@query("q_region_words", f"SELECT (vec_id // 50) AS page, count(*) AS n_words, string_agg(vec_id::VARCHAR, ' ' ORDER BY vec_id) AS text FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) WHERE {_half_planes('x', 'y')} GROUP BY 1")
def region_words(spark, sf):
    """Vectors as words of pages of fifty, one region on each page: containment by equi-join and residual."""
    x, y = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    words = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("page"), "vec_id", x.alias("x"), y.alias("y"))
    regions = words.select("page").distinct().withColumn("polygon", geometry.parse_points(F.lit(_POLYGON)))
    within = words.join(regions, "page").where(geometry.inside(F.col("x"), F.col("y"), F.col("polygon")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")), " ")
    return within.groupBy("page").agg(F.count("*").alias("n_words"), listed.alias("text"))


@query("q_reading_order", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def reading_order(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"))


@query("q_union_hash", "SELECT conv_id, sha256(string_agg(sha256(text), '|' ORDER BY turn)) AS union_hash FROM conversations GROUP BY conv_id")
def union_hash(spark, sf):
    parts = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    return history.union_hash(parts, "conv_id", "digest", "turn")


# ---------------------------------------------------------------- history


@query("q_revision_current", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def revision_current(spark, sf):
    return history.current_revision(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("q_revision_history", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS seq FROM events")
def revision_history(spark, sf):
    return history.numbered(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "seq")


@query("q_page_summary", "SELECT user_id, count(*) AS revisions, arg_max(event_id, {'a': ts, 'b': event_id}) AS last_event FROM events GROUP BY user_id")
def page_summary(spark, sf):
    return history.page_summary(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "revisions", F.col("last.event_id").alias("last_event"))


@query("q_latest_decision", "SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS outcome FROM events GROUP BY user_id")
def latest_decision(spark, sf):
    return history.latest_decision(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


@query("q_supersede", "SELECT event_id, n IS NOT NULL AS superseded, n AS superseded_by FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)")
def supersede(spark, sf):
    found = history.supersede(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id")
    return found.select("event_id", "superseded", F.col("superseded_by.event_id").alias("superseded_by"))


@query("q_run_diff", f"WITH {_TODAY}, a AS (SELECT doc_id, {_HASH.format('text')} AS h FROM documents), b AS (SELECT DISTINCT doc_id, {_HASH.format('text')} AS h FROM today) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def run_diff(spark, sf):
    h = terms.text_hash(F.col("text")).alias("h")
    return history.difference(table(spark, sf, "documents").select("doc_id", h), today(spark, sf).select("doc_id", h))


@query("q_overlay", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'approved' END, lang) AS lang, quality IS NOT NULL AND quality = 1 AS is_corrected FROM documents d LEFT JOIN labels l USING (doc_id)")
def overlay(spark, sf):
    approved = table(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit("approved").alias("lang"))
    return history.overlay(table(spark, sf, "documents").select("doc_id", "lang"), approved, ["doc_id"], "lang")


@query("q_stale_corrections", f"WITH {_TODAY} SELECT DISTINCT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM today t WHERE t.doc_id = d.doc_id AND {_HASH.format('t.text')} = {_HASH.format('d.text')})")
def stale_corrections(spark, sf):
    h = terms.text_hash(F.col("text"))
    corrections = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id").select("doc_id", h.alias("prior"))
    run = today(spark, sf).select("doc_id", h.alias("value"))
    return history.stale(corrections, run, ["doc_id"], "prior", "value").select("doc_id").distinct()


@query("q_self_approval", "SELECT event_id FROM events WHERE user_id % 7 = event_id % 7")
def self_approval(spark, sf):
    events = table(spark, sf, "events")
    proposals = events.select(F.col("event_id").alias("correction"), (F.col("user_id") % 7).alias("proposer"))
    decisions = events.select(F.col("event_id").alias("correction"), (F.col("event_id") % 7).alias("decider"), F.lit("approved").alias("outcome"))
    return history.decision_faults(decisions, proposals).select(F.col("correction").alias("event_id"))


@query("q_pending", "SELECT event_id || '-' || event_type AS correction, event_type AS proposer FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 = 0)")
def pending(spark, sf):
    events = table(spark, sf, "events").withColumn("correction", F.concat(F.col("event_id").cast("string"), F.lit("-"), F.col("event_type")))
    decided = events.where("event_id % 3 = 0").select("user_id").distinct()
    decisions = events.join(decided, "user_id").select("correction")
    return history.pending(events.select("correction"), decisions)


@query("q_reverse_lookup", "SELECT page_id FROM pages WHERE regexp_matches('page=' || (page_id % 30) || '&bbox=1', '(^|&)page=2(&|$)')")
def reverse_lookup(spark, sf):
    facts = table(spark, sf, "pages").select("page_id", F.concat(F.lit("urn:doc#page="), (F.col("page_id") % 30).cast("string"), F.lit("&bbox=1")).alias("source"))
    return history.facts_at(facts, "page", "2").select("page_id")


# ---------------------------------------------------------------- audits


@query(
    "q_name_match",
    "SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'official_only' WHEN a.name IS NULL THEN 'generated_only' ELSE 'matched' END AS state "
    "FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size % 4 <> 0) a FULL JOIN (SELECT DISTINCT p_name AS name FROM part WHERE p_size % 3 <> 0) b ON a.name = b.name",
)
def name_match(spark, sf):
    names = table(spark, sf, "part").withColumnRenamed("p_name", "name")
    return audit.match_names(names.where("p_size % 4 <> 0"), names.where("p_size % 3 <> 0"))


@query(
    "q_coverage",
    "SELECT s.source AS name, coalesce(n, 0) AS n_texts, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'attached' END AS state FROM (SELECT DISTINCT source FROM documents) s "
    "LEFT JOIN (SELECT source, count(DISTINCT lang) AS n FROM documents WHERE lang <> 'en' AND n_chars < 400 GROUP BY source) t USING (source)",
)
def coverage(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("source", "name")
    texts = docs.where("lang <> 'en' AND n_chars < 400").select("name", F.col("lang").alias("text"))
    return audit.coverage(docs.select("name").distinct(), texts).select("name", "n_texts", "state")


@query("q_coverage_rollup", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN count(DISTINCT lang) > 3 THEN 'ambiguous' ELSE 'attached' END AS state FROM documents GROUP BY source) GROUP BY state")
def coverage_rollup(spark, sf):
    n = F.count_distinct("lang")
    return audit.rollup(table(spark, sf, "documents").groupBy("source").agg(F.when(n > 3, "ambiguous").otherwise("attached").alias("state")))


_FOLD = "regexp_replace({0}, '[^\\x00-\\x7F]', 'x', 'g')"
_TOKENS = "regexp_extract_all({0}, '\\b[A-Z]{{2,}}[0-9]*\\b|\\b[0-9]+[a-zA-Z]?\\b')"


@query(
    "q_plausibility",
    f"WITH c AS (SELECT conv_id, turn, {_FOLD.format('text')} AS text FROM conversations), p AS (SELECT a.conv_id, a.turn, a.text AS s, b.text AS o FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), "
    f"m AS (SELECT *, length(o) * 1.0 / greatest(length(s), 1) AS ratio, len(list_filter({_TOKENS.format('s')}, lambda x: NOT list_contains({_TOKENS.format('o')}, x))) AS missing FROM p) "
    "SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(o) = '' THEN 'empty' END, CASE WHEN trim(o) <> '' AND NOT ratio BETWEEN 0.3 AND 3.0 THEN 'length_ratio' END, "
    "CASE WHEN missing > 0 THEN 'missing_shared_token' END], lambda x: x IS NOT NULL), ',') AS issues FROM m",
)
def plausibility(spark, sf):
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^\\x00-\\x7F]", "x").alias("s"))
    answer = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("o"))
    return said.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(audit.issues(F.col("s"), F.col("o")), ",").alias("issues"))


@query("q_task_status", "SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'done' WHEN bool_and(l_linestatus = 'O') THEN 'pending' ELSE 'in-progress' END AS status FROM lineitem GROUP BY l_orderkey")
def task_status(spark, sf):
    done, open_ = F.bool_and(F.col("l_linestatus") == "F"), F.bool_and(F.col("l_linestatus") == "O")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.when(done, "done").when(open_, "pending").otherwise("in-progress").alias("status"))


@query("q_task_counts", "SELECT o_orderstatus, count(DISTINCT o_orderkey) AS tasks, count(l_orderkey) AS subtasks, count(*) FILTER (l_linestatus = 'F') AS done FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus")
def task_counts(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderstatus").agg(
        F.count_distinct("o_orderkey").alias("tasks"), F.count("l_orderkey").alias("subtasks"), F.count_if(F.col("l_linestatus") == "F").alias("done")
    )


@query("q_json_pointer", "SELECT event_id, json_extract(props, '/k')::VARCHAR AS value FROM events")
def json_pointer(spark, sf):
    return table(spark, sf, "events").select("event_id", pointer.resolve_constant(F.col("props"), "/k").alias("value"))


@query("q_json_pointer_dynamic", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract(props, '/k')::VARCHAR END AS value FROM events")
def json_pointer_dynamic(spark, sf):
    where = F.when(F.col("event_id") % 2 == 0, "/k").otherwise("/none")
    return table(spark, sf, "events").select("event_id", pointer.resolve_dynamic("props", where).alias("value"))


# ---------------------------------------------------------------- graph patterns


def geo(spark: SparkSession, sf: str) -> DataFrame:
    """Nations lie in regions, suppliers and customers in nations; names are literals."""

    def edges(name: str, key: str, to: str, prefix: str, other: str) -> DataFrame:
        return table(spark, sf, name).select(
            F.concat(F.lit(f"urn:{prefix}:"), F.col(key).cast("string")).alias("s"), F.lit("urn:in").alias("p"), F.concat(F.lit(f"urn:{other}:"), F.col(to).cast("string")).alias("o")
        )

    def names(name: str, key: str, value: str, prefix: str) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(f"urn:{prefix}:"), F.col(key).cast("string")).alias("s"), F.lit("urn:name").alias("p"), F.col(value).alias("o"))

    out = edges("nation", "n_nationkey", "n_regionkey", "n", "r").unionByName(edges("supplier", "s_suppkey", "s_nationkey", "s", "n"))
    return out.unionByName(names("nation", "n_nationkey", "n_name", "n")).unionByName(names("region", "r_regionkey", "r_name", "r").where("o <> 'ASIA'"))


_GEO = (
    "g AS (SELECT 'urn:n:' || n_nationkey AS s, 'urn:in' AS p, 'urn:r:' || n_regionkey AS o FROM nation UNION ALL SELECT 'urn:s:' || s_suppkey, 'urn:in', 'urn:n:' || s_nationkey FROM supplier "
    "UNION ALL SELECT 'urn:n:' || n_nationkey, 'urn:name', n_name FROM nation UNION ALL SELECT 'urn:r:' || r_regionkey, 'urn:name', r_name FROM region WHERE r_name <> 'ASIA')"
)


@query("q_sparql_optional", f"WITH {_GEO} SELECT a.s AS x, a.o AS y, b.o AS name FROM g a LEFT JOIN g b ON b.s = a.o AND b.p = 'urn:name' WHERE a.p = 'urn:in'")
def sparql_optional(spark, sf):
    g = geo(spark, sf)
    return patterns.optional(patterns.one(g, ("?x", "urn:in", "?y")), patterns.one(g, ("?y", "urn:name", "?name")))


@query("q_sparql_union", f"WITH {_GEO} SELECT s AS x, o AS y, NULL::VARCHAR AS name FROM g WHERE p = 'urn:in' UNION ALL SELECT s, NULL, o FROM g WHERE p = 'urn:name'")
def sparql_union(spark, sf):
    g = geo(spark, sf)
    return patterns.union(patterns.one(g, ("?x", "urn:in", "?y")), patterns.one(g, ("?x", "urn:name", "?name")))


@query("q_sparql_minus", f"WITH {_GEO} SELECT s AS x, o AS y FROM g WHERE p = 'urn:in' AND s NOT IN (SELECT s FROM g WHERE p = 'urn:name')")
def sparql_minus(spark, sf):
    g = geo(spark, sf)
    return patterns.minus(patterns.one(g, ("?x", "urn:in", "?y")), patterns.one(g, ("?x", "urn:name", "?n")))


@query("q_sparql_notexists", f"WITH {_GEO} SELECT s AS x, o AS y FROM g WHERE p = 'urn:in' AND NOT EXISTS (SELECT 1 FROM g b WHERE b.s = g.o AND b.p = 'urn:name')")
def sparql_notexists(spark, sf):
    g = geo(spark, sf)
    return patterns.not_exists(patterns.one(g, ("?x", "urn:in", "?y")), patterns.one(g, ("?y", "urn:name", "?n")))


@query("q_sparql_exists", f"WITH {_GEO} SELECT s AS x, o AS y FROM g WHERE p = 'urn:in' AND EXISTS (SELECT 1 FROM g b WHERE b.s = g.o AND b.p = 'urn:name')")
def sparql_exists(spark, sf):
    g = geo(spark, sf)
    return patterns.exists(patterns.one(g, ("?x", "urn:in", "?y")), patterns.one(g, ("?y", "urn:name", "?n")))


@query("q_sparql_group", f"WITH {_GEO} SELECT o AS y, count(*) AS n, string_agg(s, ',' ORDER BY s) AS members FROM g WHERE p = 'urn:in' GROUP BY o HAVING count(*) > 3")
def sparql_group(spark, sf):
    rows = patterns.one(geo(spark, sf), ("?x", "urn:in", "?y"))
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("x")), ",").alias("members")).where("n > 3")


@query("q_sparql_values", f"WITH {_GEO} SELECT s AS x, o AS name FROM g WHERE p = 'urn:name' AND s IN ('urn:n:1', 'urn:n:2', 'urn:r:0')")
def sparql_values(spark, sf):
    return patterns.values(patterns.one(geo(spark, sf), ("?x", "urn:name", "?name")), "x", ["urn:n:1", "urn:n:2", "urn:r:0"])


@query("q_sparql_distinct", f"WITH {_GEO} SELECT DISTINCT o AS y FROM g WHERE p = 'urn:in'")
def sparql_distinct(spark, sf):
    return patterns.one(geo(spark, sf), ("?x", "urn:in", "?y")).select("y").distinct()


@query("q_sparql_slice", f"WITH {_GEO} SELECT s AS x, o AS name FROM g WHERE p = 'urn:name' ORDER BY s LIMIT 10 OFFSET 5")
def sparql_slice(spark, sf):
    return patterns.one(geo(spark, sf), ("?x", "urn:name", "?name")).orderBy("x").offset(5).limit(10)


@query("q_sparql_bind", f"WITH {_GEO} SELECT s AS x, TRY_CAST(regexp_extract(s, '[0-9]+$') AS INTEGER) * 2 AS doubled FROM g WHERE p = 'urn:name'")
def sparql_bind(spark, sf):
    return patterns.bind(patterns.one(geo(spark, sf), ("?x", "urn:name", "?n")).select("x"), "doubled", "try_cast(regexp_extract(x, '[0-9]+$', 0) AS int) * 2")


@query(
    "q_property_path_star",
    f"WITH RECURSIVE {_GEO}, w AS (SELECT s AS a, o AS b FROM g WHERE p = 'urn:in' UNION SELECT w.a, g.o FROM w JOIN g ON w.b = g.s AND g.p = 'urn:in') "
    'SELECT a AS start, b AS "end" FROM w UNION SELECT s, s FROM g WHERE p = \'urn:in\' UNION SELECT o, o FROM g WHERE p = \'urn:in\'',
)
def property_path_star(spark, sf):
    return patterns.path_star(geo(spark, sf), "urn:in")


@query("q_structural_cases", "SELECT p_type AS root, p_size % 3 AS low, a.n AS first, b.n AS second FROM (SELECT DISTINCT p_type, p_size FROM part) CROSS JOIN (SELECT unnest([0, 1, 5]) AS n) a CROSS JOIN (SELECT unnest([1, 2]) AS n) b")
def structural_cases(spark, sf):
    """Cases of a two-particle content model for every type: each particle's options, in all combinations."""
    types = table(spark, sf, "part").select("p_type", "p_size").distinct()
    first, second = schemas.occurrence_options(0, None), schemas.occurrence_options(1, 2)
    return types.select(F.col("p_type").alias("root"), (F.col("p_size") % 3).alias("low"), F.explode(F.array(*map(F.lit, first))).alias("first")).withColumn(
        "second", F.explode(F.array(*map(F.lit, second)))
    )


@query(
    "q_structural_cases_bounds",
    "WITH b AS (SELECT p_partkey, p_size % 3 AS low, CASE WHEN p_size % 10 <> 0 THEN p_size END AS high, CASE WHEN p_size % 10 <> 0 THEN p_size ELSE 5 END AS top FROM part) "
    "SELECT p_partkey, unnest(list_distinct([low, least(low + 1, top), top])) AS n, true AS valid FROM b UNION ALL SELECT p_partkey, high + 1, false FROM b WHERE high > 1",
)
def structural_cases_bounds(spark, sf):
    """Options of a particle for every part, between bounds of its own; sizes that end in 0 are unbounded."""
    options = schemas.option_column(F.col("p_size") % 3, F.when(F.col("p_size") % 10 != 0, F.col("p_size")))
    return table(spark, sf, "part").select("p_partkey", F.explode(options).alias("o")).select("p_partkey", "o.n", "o.valid")


# ---------------------------------------------------------------- more of the inventory


@query("q_bounding_box", "SELECT vec_id // 50 AS page, min(embedding[1]::DOUBLE) AS x0, min(embedding[2]::DOUBLE) AS top, max(embedding[3]::DOUBLE) AS x1, max(embedding[4]::DOUBLE) AS bottom FROM embeddings GROUP BY 1")
def bounding_box(spark, sf):
    words = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("page"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x0", "top", "x1", "bottom"))]
    )
    return resolve.bounding_box(words, "page")


@query(
    "q_constraint_sets",
    "WITH a AS (SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_brand, p_type, p_size FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL), "
    "d AS (SELECT coalesce(a.p_brand, b.p_brand) AS brand, a.p_brand IS NULL OR b.p_brand IS NULL AS odd FROM a FULL JOIN b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size) "
    "SELECT brand, NOT bool_or(odd) AS same FROM d GROUP BY brand",
)
def constraint_sets(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("selector"), F.array(F.col("p_size").cast("string")).alias("fields"), F.lit(None).cast("string").alias("refer"))
    return audit.constraint_sets_equal(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), "brand")


@query("q_snapshot_resolve", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS location_status FROM documents")
def snapshot_resolve(spark, sf):
    from .sources.snapshots import resolve_families

    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("family"))
    current = docs.select("family").distinct().where("family NOT IN ('src1', 'src2')").withColumn("rel_path", F.concat("family", F.lit(".xml")))
    return resolve_families(docs, current).select("doc_id", "location_status")


@query("q_provenance_match", "WITH f AS (SELECT p_brand AS name, p_name AS text, min({'page': p_size, 'top': p_partkey}) AS w FROM part GROUP BY ALL) SELECT name, text, w.page AS page, w.top AS top FROM f")
def provenance_match(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("text"), F.col("p_size").alias("page"), F.col("p_partkey").alias("top"), F.lit(0).alias("x0"), F.lit(1).alias("x1"))
    found = audit.first_occurrence(part.select("name", "text").distinct(), part)
    return found.select("name", "text", F.col("at.page").alias("page"), F.col("at.top").alias("top"))


@query("q_correction_state", "WITH l AS (SELECT user_id, event_type, arg_max(event_id % 2, {'a': ts, 'b': event_id}) AS odd FROM events GROUP BY ALL) SELECT sha256(user_id || '|' || event_type || '|CONTENT|f') AS process FROM l WHERE odd = 1")
def correction_state(spark, sf):
    from .streaming.sweep import correction_state as state

    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("fact_key"), F.col("event_type").alias("leaf_ref"), F.lit("CONTENT").alias("drift_kind"), F.lit("f").alias("fingerprint"),
        F.when(F.col("event_id") % 2 == 1, "REJECTED").otherwise("APPROVED").alias("verdict"), F.struct("ts", "event_id").alias("at"),
    )
    return state(events).select("process")


@query("q_structure_report", "SELECT p_brand AS space, count(DISTINCT p_type) AS n_types, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand) AS n_members FROM part a GROUP BY p_brand")
def structure_report(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("space"), F.col("p_type").alias("type_name"), F.col("p_name").alias("member"), F.lit("element").alias("kind"), F.lit(0).alias("low"), F.col("p_size").alias("high"))
    members = F.aggregate("types", F.lit(0), lambda n, t: n + F.size(t["members"])).cast("long")
    return schemas.structure_report(parts).select("space", "n_types", members.alias("n_members"))


@query("q_boundary_values", "SELECT p_partkey, v.value, v.valid FROM (SELECT p_partkey, unnest([{'value': '1', 'valid': true}, {'value': p_size::VARCHAR, 'valid': true}, {'value': '0', 'valid': false}, {'value': (p_size + 1)::VARCHAR, 'valid': false}]) AS v FROM part)")
def boundary_values(spark, sf):
    none = F.lit(None).cast("int")
    leaf = F.struct(F.array().cast("array<string>").alias("enumeration"), none.alias("minLength"), none.alias("maxLength"), F.lit(1).alias("minInclusive"), F.col("p_size").alias("maxInclusive"), none.alias("totalDigits"))
    return table(spark, sf, "part").select("p_partkey", F.explode(schemas.boundary_values(leaf)).alias("v")).select("p_partkey", "v.value", "v.valid")


@query(
    "q_boundary_families",
    "SELECT p_partkey, v.value, v.valid FROM (SELECT p_partkey, unnest(CASE p_size % 3 WHEN 0 THEN [{'value': repeat('a', p_size), 'valid': true}, {'value': repeat('a', p_size + 1), 'valid': false}, {'value': repeat('a', p_size - 1), 'valid': false}] "
    "WHEN 1 THEN [{'value': 'AA0', 'valid': true}, {'value': 'AA0' || chr(1), 'valid': false}] "
    "ELSE [{'value': repeat('1', p_size) || '.11', 'valid': true}, {'value': repeat('1', p_size) || '.111', 'valid': false}, {'value': repeat('1', p_size + 1) || '.11', 'valid': false}] END) AS v FROM part)",
)
def boundary_families(spark, sf):
    """Exact lengths, patterns and fraction digits, by the size of a part."""
    none, size = F.lit(None).cast("int"), F.col("p_size")
    leaf = F.struct(F.array().cast("array<string>").alias("enumeration"), *[none.alias(n) for n in ("minLength", "maxLength", "minInclusive", "maxInclusive")], (size + 2).alias("totalDigits"))
    more = F.when(size % 3 == 0, size), F.when(size % 3 == 1, F.lit("[A-Z]{2}[0-9]+")), F.when(size % 3 == 2, F.lit(2))
    return table(spark, sf, "part").select("p_partkey", F.explode(schemas.boundary_values(leaf, *more)).alias("v")).select("p_partkey", "v.value", "v.valid")


@query("q_display_name", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE url_encode(p_name || ' ' || p_partkey) END AS name FROM part")
def display_name(spark, sf):
    shape = terms.shape_iri(F.col("p_brand"), F.col("p_type"), property_name())
    return table(spark, sf, "part").select("p_partkey", terms.display_name(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), shape).alias("name"))


@query("q_add_citations", f"WITH {_DRIFT} SELECT doc_id, current_status AS status FROM r WHERE current_status <> 'RESOLVED'")
def add_citations(spark, sf):
    """What is refused when every document of today is cited anew."""
    resolved = text_drift(spark, sf).select(F.col("key").alias("doc_id"), F.col("current_status").alias("status"), "current_hash")
    revisions = resolved.limit(0).select("doc_id", F.lit("").alias("reference"))
    return history.add_citations(revisions, resolved)[1].select("doc_id", "status")


@query(
    "q_add_citations_appended",
    f"WITH {_DRIFT} SELECT doc_id, stored AS reference, 'STORED' AS status FROM r UNION ALL SELECT doc_id, h, 'RESOLVED' FROM r WHERE current_status = 'RESOLVED' "
    "UNION ALL SELECT doc_id, NULL, current_status FROM r WHERE current_status <> 'RESOLVED'",
)
def add_citations_appended(spark, sf):
    """Stored revisions with those that today's documents append, and what is refused beside them."""
    resolved = text_drift(spark, sf).select(F.col("key").alias("doc_id"), F.col("current_status").alias("status"), "current_hash")
    stored = table(spark, sf, "documents").select("doc_id", terms.text_hash(F.col("text")).alias("reference"), F.lit("STORED").alias("status"))
    appended, refused = history.add_citations(stored, resolved)
    return appended.unionByName(refused.select("doc_id", F.lit(None).cast("string").alias("reference"), "status"))
