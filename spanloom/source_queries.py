"""Registered queries of sources and selectors: XML and page regions, mapping files, task documents, graphs.

Roles of the tables: suppliers are elements of an XML document for each nation, vectors words
of pages of fifty, lines of orders subtasks of task documents, suppliers and nations rows of
mapping files. Today's sources are a fixed mutation of the stored ones by key: of ten, 3 is
changed, 5 doubled and 7 gone.
"""

from __future__ import annotations

import math
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry, terms
from .model import JSON_SELECTOR, SVG_SELECTOR, TEXT_SELECTOR, XPATH_SELECTOR, iri
from .operators import align, annotate, audit, drift, history, pages, resolve, schemas, selectors
from .plans import patterns, runs
from .plans.lineage import cut, cut_unsized, shared_folder
from .plans.store import unchanged_by
from .queries import _HASH, _PROBLEMS, _TODAY, QUERIES, citations, geo, problems, query, table, today
from .sources.sssom import header, parse_mappings
from .sources.xml_nodes import parse_documents

__all__ = ["QUERIES"]

# ---------------------------------------------------------------- XPath selectors


def nation_documents(suppliers: DataFrame) -> DataFrame:
    """(doc_uri, content): an XML document for each nation with its suppliers by key."""
    item = F.concat(F.lit('<supplier key="'), F.col("s_suppkey").cast("string"), F.lit('">'), F.col("said"), F.lit("</supplier>"))
    listed = F.array_sort(F.collect_list(F.struct("s_suppkey", "copy", item.alias("xml"))))
    text = F.concat(F.lit("<nation>"), F.array_join(F.transform(listed, lambda x: x["xml"]), ""), F.lit("</nation>"))
    return suppliers.groupBy("s_nationkey").agg(text.cast("binary").alias("content")).select(F.col("s_nationkey").cast("string").alias("doc_uri"), "content")


def stored_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("said"), F.lit(0).alias("copy"))


def suppliers_today(spark: SparkSession, sf: str) -> DataFrame:
    rows, rest = stored_suppliers(spark, sf), F.col("s_suppkey") % 10
    said = F.when(rest == 3, F.concat("said", F.lit(" changed"))).otherwise(F.col("said"))
    return rows.where(rest != 7).withColumn("said", said).unionByName(rows.where(rest == 5).withColumn("copy", F.lit(1)))


def by_key(key: Column) -> Column:
    return F.concat(F.lit("/nation/supplier[@key='"), key.cast("string"), F.lit("']"))


_XML = """'sha256:' || sha256('<supplier key="' || s_suppkey || '">' || {0} || '</supplier>')"""
_AFTER = (
    "CASE s_suppkey % 10 WHEN 7 THEN 'NOT_FOUND' WHEN 5 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS current_status, s_suppkey % 10 IN (3, 5, 7) AS changed, "
    f"CASE WHEN s_suppkey % 10 NOT IN (5, 7) THEN {_XML.format('''CASE s_suppkey % 10 WHEN 3 THEN s_name || ' changed' ELSE s_name END''')} END AS current_hash"
)


def xpath_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier cited by a path of its own, with the hash of its element."""
    rows = table(spark, sf, "supplier")
    xml = F.concat(F.lit('<supplier key="'), F.col("s_suppkey").cast("string"), F.lit('">'), F.col("s_name"), F.lit("</supplier>"))
    return rows.select(
        F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("property_shape_iri"),
        F.lit(XPATH_SELECTOR).alias("selector_type"),
        by_key(F.col("s_suppkey")).alias("selector_value"),
        F.lit(None).cast("int").alias("page"),
        F.concat(F.lit("sha256:"), F.sha2(xml, 256)).alias("content_hash"),
        F.col("s_nationkey").cast("string").alias("source_uri"),
        F.col("s_nationkey").cast("string").alias("doc_uri"),
    )


@query("q_xpath_drift", f"SELECT 's:' || s_suppkey AS property_shape_iri, {_AFTER} FROM supplier")
def xpath_drift(spark, sf):
    """Drift of element citations, a path each, against today's documents."""
    nodes = cut_unsized(parse_documents(nation_documents(suppliers_today(spark, sf))))
    return drift.check_xpath_drift(xpath_citations(spark, sf), nodes).select("property_shape_iri", "current_status", "changed", "current_hash")


@query(
    "q_xpath_paths",
    "WITH n AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier), "
    "r AS (SELECT s_suppkey, s_name, n, place, s_suppkey % 7 AS k FROM n) "
    "SELECT s_suppkey, CASE k WHEN 0 THEN 'RESOLVED' WHEN 1 THEN CASE WHEN n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END WHEN 2 THEN 'UNCITABLE' WHEN 3 THEN 'NOT_FOUND' "
    "WHEN 4 THEN 'UNCITABLE' WHEN 5 THEN CASE WHEN n >= 3 THEN 'RESOLVED' ELSE 'NOT_FOUND' END ELSE CASE WHEN n = 1 THEN 'UNCITABLE' ELSE 'AMBIGUOUS' END END AS status FROM r",
)
def xpath_paths(spark, sf):
    """Statuses of paths of seven kinds: by key, all, an attribute, absent, a scalar, by position, all attributes."""
    k = F.col("s_suppkey") % 7
    one = by_key(F.col("s_suppkey"))
    path = (
        F.when(k == 0, one).when(k == 1, "//supplier").when(k == 2, F.concat(one, F.lit("/@key"))).when(k == 3, "/nation/customer")
        .when(k == 4, "count(//supplier)").when(k == 5, "/nation/*[3]").otherwise("/nation//@key")
    )
    wanted = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("property_shape_iri"), F.col("s_nationkey").cast("string").alias("doc_uri"), path.alias("selector_value")
    )
    nodes = cut_unsized(parse_documents(nation_documents(stored_suppliers(spark, sf))))
    return resolve.resolve_xpath(wanted, nodes).select(F.col("property_shape_iri").cast("long").alias("s_suppkey"), "status")


# ---------------------------------------------------------------- schemas


def part_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_uri, content): a schema for each brand with a complex type for each of its parts.

    A type holds an element E; two of them; an element inside a foreign element; or one inside a
    foreign element and one inside an element of the same local name without a namespace.
    """
    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    element = F.concat(F.lit('<xs:element name="E'), key, F.lit('" type="xs:string"/>'))
    noted = lambda *inner: F.concat(F.lit("<xs:annotation><xs:appinfo>"), *inner, F.lit("</xs:appinfo></xs:annotation>"))
    foreign = [F.lit('<f:w xmlns:f="urn:f">'), element, F.lit("</f:w>")]
    listed = lambda *inner: F.concat(F.lit("<xs:sequence>"), *inner, F.lit("</xs:sequence>"))
    body = F.when(k == 0, listed(element)).when(k == 1, listed(element, element)).when(k == 2, noted(*foreign)).otherwise(noted(*foreign, F.lit("<w>"), element, F.lit("</w>")))
    item = F.concat(F.lit('<xs:complexType name="T'), key, F.lit('">'), body, F.lit("</xs:complexType>"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("xml")))), lambda x: x["xml"]), "")
    text = F.concat(F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:parts">'), types, F.lit("</xs:schema>"))
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("doc_uri")).agg(text.cast("binary").alias("content"))


_TYPE = "'/xs:schema/xs:complexType[@name=''T' || p_partkey || ''']'"


@query(
    "q_schema_candidates",
    f"""WITH t AS (SELECT p_brand AS doc_uri, p_partkey AS k, {_TYPE} AS base, 'E' || p_partkey AS e FROM part)
SELECT doc_uri, 'complexType' AS tag, 'T' || k AS name, base AS xpath, 1 AS matches, true AS finds_itself FROM t
UNION ALL SELECT doc_uri, 'element', e, base || '/xs:sequence/xs:element[@name=''' || e || ''']', k % 4 + 1, k % 4 = 0 FROM t, range(2) r(c) WHERE k % 4 IN (0, 1) AND c <= k % 4
UNION ALL SELECT doc_uri, 'element', e, base || '/xs:annotation/xs:appinfo/w/xs:element[@name=''' || e || ''']', CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END, c = 1
FROM t, range(2) r(c) WHERE k % 4 = 2 AND c = 0 OR k % 4 = 3""",
)
def schema_candidates(spark, sf):
    """Every named construct with its path, how many nodes that finds, and whether it is its own; kinds three and four tell these apart."""
    nodes = cut_unsized(parse_documents(part_schemas(spark, sf)))
    return schemas.minted_paths(nodes).select("doc_uri", "tag", "name", "xpath", "matches", "finds_itself")


def member_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_uri, content): a schema for each brand whose types come in threes of parts by key.

    The first has an element and an attribute, the second extends it by an element, the third
    extends the second by a reference to a group of two elements, declared once in each schema.
    """
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", r.alias("r")).withColumn("before", F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    key, before, k = F.col("p_partkey").cast("string"), F.col("before").cast("string"), F.col("r") % 3
    element = F.concat(F.lit('<xs:sequence><xs:element name="a'), key, F.lit('" minOccurs="0"/></xs:sequence>'))
    extended = lambda inner: F.concat(F.lit('<xs:complexContent><xs:extension base="p:T'), before, F.lit('">'), inner, F.lit("</xs:extension></xs:complexContent>"))
    group = F.lit('<xs:sequence><xs:group ref="p:G" maxOccurs="unbounded"/></xs:sequence>')
    body = F.when(k == 0, F.concat(element, F.lit('<xs:attribute name="b'), key, F.lit('"/>'))).when(k == 1, extended(element)).otherwise(extended(group))
    item = F.concat(F.lit('<xs:complexType name="T'), key, F.lit('">'), body, F.lit("</xs:complexType>"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("xml")))), lambda x: x["xml"]), "")
    head = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:p="urn:parts" targetNamespace="urn:parts">'
    tail = '<xs:group name="G"><xs:choice><xs:element name="g1"/><xs:element name="g2" maxOccurs="4"/></xs:choice></xs:group></xs:schema>'
    return rows.groupBy(F.col("p_brand").alias("doc_uri")).agg(F.concat(F.lit(head), types, F.lit(tail)).cast("binary").alias("content"))


@query(
    "q_type_members",
    """WITH t AS (SELECT p_brand AS doc_uri, p_partkey AS k, row_number() OVER w - 1 AS r, lag(p_partkey) OVER w AS k1, lag(p_partkey, 2) OVER w AS k2
           FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
o AS (SELECT *, CASE r % 3 WHEN 0 THEN k WHEN 1 THEN k1 ELSE k2 END AS base, CASE r % 3 WHEN 1 THEN k WHEN 2 THEN k1 END AS mid FROM t),
m AS (SELECT doc_uri, k, 0 AS position, 'element' AS kind, 'a' || base AS member, 0 AS low, 1 AS high, 'T' || base AS owner FROM o
      UNION ALL SELECT doc_uri, k, 1, 'attribute', 'b' || base, 1, 1, 'T' || base FROM o
      UNION ALL SELECT doc_uri, k, 2, 'element', 'a' || mid, 0, 1, 'T' || mid FROM o WHERE mid IS NOT NULL
      UNION ALL SELECT doc_uri, k, 3, 'element', 'g1', 1, 1, 'G' FROM o WHERE r % 3 = 2
      UNION ALL SELECT doc_uri, k, 4, 'element', 'g2', 1, 4, 'G' FROM o WHERE r % 3 = 2)
SELECT doc_uri, 'T' || k AS type_name, position, kind, member, low, high, owner FROM m""",
)
def type_members(spark, sf):
    """Members of every type, with those of its bases and groups, in order."""
    return schemas.type_members(cut_unsized(parse_documents(member_schemas(spark, sf))))[0].drop("pre")


@query(
    "q_structural_models",
    """WITH p AS (SELECT p_size AS model, p_partkey AS k, CASE WHEN p_partkey % 3 = 2 THEN 3 ELSE 2 END AS n FROM part),
m AS (SELECT model, count(*) AS particles, sum(ln(n)) <= ln(1024) + 1e-9 AS product, exp(sum(ln(n))) AS combinations FROM p GROUP BY model),
d AS (SELECT a.model, sum(a.n * b.n) AS pairs FROM p a JOIN p b ON a.model = b.model AND a.k < b.k GROUP BY a.model)
SELECT model, particles::BIGINT AS particles, coalesce(pairs, 0)::BIGINT AS pairs, true AS all_valid, true AS few FROM m LEFT JOIN d USING (model)""",
)
def structural_models(spark, sf):
    """Content models of the parts of each size: pairs of options that their cases cover, and whether the cases are the product or fewer than 100."""
    k = F.col("p_partkey")
    high = F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).otherwise(F.lit(None).cast("int"))
    low = F.when(k % 3 == 1, 1).otherwise(0)
    models = table(spark, sf, "part").select(F.col("p_size").alias("model"), k.alias("place"), F.concat(F.lit("e"), k.cast("string")).alias("name"), low.alias("low"), high.alias("high"))
    cases = schemas.model_cases(models).select("model", "case_id", "place", "n", "should_be_valid")
    options = models.select("model", F.when(F.col("place") % 3 == 2, 3).otherwise(2).alias("o"))
    product = options.groupBy("model").agg(F.sum(F.log("o")).alias("o")).select("model", (F.col("o") <= math.log(1024) + 1e-9).alias("product"))
    report = schemas.case_report(cases).join(product, "model")
    return report.select("model", "particles", "pairs", "all_valid", (F.col("product") | (F.col("cases") < 100)).alias("few"))


def printed_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a printed description of the parts of each brand, five of them on a page.

    Each part is a heading over two lines, a used-by entry, a table with a row of one name, the
    name's rest on the next line, and a documentation of two lines, and the part's type under
    ``Documentation``, which stands on the next page for the fifth.
    """
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = table(spark, sf, "part").withColumn("r", r)
    key = F.col("p_partkey").cast("string")
    name = F.split("p_name", " ")
    page, top = (F.floor(F.col("r") / 5) + 1).cast("int"), (F.col("r") % 5 * 140 + 100).cast("double")
    late = F.col("r") % 5 == 4
    line = lambda at, *said: F.transform(F.array(*(F.struct(F.lit(float(x)).alias("x0"), t.alias("text")) for x, t in said)), lambda w: F.struct(page.alias("page"), (top + at).alias("top"), w["x0"].alias("x0"), w["text"].alias("text")))
    under = lambda at, *said: F.transform(F.array(*(F.struct(F.lit(float(x)).alias("x0"), t.alias("text")) for x, t in said)), lambda w: F.struct((page + late.cast("int")).alias("page"), F.when(late, at / 2).otherwise(top + at).alias("top"), w["x0"].alias("x0"), w["text"].alias("text")))
    lines = F.flatten(
        F.array(
            line(0, (60, F.lit("element"))), line(10, (60, F.concat(F.lit("Root/Part"), key))), line(20, (60, F.lit("Used")), (90, F.lit("by"))), line(30, (137, F.lit("element")), (180, F.lit("Other"))),
            line(40, (62, F.lit("Name")), (150, F.lit("Type")), (200, F.lit("Use")), (250, F.lit("Documentation"))), line(50, (63, F.lit("Long"))), line(60, (63, F.concat(F.lit("er"), key)), (251, name[0])), line(70, (251, name[1])),
            under(80, (60, F.lit("Documentation"))), under(90, (60, F.col("p_type")), (120, F.lit("of"))), under(100, (60, key)),
        )
    )
    words = rows.select(F.col("p_brand").alias("doc_uri"), F.explode(lines).alias("w")).select("doc_uri", "w.*")
    return words.withColumns({"x1": F.col("x0") + 30, "bottom": F.col("top") + 8})


@query(
    "q_page_sections",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part),
l AS (SELECT *, (r // 5 + 1)::INTEGER AS page, (r % 5 * 140 + 100)::DOUBLE AS top, r % 5 = 4 AS late FROM t)
SELECT p_brand AS doc_uri, 'Longer' || p_partkey AS name, 'row' AS part, p_name AS text, page, 251.0::DOUBLE AS x0, top + 60 AS top, 281.0::DOUBLE AS x1, top + 78 AS bottom FROM l
UNION ALL SELECT p_brand, 'Part' || p_partkey, 'heading', p_type || ' of ' || p_partkey, (page + late::INTEGER)::INTEGER, 60.0, CASE WHEN late THEN 45.0 ELSE top + 90 END, 150.0, CASE WHEN late THEN 58.0 ELSE top + 108 END FROM l""",
)
def page_sections(spark, sf):
    """Every documentation on the pages, by the name it belongs to, with page and box."""
    return pages.name_occurrences(printed_parts(spark, sf))


@query(
    "q_check_references",
    """WITH l AS (SELECT 'n' || c_nationkey AS root, c_custkey, o_orderkey, coalesce('o' || o_orderkey, 'c' || c_custkey) AS leaf FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT root, (row_number() OVER (PARTITION BY root ORDER BY c_custkey, o_orderkey) - 1)::INTEGER AS position, leaf,
       o_orderkey IS NULL OR o_orderkey % 3 <> 0 AS changed, CASE WHEN o_orderkey IS NULL OR o_orderkey % 3 = 2 THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS current_status FROM l""",
)
def check_references(spark, sf):
    """References of nations that are unions of their customers', these of their orders': each leaf's check in order. Customers without orders are leaves nobody knows."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    parts = customers.select(name("n", "c_nationkey").alias("ref_id"), F.col("c_custkey").alias("place"), name("c", "c_custkey").alias("part_ref_id")).unionByName(
        orders.select(name("c", "o_custkey").alias("ref_id"), F.col("o_orderkey").alias("place"), name("o", "o_orderkey").alias("part_ref_id"))
    )
    k = F.col("o_orderkey") % 3
    checked = orders.where(k != 2).select(name("o", "o_orderkey").alias("leaf"), (k != 0).alias("changed"), F.lit("RESOLVED").alias("current_status"))
    roots = customers.select(name("n", "c_nationkey").alias("ref_id")).distinct()
    return history.check_references(parts, roots, checked)


@query(
    "q_reference_documents",
    """WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, '{"customer":' || c_custkey || '}' AS d, sha256(c_name) AS h FROM customer),
p AS (SELECT n, k // 7 AS g, '{"parts":[' || string_agg(d, ',' ORDER BY k) || ']}' AS d, sha256(string_agg(h, '|' ORDER BY k)) AS h FROM c GROUP BY n, k // 7)
SELECT 'n' || n AS ref_id, '{"parts":[' || string_agg(d, ',' ORDER BY g) || ']}' AS document, sha256(string_agg(h, '|' ORDER BY g)) AS digest FROM p GROUP BY n""",
)
def reference_documents(spark, sf):
    """References of nations to groups of customers, as nested JSON with the hash of their contents."""
    rows = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("n"), F.floor(F.col("c_custkey") / 7).alias("g"), F.col("c_custkey").alias("k"), "c_name")
    rows = rows.withColumn("m", F.concat_ws(".", "n", F.col("g").cast("string"))).withColumn("leaf", F.concat(F.lit("c"), F.col("k").cast("string")))
    parts = rows.select(F.col("n").alias("ref_id"), F.col("g").alias("place"), F.col("m").alias("part_ref_id")).distinct()
    parts = parts.unionByName(rows.select(F.col("m").alias("ref_id"), F.col("k").alias("place"), F.col("leaf").alias("part_ref_id")))
    leaves = rows.select(F.col("leaf").alias("ref_id"), F.to_json(F.struct(F.col("k").alias("customer"))).alias("document"), F.sha2("c_name", 256).alias("digest"))
    return history.fold_references(parts, leaves).where("ref_id LIKE 'n%' AND ref_id NOT LIKE '%.%'")


@query(
    "q_documentation_pairs",
    """SELECT p_brand AS doc_uri, 'Part' || p_partkey AS name, 'unmatched' AS state,
       CASE p_partkey % 3 WHEN 0 THEN p_type || ' of ' || p_partkey ELSE 'x' END AS de FROM part WHERE p_partkey % 3 <> 2""",
)
def documentation_pairs(spark, sf):
    """Constructs with a German documentation and one text on the pages: none has an English one in its schema."""
    nodes = cut_unsized(parse_documents(documented_parts(spark, sf)))
    found = pages.name_occurrences(printed_parts(spark, sf))
    none = spark.createDataFrame([], "name string, issues array<string>")
    return schemas.documentation_pairs(schemas.documentation(nodes), found, none).select("doc_uri", "name", "state", "de")


# ---------------------------------------------------------------- page regions


def page_words(spark: SparkSession, sf: str, now: bool) -> DataFrame:
    """Vectors as words: the first component is where a word begins, the second where its top is."""
    x, top = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    rest, said = F.col("vec_id") % 10, F.concat(F.lit("w"), F.col("vec_id").cast("string"))
    rows = table(spark, sf, "embeddings").where(rest != 7) if now else table(spark, sf, "embeddings")
    return rows.select(
        F.floor(F.col("vec_id") / 500).cast("string").alias("doc_uri"),
        (F.floor(F.col("vec_id") / 50) % 10 + 1).cast("int").alias("page"),
        (F.when(rest == 3, F.concat(said, F.lit("!"))).otherwise(said) if now else said).alias("text"),
        x.alias("x0"), (x + 0.02).alias("x1"), top.alias("top"), (top + 0.02).alias("bottom"),
    )


def page_regions(spark: SparkSession, sf: str) -> DataFrame:
    """A triangle on every page, moved by the page's number; every seventh lies where no word is, every eleventh page doesn't exist."""
    pages = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("k")).distinct()
    left = (F.col("k") % 5).cast("double") / 20 - 0.2
    far = F.when(F.col("k") % 7 == 0, 100.0).otherwise(0.0)
    corner = lambda x, y: F.concat((left + far + x).cast("string"), F.lit(","), (far + y).cast("string"))
    points = F.concat_ws(" ", corner(F.lit(-0.1), F.lit(-0.15)), corner(F.lit(0.25), F.lit(-0.1)), corner(F.lit(0.05), F.lit(0.25)))
    return pages.select(
        F.concat(F.lit("p:"), F.col("k").cast("string")).alias("property_shape_iri"),
        F.floor(F.col("k") / 10).cast("string").alias("doc_uri"),
        (F.col("k") % 10 + 1 + F.when(F.col("k") % 11 == 0, 1000).otherwise(0)).cast("int").alias("page"),
        geometry.wrap_points(points).alias("selector_value"),
        "k",
    )


def page_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Images on every third page, a large one and one without an extent; and ten pages for each document."""
    keys = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("k")).distinct()
    boxes = keys.where("k % 3 = 0").select(
        F.floor(F.col("k") / 10).cast("string").alias("doc_uri"), (F.col("k") % 10 + 1).cast("int").alias("page"), F.lit("image").alias("kind"),
        *[F.lit(v).alias(n) for n, v in (("x0", -500.0), ("top", -500.0), ("x1", 500.0), ("bottom", 500.0))],
    )
    return boxes, keys.select(F.floor(F.col("k") / 10).cast("string").alias("doc_uri")).distinct().withColumn("page_count", F.lit(10))


_SIDE = "({bx} - ({ax})) * (y - ({ay})) - ({by} - ({ay})) * (x - ({ax}))"
_CORNERS = [("l + f - 0.1", "f - 0.15"), ("l + f + 0.25", "f - 0.1"), ("l + f + 0.05", "f + 0.25")]
_WITHIN = " AND ".join(
    f"{_SIDE.format(ax=a[0], ay=a[1], bx=b[0], by=b[1])} > 0" for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1])
)
_WORDS = (
    "w AS (SELECT vec_id, vec_id // 50 AS k, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS top, (embedding[1]::DOUBLE + (embedding[1]::DOUBLE + 0.02)) / 2 AS x, "
    "(embedding[2]::DOUBLE + (embedding[2]::DOUBLE + 0.02)) / 2 AS y, 'w' || vec_id AS text FROM embeddings), "
    "k AS (SELECT DISTINCT k, (k % 5)::DOUBLE / 20 - 0.2 AS l, CASE WHEN k % 7 = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS f FROM w), "
    f"i AS (SELECT w.* FROM w JOIN k USING (k) WHERE {_WITHIN}), "
    "a AS (SELECT k, string_agg(text, ' ' ORDER BY round(top, 1), x0) AS stored FROM i GROUP BY k), "
    "b AS (SELECT k, string_agg(CASE WHEN vec_id % 10 = 3 THEN text || '!' ELSE text END, ' ' ORDER BY round(top, 1), x0) AS now FROM i WHERE vec_id % 10 <> 7 GROUP BY k)"
)
_STATUS = "CASE WHEN k % 11 = 0 THEN 'NOT_FOUND' WHEN {0} IS NOT NULL THEN 'RESOLVED' WHEN k % 3 = 0 THEN 'UNCITABLE' ELSE 'NOT_FOUND' END"


@query(
    "q_regions",
    f"WITH {_WORDS} SELECT 'p:' || k AS property_shape_iri, {_STATUS.format('stored')} AS status, CASE WHEN {_STATUS.format('stored')} = 'RESOLVED' THEN stored END AS content FROM k LEFT JOIN a USING (k)",
)
def regions(spark, sf):
    """Words, images and pages under the polygon of every page."""
    found = resolve.resolve_regions(page_regions(spark, sf), page_words(spark, sf, now=False), *page_tables(spark, sf))
    return found.select("property_shape_iri", "status", "content")


def svg_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Every region cited with the hash of its words, or of none."""
    rows = page_regions(spark, sf)
    found = resolve.resolve_regions(rows, page_words(spark, sf, now=False), *page_tables(spark, sf))
    return rows.join(found.select("property_shape_iri", "current_hash"), "property_shape_iri").select(
        "property_shape_iri", F.lit(SVG_SELECTOR).alias("selector_type"), "selector_value", "page",
        F.coalesce("current_hash", F.lit("sha256:none")).alias("content_hash"), F.col("doc_uri").alias("source_uri"), "doc_uri",
    )


_SVG_DRIFT = (
    f"SELECT 'p:' || k AS property_shape_iri, {_STATUS.format('now')} AS current_status, NOT ({_STATUS.format('now')} = 'RESOLVED' AND stored IS NOT NULL AND now = stored) AS changed FROM k LEFT JOIN a USING (k) LEFT JOIN b USING (k)"
)


@query("q_svg_drift", f"WITH {_WORDS} {_SVG_DRIFT}")
def svg_drift(spark, sf):
    """Drift of regions against the words of today."""
    found = drift.check_svg_drift(svg_citations(spark, sf), page_words(spark, sf, now=True), *page_tables(spark, sf))
    return found.select("property_shape_iri", "current_status", "changed")


@query("q_check_drift", f"WITH {_WORDS}, x AS (SELECT 's:' || s_suppkey AS property_shape_iri, {_AFTER} FROM supplier) SELECT property_shape_iri, current_status, changed FROM x UNION ALL {_SVG_DRIFT}")
def check_drift(spark, sf):
    """Citations of elements and of regions in one table."""
    both = xpath_citations(spark, sf).unionByName(svg_citations(spark, sf))
    nodes = cut_unsized(parse_documents(nation_documents(suppliers_today(spark, sf))))
    return drift.check_drift(both, nodes, page_words(spark, sf, now=True), *page_tables(spark, sf)).select("property_shape_iri", "current_status", "changed")


@query("q_line_order", "SELECT vec_id // 50 AS page, string_agg('w' || vec_id, ' ' ORDER BY round(embedding[2]::DOUBLE, 1), embedding[1]::DOUBLE) AS text, count(*) AS n_words FROM embeddings GROUP BY 1")
def line_order(spark, sf):
    """Words of each page by rounded top, then from left to right."""
    words = page_words(spark, sf, now=False).withColumn("k", F.col("doc_uri").cast("long") * 10 + F.col("page") - 1)
    return resolve.reading_order(words, "k").select(F.col("k").alias("page"), "text", "n_words")


@query("q_resolve_texts", f"WITH {_TODAY}, c AS (SELECT doc_id, count(*) AS n, min(text) AS text FROM today GROUP BY doc_id), r AS (SELECT d.doc_id, coalesce(n, 0) AS n, c.text FROM documents d LEFT JOIN c USING (doc_id)) SELECT doc_id, CASE n WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE n WHEN 1 THEN {_HASH.format('text')} END AS current_hash FROM r")
def resolve_texts(spark, sf):
    """Whole documents as spans, resolved in the documents of today."""
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("property_shape_iri"), F.col("doc_id").alias("doc_uri"))
    found = resolve.resolve_texts(wanted, today(spark, sf).select(F.col("doc_id").alias("doc_uri"), "text"))
    return found.select(F.col("property_shape_iri").alias("doc_id"), "status", "current_hash")


# ---------------------------------------------------------------- runs


def documented_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_uri, content): a schema for each brand with an element for each part, every third documented as on the pages, every third by one letter; some elements stand on no page."""
    key = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(" of "), key)).when(F.col("p_partkey") % 3 == 1, "x")
    note = F.when(said.isNull(), "").otherwise(F.concat(F.lit('<xs:annotation><xs:documentation xml:lang="de">'), said, F.lit("</xs:documentation></xs:annotation>")))
    item = F.concat(F.lit('<xs:element name="Part'), key, F.lit('">'), note, F.lit("</xs:element>"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('<xs:element name="Other'), key, F.lit('"/>'))).otherwise(""))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("xml")))), lambda x: x["xml"]), "")
    text = F.concat(F.lit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:parts">'), items, F.lit("</xs:schema>"))
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("doc_uri")).agg(text.cast("binary").alias("content"))


@query(
    "q_run_pipeline",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part)
SELECT 'Part' || p_partkey AS name, 'attached' AS state, p_type || ' of ' || p_partkey AS text, p_brand AS doc_uri, (r // 5 + 1 + (r % 5 = 4)::INTEGER)::INTEGER AS page,
       CASE WHEN p_partkey % 3 = 1 THEN 'length_ratio' END AS issues FROM t
UNION ALL SELECT 'Other' || p_partkey, 'unmatched', NULL, NULL, NULL, NULL FROM t WHERE p_partkey % 5 = 0""",
)
def run_of_parts(spark, sf):
    """A whole run over schemas and pages of the parts, read back from its store: states, places and issues of all constructs."""
    documents = cut(documented_parts(spark, sf))
    store = runs.RunStore(spark, f"{shared_folder(spark)}/runs-{uuid4()}")
    sources = documents.select(F.col("doc_uri").alias("path"), "content")
    runs.run_pipeline(store, "run 1", "2026-01-01T00:00:00Z", cut_unsized(parse_documents(documents)), printed_parts(spark, sf), sources)
    states, faults, places = (store.read("run 1", k) for k in ("coverage", "issues", "provenance"))
    return (
        states.join(places.select("uri", "doc_uri", "page").hint("merge"), "uri", "left")
        .join(faults.select("uri", F.array_join("issues", ",").alias("issues")).hint("merge"), "uri", "left")
        .select("name", "state", "text", "doc_uri", "page", "issues")
    )


@query(
    "q_load_and_validate",
    """SELECT 'urn:n:' || s_nationkey || ':' || s_suppkey AS subject_id, 'http://www.w3.org/2002/07/owl#Thing' AS object_id, CASE WHEN s_suppkey % 10 <> 6 THEN s_suppkey % 10 / 10.0::DOUBLE END AS confidence
FROM supplier WHERE s_suppkey % 10 NOT IN (1, 2, 3, 4)""",
)
def load_and_validate(spark, sf):
    """The mapping files of the nations without their faulty rows, written to the shared folder, loaded and held against a graph and a vocabulary."""
    faulty = (F.col("line_num") > 100) & ((F.col("line_num") - 101) % 10).isin(1, 2, 3, 4)
    folder = f"{shared_folder(spark)}/mappings-{uuid4()}"
    lines = mapping_lines(spark, sf).where(~faulty).repartition("src_path").sortWithinPartitions("src_path", "line_num")
    lines.select("src_path", "line").write.partitionBy("src_path").text(folder)
    typed = lambda rows, kind: rows.select("s", F.lit(iri("rdf:type")).alias("p"), F.lit(iri(kind)).alias("o"))
    shapes = table(spark, sf, "supplier").select(F.concat(F.lit("urn:n:"), F.col("s_nationkey").cast("string"), F.lit(":"), F.col("s_suppkey").cast("string")).alias("s"))
    known = table(spark, sf, "region").select(F.lit(iri("owl:Thing")).alias("s")).distinct()
    found = align.load_and_validate(spark, f"{folder}/*/part-*", typed(shapes, "sh:PropertyShape"), typed(known, "owl:Class"))
    return found.select("subject_id", "object_id", "confidence")


# ---------------------------------------------------------------- reviews and proposals


_APPROVED = "SELECT doc_id FROM labels GROUP BY doc_id HAVING bool_or(quality = 1) AND NOT bool_or(toxic = 1)"


@query("q_review_summary", f"WITH {_PROBLEMS}, v AS ({_APPROVED}) SELECT p.* FROM p WHERE fact_key NOT IN (SELECT doc_id FROM v) AND fact_key NOT IN (SELECT doc_id FROM documents WHERE source IN ('src3', 'src7'))")
def review_summary(spark, sf):
    """Open problems of all documents: two families are lost and left out, approved problems are suppressed."""
    docs = table(spark, sf, "documents")
    revisions = docs.select(F.col("doc_id").alias("fact_key"), F.col("source").alias("family"), terms.text_hash(F.col("text")).alias("content_hash"))
    snapshot = docs.select(F.col("source").alias("family")).distinct().where(~F.col("family").isin("src3", "src7"))
    now = today(spark, sf).select(F.col("doc_id").alias("key"), terms.text_hash(F.col("text")).alias("current_hash"))
    verdicts = table(spark, sf, "labels").select("doc_id", F.explode(F.array(F.when(F.col("quality") == 1, "APPROVED"), F.when(F.col("toxic") == 1, "REJECTED"))).alias("verdict"))
    reviews = problems(spark, sf).join(verdicts.where("verdict IS NOT NULL"), F.col("fact_key") == F.col("doc_id")).select("fact_key", "drift_kind", F.col("fingerprint").alias("reviewed_fingerprint"), "verdict")
    return drift.review_summary(revisions, snapshot, now, reviews)["open"].select("fact_key", "drift_kind", "fingerprint")


@query(
    "q_grouped_problems",
    f"WITH {_PROBLEMS} SELECT source, count(*) AS n, string_agg(drift_kind || ':' || fingerprint, ',' ORDER BY drift_kind, fingerprint) AS problems FROM p JOIN documents ON doc_id = fact_key GROUP BY source",
)
def grouped_problems(spark, sf):
    """The problems of each family as one sorted list."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("fact_key"), "source")
    listed = drift.grouped(problems(spark, sf).join(docs, "fact_key"), "source")
    written = F.array_join(F.transform("problems", lambda p: F.concat_ws(":", p["drift_kind"], p["fingerprint"])), ",")
    return listed.select("source", F.size("problems").cast("long").alias("n"), written.alias("problems"))


@query(
    "q_propose",
    """WITH c AS (SELECT 'c' || o_orderkey AS correction, o_custkey AS s, o_orderkey % 4 AS k FROM orders),
r AS (SELECT correction FROM c WHERE k IN (1, 2) AND s IN (SELECT s FROM c WHERE k = 3))
SELECT correction, outcome, decider, CASE WHEN outcome = 'rejected' THEN '2026-01-02' ELSE '2026-01-01' END AS generated_at FROM
  (SELECT correction, 'approved' AS outcome, 'someone' AS decider FROM c WHERE k = 0 UNION ALL SELECT correction, 'rejected', 'system' FROM r)""",
)
def propose(spark, sf):
    """Decisions after a quarter of the orders has been proposed anew: open ones on the same customer are rejected by the system."""
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("correction"), F.col("o_custkey").cast("string").alias("s"), F.lit("p").alias("p"), F.lit("de").alias("o_lang"), (F.col("o_orderkey") % 4).alias("k")
    )
    made = lambda *k: rows.where(F.col("k").isin(*k)).drop("k")
    decided = made(0).select("correction", F.lit("approved").alias("outcome"), F.lit("someone").alias("decider"), F.lit("2026-01-01").alias("generated_at"))
    return history.propose(made(0, 1, 2), decided, made(3), "2026-01-02")[1]


@query(
    "q_annotate_svg",
    """SELECT 'p' || p_partkey AS property_name, p_size % 7 + 1 AS page, '<svg:polygon points=''0,0 ' || p_size || ',0 ' || p_size || ',' || (p_size + 1) || ''' xmlns:svg=''http://www.w3.org/2000/svg''/>' AS selector_value FROM part""",
)
def annotate_regions(spark, sf):
    """A citation of a triangle for each part."""
    size = F.col("p_size").cast("string")
    rows = table(spark, sf, "part").select(
        F.lit("S").alias("standard"), F.col("p_brand").alias("shape_name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("property_name"), (F.col("p_size") % 7 + 1).alias("page"),
        F.concat(F.lit("0,0 "), size, F.lit(",0 "), size, F.lit(","), (F.col("p_size") + 1).cast("string")).alias("points"), F.lit("urn:doc").alias("source_uri"), F.lit("sha256:x").alias("content_hash"),
    )
    return annotate.annotate_svg(rows).select("property_name", "page", "selector_value")


# ---------------------------------------------------------------- selectors of any kind


def any_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers by path, customers by JSON pointer into a document of their nation, parts as whole texts, regions by a kind of their own."""
    rows = xpath_citations(spark, sf).drop("page", "source_uri")
    hashed = lambda text: F.concat(F.lit("sha256:"), F.sha2(text, 256))

    def cited(name: str, letter: str, key: str, kind: str, value: Column, digest: Column, doc: Column) -> DataFrame:
        id_ = F.concat(F.lit(letter + ":"), F.col(key).cast("string"))
        return table(spark, sf, name).select(
            id_.alias("property_shape_iri"), F.lit(kind).alias("selector_type"), value.alias("selector_value"), digest.alias("content_hash"), doc.alias("doc_uri")
        )

    pointer = F.concat(F.lit("/c"), F.col("c_custkey").cast("string"), F.lit("/name"))
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))
    return (
        rows.unionByName(cited("customer", "c", "c_custkey", JSON_SELECTOR, pointer, hashed(quoted), F.col("c_nationkey").cast("string")))
        .unionByName(cited("part", "p", "p_partkey", TEXT_SELECTOR, F.lit(""), terms.text_hash(F.col("p_name")), F.col("p_partkey").cast("string")))
        .unionByName(cited("region", "r", "r_regionkey", "urn:row", F.lit("name"), hashed(F.col("r_name")), F.col("r_regionkey").cast("string")))
    )


@query(
    "q_selector_kinds",
    f"""SELECT 's:' || s_suppkey AS property_shape_iri, {_AFTER} FROM supplier
UNION ALL SELECT 'c:' || c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'NOT_FOUND' ELSE 'RESOLVED' END, c_custkey % 3 > 0,
  CASE c_custkey % 3 WHEN 0 THEN 'sha256:' || sha256('"' || c_name || '"') WHEN 1 THEN 'sha256:' || sha256('"' || c_name || '!"') END FROM customer
UNION ALL SELECT 'p:' || p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NOT_FOUND' WHEN 2 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END, p_partkey % 5 IN (0, 1, 2),
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 1 THEN 'sha256:' || sha256(p_name || '!') ELSE 'sha256:' || sha256(p_name) END FROM part
UNION ALL SELECT 'r:' || r_regionkey, 'RESOLVED', false, 'sha256:' || sha256(r_name) FROM region""",
)
def selector_kinds(spark, sf):
    """Drift of citations of four kinds and a fifth that is registered here, in one table."""
    nodes = cut_unsized(parse_documents(nation_documents(suppliers_today(spark, sf))))
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    now = table(spark, sf, "customer").where(k != 2).select(
        F.col("c_nationkey").cast("string").alias("doc_uri"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"),
        F.struct(F.when(k == 1, F.concat(name, F.lit("!"))).otherwise(name).alias("name"), F.lit(1).alias("a")).alias("value"),
    )
    json = now.groupBy("doc_uri").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("content"))
    p = F.col("p_partkey") % 5
    texts = table(spark, sf, "part").where(p != 0).select(
        F.col("p_partkey").cast("string").alias("doc_uri"), F.explode(F.array_repeat(F.when(p == 1, F.concat("p_name", F.lit("  !"))).otherwise(F.col("p_name")), F.when(p == 2, 2).otherwise(1))).alias("text")
    )
    texts = texts.withColumn("text", F.replace("text", F.lit("  !"), F.lit("!")))

    def by_row(rows: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
        held = sources["regions"].select(F.col("r_regionkey").cast("string").alias("doc_uri"), "r_name")
        done = F.col("r_name").isNotNull()
        return rows.join(held, "doc_uri", "left").select(
            "property_shape_iri", F.when(done, "RESOLVED").otherwise("NOT_FOUND").alias("status"), F.col("r_name").alias("content"), F.concat(F.lit("sha256:"), F.sha2("r_name", 256)).alias("current_hash")
        )

    selectors.register("urn:row", by_row, replace=True)
    found = selectors.check_any_drift(any_citations(spark, sf), {"nodes": nodes, "json": json, "texts": texts, "regions": table(spark, sf, "region")})
    return found.select("property_shape_iri", "current_status", "changed", "current_hash")


# ---------------------------------------------------------------- mapping files


def mapping_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping file for each nation: a header, a row for each supplier, and among ten keys some that are faulty.

    Of ten suppliers 1 has a cell too few, 2 no justification, 3 an unknown prefix, 4 a
    confidence that is no number, 6 an empty confidence.
    """
    nations = table(spark, sf, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("src_path"), "n_nationkey", "n_name")
    heads = nations.select(
        "src_path",
        F.posexplode(
            F.array(
                F.concat(F.lit("#mapping_set_id: "), F.col("n_name")), F.lit("#curie_map:"), F.concat(F.lit("#  n: urn:n:"), F.col("n_nationkey").cast("string"), F.lit(":")),
                F.lit("#license: none"), F.lit("subject_id\tpredicate_id\tobject_id\tmapping_justification\tconfidence"),
            )
        ).alias("pos", "line"),
    )
    k = F.col("s_suppkey") % 10
    cells = [
        F.concat(F.when(k == 3, F.lit("nope:")).otherwise(F.lit("n:")), F.col("s_suppkey").cast("string")), F.lit("skos:exactMatch"), F.lit("owl:Thing"),
        F.when(k == 2, F.lit("")).otherwise(F.lit("semapv:ManualMappingCuration")),
    ]
    number = F.when(k == 4, F.lit("high")).when(k == 6, F.lit("")).otherwise(F.concat(F.lit("0."), k.cast("string")))
    line = F.when(k == 1, F.concat_ws("\t", *cells)).otherwise(F.concat_ws("\t", *cells, number))
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("src_path"), (F.col("s_suppkey") + 100).alias("pos"), line.alias("line")
    )
    return heads.unionByName(rows).select("src_path", (F.col("pos") + 1).cast("int").alias("line_num"), "line")


@query(
    "q_mapping_rows",
    "SELECT (s_suppkey + 101)::INTEGER AS line_num, 'f' || s_nationkey AS src_path, CASE WHEN k IN (1, 2, 3, 4) THEN CASE k WHEN 1 THEN 'wrong number of columns' "
    "WHEN 2 THEN 'required column mapping_justification is missing or empty' WHEN 3 THEN 'unknown prefix in subject_id' ELSE 'confidence is no number: high' END END AS fault, "
    "CASE WHEN k NOT IN (1, 3) THEN 'urn:n:' || s_nationkey || ':' || s_suppkey END AS subject_id, CASE WHEN k <> 1 THEN 'http://www.w3.org/2004/02/skos/core#exactMatch' END AS predicate_id, "
    "CASE WHEN k NOT IN (1, 4, 6) THEN k / 10.0::DOUBLE END AS confidence FROM (SELECT *, s_suppkey % 10 AS k FROM supplier)",
)
def mapping_rows(spark, sf):
    """Rows of mapping files with what is wrong with them; prefixes come from each file's header."""
    found = parse_mappings(mapping_lines(spark, sf))
    fault = F.when(F.col("fault").startswith("unknown prefix"), F.array_join(F.slice(F.split("fault", " "), 1, 4), " ")).otherwise(F.col("fault"))
    return found.select("line_num", "src_path", fault.alias("fault"), "subject_id", "predicate_id", "confidence")


@query("q_mapping_header", "SELECT 'f' || n_nationkey AS src_path, n_name AS mapping_set, 'none' AS license FROM nation")
def mapping_header(spark, sf):
    found = header(mapping_lines(spark, sf))
    return found.select("src_path", F.col("metadata")["mapping_set_id"].alias("mapping_set"), F.col("metadata")["license"].alias("license"))


@query("q_mapping_triples", "SELECT 'urn:n:' || s_nationkey || ':' || s_suppkey AS s, 'http://www.w3.org/2004/02/skos/core#exactMatch' AS p, 'http://www.w3.org/2002/07/owl#Thing' AS o FROM supplier WHERE s_suppkey % 10 NOT IN (1, 2, 3, 4)")
def mapping_triples(spark, sf):
    """Triples of the mappings without a fault."""
    return align.mapping_triples(parse_mappings(mapping_lines(spark, sf)).where("fault IS NULL")).select("s", "p", "o")


# ---------------------------------------------------------------- task documents and history


def task_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as tasks of a document, their lines as subtasks."""
    done = F.col("l_linestatus") == "F"
    sha = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.sha1(F.col("l_orderkey").cast("string"))))
    evidence = F.struct(sha.alias("commits"), F.array().cast("array<string>").alias("prs"))
    subtask = F.struct(F.col("l_linenumber").cast("string").alias("id"), F.when(done, "done").otherwise("pending").alias("status"), evidence.alias("evidence"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(subtask)).alias("subtasks"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("in-progress")
    none = F.struct(F.array().cast("array<string>").alias("commits"), F.array().cast("array<string>").alias("prs"))
    task = F.struct(F.col("o_orderkey").cast("string").alias("id"), status.alias("status"), none.alias("evidence"), "subtasks")
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    tasks = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(task)).alias("tasks"))
    finished = F.size(F.filter("tasks", lambda t: t["status"] == "done"))
    meta = F.struct(F.size("tasks").alias("taskCount"), (finished + F.when(F.col("o_custkey") % 9 == 0, 1).otherwise(0)).alias("completedCount"))
    return tasks.select(F.col("o_custkey").cast("string").alias("doc_uri"), F.struct("tasks", meta.alias("metadata")).alias("master"))


_TASKS = (
    "l AS (SELECT l_orderkey, count(*) AS n, bool_and(l_linestatus = 'F') AS every, bool_and(l_linestatus <> 'F') AS no FROM lineitem GROUP BY 1), "
    "o AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'in-progress' END AS status, n, "
    "CASE WHEN every THEN 'done' WHEN no THEN 'pending' ELSE 'in-progress' END AS derived FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)"
)


@query(
    "q_task_faults",
    f"WITH {_TASKS} SELECT o_custkey::VARCHAR AS doc_uri, o_orderkey::VARCHAR AS item, 'status does not follow from subtasks' AS fault FROM o WHERE n IS NOT NULL AND status <> derived "
    "UNION ALL SELECT o_custkey::VARCHAR, o_orderkey::VARCHAR, 'done without evidence' FROM o WHERE n IS NULL AND status = 'done' "
    "UNION ALL SELECT o_custkey::VARCHAR, l_orderkey || '.' || l_linenumber, 'done without evidence' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' AND l_linenumber % 3 = 0 "
    "UNION ALL SELECT DISTINCT o_custkey::VARCHAR, 'metadata', 'completedCount is wrong' FROM orders WHERE o_custkey % 9 = 0",
)
def task_faults(spark, sf):
    return audit.task_faults(task_documents(spark, sf))


@query(
    "q_task_summary",
    f"WITH {_TASKS}, e AS (SELECT o_custkey, count(*) AS evidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' AND l_linenumber % 3 <> 0 GROUP BY 1) "
    "SELECT o_custkey::VARCHAR AS doc_uri, count(*)::INTEGER AS tasks, coalesce(sum(n), 0)::INTEGER AS subtasks, coalesce(max(evidence), 0)::BIGINT AS evidence FROM o LEFT JOIN e USING (o_custkey) GROUP BY o_custkey",
)
def task_summary(spark, sf):
    return audit.task_counts(task_documents(spark, sf))


@query("q_pending_corrections", "SELECT event_id || '-' || event_type AS correction, event_type AS proposer FROM events WHERE event_id % 3 <> 0")
def pending_corrections(spark, sf):
    """Corrections without a decision: every third event decides on its own."""
    events = table(spark, sf, "events").withColumn("correction", F.concat(F.col("event_id").cast("string"), F.lit("-"), F.col("event_type")))
    return history.pending(events.select("correction"), events.where("event_id % 3 = 0").select("correction"))


@query("q_unchanged_standards", "SELECT p_brand AS standard, NOT bool_or(p_size = 50) AS unchanged FROM part GROUP BY p_brand")
def unchanged_standards(spark, sf):
    """Which standards would stay as they are if all parts of size 50 were cited anew."""
    rows = citations(spark, sf)
    fresh = table(spark, sf, "part").where("p_size = 50").select(F.concat(F.lit("/part["), F.col("p_partkey").cast("string"), F.lit("]")).alias("selector_value"), F.lit("new").alias("new"))
    new = rows.join(fresh, "selector_value", "left").withColumn("content_hash", F.coalesce("new", "content_hash")).select(*rows.columns)
    return unchanged_by(rows, new, "standard")


@query(
    "q_content_model_cases",
    "WITH b AS (SELECT max(p_size) AS high FROM part), a AS (SELECT unnest([0, 1, high]) AS x, true AS ok FROM b UNION ALL SELECT high + 1, false FROM b), "
    "c AS (SELECT unnest([1, 2, 5]) AS y) SELECT DISTINCT x, y, ok AS should_be_valid FROM a CROSS JOIN c",
)
def content_model_cases(spark, sf):
    """Cases of a content model of two particles, the first bounded by the largest size of a part."""
    (high,) = table(spark, sf, "part").agg(F.max("p_size")).first()
    cases = schemas.structural_cases(spark, [("a", 0, high), ("b", 1, None)], beyond=True)
    return cases.select(F.col("case")["a"].alias("x"), F.col("case")["b"].alias("y"), "should_be_valid")


# ---------------------------------------------------------------- property paths and named graphs


@query(
    "q_property_path_mixed",
    "WITH n AS (SELECT 'urn:s:' || s_suppkey AS s, 'urn:n:' || s_nationkey AS n, 'urn:r:' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey), "
    "e AS (SELECT s AS a, n AS b FROM n UNION ALL SELECT 'urn:n:' || n_nationkey, 'urn:r:' || n_regionkey FROM nation), "
    "i AS (SELECT s AS a, r AS b, 'sequence' AS path FROM n UNION ALL SELECT b, a, 'inverse' FROM e UNION ALL SELECT a, b, 'alternative' FROM e "
    "UNION ALL SELECT 'urn:n:' || n_nationkey, n_name, 'alternative' FROM nation UNION ALL SELECT 'urn:r:' || r_regionkey, r_name, 'alternative' FROM region WHERE r_name <> 'ASIA') "
    'SELECT a AS start, b AS "end", path FROM i',
)
def property_path_mixed(spark, sf):
    """``in/in``, ``^in`` and ``in|name``."""
    g = geo(spark, sf)
    inside, named = patterns.step(g, "urn:in"), patterns.step(g, "urn:name")
    paths = {"sequence": patterns.sequence(inside, inside), "inverse": patterns.inverse(inside), "alternative": patterns.alternative(inside, named)}
    return patterns.alternative(*(p.withColumn("path", F.lit(name)) for name, p in paths.items()))


@query(
    "q_property_path_optional",
    "WITH e AS (SELECT 'urn:s:' || s_suppkey AS a, 'urn:n:' || s_nationkey AS b FROM supplier UNION ALL SELECT 'urn:n:' || n_nationkey, 'urn:r:' || n_regionkey FROM nation), "
    "m AS (SELECT n_name AS v FROM nation UNION SELECT r_name FROM region WHERE r_name <> 'ASIA' UNION SELECT 'urn:r:' || r_regionkey FROM region WHERE r_name <> 'ASIA' UNION SELECT a FROM e UNION SELECT b FROM e) "
    'SELECT a AS start, b AS "end" FROM e UNION SELECT v, v FROM m',
)
def property_path_optional(spark, sf):
    g = geo(spark, sf)
    return patterns.zero_or_one(g, patterns.step(g, "urn:in"))


@query("q_named_graphs", "SELECT 'urn:s:' || s_suppkey AS x, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def named_graphs(spark, sf):
    """Suppliers' places in one graph, nations' names in another."""
    g = geo(spark, sf).withColumn("graph", F.when(F.col("s").startswith("urn:s:"), "urn:g:suppliers").otherwise("urn:g:places"))
    placed = patterns.one(g, ("?x", "urn:in", "?y"), graph="urn:g:suppliers")
    return placed.join(patterns.one(g, ("?y", "urn:name", "?name"), graph="urn:g:places"), "y").select("x", "name")
