"""Citations as rows, and their triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PropertyShapeNotFoundError
from ..functions.geometry import polygon_fault, wrap_points
from ..functions.terms import bnode, shape_iri
from ..model import CITATION, SVG_SELECTOR, XPATH_SELECTOR, iri

HINTS = ("sh_name", "sh_order", "dash_editor")


def _citations(rows: DataFrame, kind: str, selector: Column, page: Column) -> DataFrame:
    names = [F.col("standard"), F.col("shape_name"), F.col("property_name")]
    return rows.select(
        shape_iri(*names).alias("property_shape_iri"),
        shape_iri(*names[:2]).alias("node_shape_iri"),
        *names,
        F.lit(kind).alias("selector_type"),
        selector.alias("selector_value"),
        page.cast("int").alias("page"),
        "source_uri",
        "content_hash",
        *[F.lit(None).cast("int" if h == "sh_order" else "string").alias(h) for h in HINTS],
    )


def annotate_xpath(rows: DataFrame) -> DataFrame:
    """Citations of (standard, shape_name, property_name, xpath, source_uri, content_hash).

    Builds what it is told and resolves nothing. The source is the document; hints are empty.
    """
    return _citations(rows, XPATH_SELECTOR, F.col("xpath"), F.lit(None))


def annotate_svg(rows: DataFrame) -> DataFrame:
    """Citations of page regions, with page and points; a malformed polygon is an error."""
    fault = polygon_fault(F.col("points"))
    points = F.when(fault.isNull(), F.col("points")).otherwise(F.raise_error(F.concat(fault, F.lit(": "), F.col("points"))))
    return _citations(rows, SVG_SELECTOR, wrap_points(points), F.col("page"))


def node_shapes(citations: DataFrame) -> DataFrame:
    return citations.select("node_shape_iri", "standard", "shape_name").distinct()


def star_triples(citations: DataFrame, graph: str | Column = "") -> DataFrame:
    """The triples of citations: 12 for each, 13 with a page, hints besides; a set. ``graph`` is one name, or a column of names."""
    shape, node = F.col("property_shape_iri"), F.col("node_shape_iri")
    path, note = F.concat(shape, F.lit("/path")), F.concat(shape, F.lit("/annotation"))
    target, selector = bnode(shape, "target"), bnode(shape, "selector")

    def triple(s: Column, p: str, o: Column, o_kind: str, o_dt: str = "", s_kind: str = "iri", keep: Column | None = None) -> Column:
        made = F.struct(
            s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(iri(p)).alias("p"), o.cast("string").alias("o"),
            F.lit(o_kind).alias("o_kind"), F.lit(o_dt).alias("o_dt"), F.lit("").alias("o_lang"),
        )
        return made if keep is None else F.when(keep, made)

    number = iri("xsd:integer")
    kind = F.when(F.col("selector_type") == XPATH_SELECTOR, iri("oa:XPathSelector")).otherwise(iri("oa:SvgSelector"))
    star = F.array(
        triple(node, "rdf:type", F.lit(iri("sh:NodeShape")), "iri"),
        triple(node, "sh:property", shape, "iri"),
        triple(shape, "rdf:type", F.lit(iri("sh:PropertyShape")), "iri"),
        triple(shape, "sh:path", path, "iri"),
        triple(shape, "prov:wasDerivedFrom", note, "iri"),
        triple(note, "rdf:type", F.lit(iri("oa:Annotation")), "iri"),
        triple(shape, "gen:contentHash", F.col("content_hash"), "literal"),
        triple(note, "oa:hasTarget", target, "bnode"),
        triple(target, "oa:hasSource", F.col("source_uri"), "iri", s_kind="bnode"),
        triple(target, "oa:hasSelector", selector, "bnode", s_kind="bnode"),
        triple(selector, "rdf:type", kind, "iri", s_kind="bnode"),
        triple(selector, "rdf:value", F.col("selector_value"), "literal", s_kind="bnode"),
        triple(target, "gen:page", F.col("page"), "literal", number, "bnode", F.col("page").isNotNull()),
        triple(shape, "sh:name", F.col("sh_name"), "literal", keep=F.col("sh_name").isNotNull()),
        triple(shape, "sh:order", F.col("sh_order"), "literal", number, keep=F.col("sh_order").isNotNull()),
        triple(shape, "dash:editor", F.col("dash_editor"), "iri", keep=F.col("dash_editor").isNotNull()),
    )
    rows = citations.select(F.lit(graph).alias("graph"), F.explode(F.filter(star, lambda t: t.isNotNull())).alias("t"))
    return rows.select("graph", "t.*").dropDuplicates()


def clear_property_shapes(citations: DataFrame, shapes: DataFrame) -> DataFrame:
    """Citations without those of the given property shapes; node shapes of others stay."""
    return citations.join(shapes.select("property_shape_iri").distinct(), "property_shape_iri", "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A citation replaces that of its property shape whole, display hints included; others stay."""
    return clear_property_shapes(existing, incoming).unionByName(incoming)


def patch_hints(citations: DataFrame, hints: DataFrame) -> DataFrame:
    """Set the hints that are given (NULL leaves a field as it is); a hint on no citation is an error."""
    missing = hints.join(citations, "property_shape_iri", "left_anti").select("property_shape_iri").limit(5).collect()
    if missing:
        raise PropertyShapeNotFoundError(", ".join(r[0] for r in missing))
    new = hints.select("property_shape_iri", *[F.col(h).alias(f"new_{h}") for h in HINTS])
    joined = citations.join(new, "property_shape_iri", "left")
    columns = [f.split()[0] for f in CITATION.split(", ")]
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in HINTS else F.col(c) for c in columns])


def union_graphs(*graphs: DataFrame) -> DataFrame:
    """Set union of triples."""
    out = graphs[0]
    for graph in graphs[1:]:
        out = out.unionByName(graph)
    return out.dropDuplicates()


def property_order(citations: DataFrame) -> DataFrame:
    """Properties in display order: by sh:order where all of a node shape have one, else by IRI."""
    from pyspark.sql import Window

    every = F.every(F.col("sh_order").isNotNull()).over(Window.partitionBy("node_shape_iri"))
    key = F.when(F.col("ordered"), F.col("sh_order"))
    place = F.row_number().over(Window.partitionBy("node_shape_iri").orderBy(key.asc_nulls_first(), "property_shape_iri"))
    return citations.withColumn("ordered", every).withColumn("place", place)
