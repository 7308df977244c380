"""Drift: what became of a citation in the documents of today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SVG_SELECTOR, XPATH_SELECTOR
from .resolve import resolve_regions, resolve_xpath


def changed(status: Column, current_hash: Column, stored_hash: Column) -> Column:
    """True unless the selector resolves to the very content that was cited."""
    return (status != "RESOLVED") | ~current_hash.eqNullSafe(stored_hash)


def incomplete(citations: DataFrame) -> DataFrame:
    """Citations with the first link that is missing, in the order in which they are followed."""
    missing = (
        F.when(F.col("content_hash").isNull(), F.lit("no gen:contentHash"))
        .when(F.col("source_uri").isNull(), F.lit("no oa:hasSource"))
        .when(F.col("selector_type").isNull(), F.lit("no selector type"))
        .when(F.col("selector_value").isNull(), F.lit("no rdf:value"))
        .when((F.col("selector_type") == SVG_SELECTOR) & F.col("page").isNull(), F.lit("no gen:page"))
    )
    return citations.select("property_shape_iri", missing.alias("missing")).where("missing IS NOT NULL")


def _complete(citations: DataFrame, kind: str | None) -> DataFrame:
    """Raises (when rows are made) for incomplete citations, and for other selectors than ``kind``."""
    wanted = [kind] if kind else [XPATH_SELECTOR, SVG_SELECTOR]
    name = {XPATH_SELECTOR: "XPath", SVG_SELECTOR: "SVG"}.get(kind or "", "XPath or SVG")
    fault = (
        F.when(F.col("content_hash").isNull(), "no gen:contentHash")
        .when(F.col("selector_value").isNull(), "no rdf:value")
        .when(~F.coalesce(F.col("selector_type").isin(*wanted), F.lit(False)), f"selector is not {name}")
        .when((F.col("selector_type") == SVG_SELECTOR) & F.col("page").isNull(), "no gen:page")
    )
    return citations.withColumn(
        "selector_type",
        F.when(fault.isNull(), F.col("selector_type")).otherwise(F.raise_error(F.concat("property_shape_iri", F.lit(": "), fault))),
    ).where("selector_type IS NOT NULL")


def _compared(citations: DataFrame, resolved: DataFrame) -> DataFrame:
    both = citations.select("property_shape_iri", "content_hash").join(resolved, "property_shape_iri")
    return both.select(
        "property_shape_iri",
        changed(F.col("status"), F.col("current_hash"), F.col("content_hash")).alias("changed"),
        F.col("status").alias("current_status"),
        "content_hash",
        "current_hash",
    )


def check_xpath_drift(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drift of XPath citations against the documents at their ``doc_uri`` today."""
    rows = _complete(citations, XPATH_SELECTOR)
    return _compared(rows, resolve_xpath(rows.select("property_shape_iri", "doc_uri", "selector_value"), nodes))


def check_svg_drift(citations: DataFrame, words: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Drift of page regions."""
    rows = _complete(citations, SVG_SELECTOR)
    return _compared(rows, resolve_regions(rows.select("property_shape_iri", "doc_uri", "page", "selector_value"), words, boxes, pages))


def check_drift(citations: DataFrame, nodes: DataFrame, words: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Drift of all citations by the kind of their selector; an unknown kind is an error."""
    rows = _complete(citations, None)
    return check_xpath_drift(rows.where(F.col("selector_type") == XPATH_SELECTOR), nodes).unionByName(
        check_svg_drift(rows.where(F.col("selector_type") == SVG_SELECTOR), words, boxes, pages)
    )


def text_drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Drift of whole-text citations: (key, content_hash) against (key, current_hash) rows of today."""
    today = current.groupBy("key").agg(F.count("*").alias("n"), F.min("current_hash").alias("current_hash"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "NOT_FOUND").when(n > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return stored.join(today, "key", "left").select(
        "key", changed(status, F.col("current_hash"), F.col("content_hash")).alias("changed"), status.alias("current_status"), "content_hash", "current_hash"
    )


def sweep(references: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to check and those to leave out: any whose families the snapshot doesn't hold all.

    ``references`` has fact_key, family (a row for each leaf); each family is looked up once.
    """
    asked = references.select("family").distinct()
    failed = asked.join(current.select("family").distinct(), "family", "left_anti")
    excluded = references.join(failed, "family", "left_semi").select("fact_key").distinct()
    return references.join(excluded, "fact_key", "left_anti"), excluded


def classify(drift: DataFrame) -> DataFrame:
    """CONTENT where the span is there with other content, STRUCTURAL where it isn't one span any more; healthy rows go."""
    kind = F.when(F.col("current_status") != "RESOLVED", "STRUCTURAL").when(F.col("changed"), "CONTENT")
    print_ = F.when(F.col("current_status") == "RESOLVED", F.col("current_hash")).otherwise(F.col("current_status"))
    return drift.withColumn("drift_kind", kind).where("drift_kind IS NOT NULL").withColumn("fingerprint", print_)


def grouped(problems: DataFrame, key: str = "fact_key") -> DataFrame:
    """Problems of each key as one sorted array; keys without a problem are absent."""
    return problems.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("drift_kind", "fingerprint"))).alias("problems"))


def suppress_reviewed(problems: DataFrame, reviews: DataFrame) -> DataFrame:
    """Problems without those that a review approved and none rejected, by key, kind and fingerprint."""
    key = ["fact_key", "drift_kind", "fingerprint"]
    verdicts = reviews.withColumnRenamed("reviewed_fingerprint", "fingerprint").groupBy(*key).agg(
        F.bool_or(F.col("verdict") == "APPROVED").alias("approved"), F.bool_or(F.col("verdict") == "REJECTED").alias("rejected")
    )
    return problems.join(verdicts.where("approved AND NOT rejected"), key, "left_anti")


def review_summary(revisions: DataFrame, current: DataFrame, today: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """From stored revisions to open problems: sweep, compare, classify, suppress.

    ``revisions`` has fact_key, family, content_hash (the current ones); ``today`` key, current_hash.
    """
    checked, excluded = sweep(revisions, current)
    drift = text_drift(checked.select(F.col("fact_key").alias("key"), "content_hash"), today).withColumnRenamed("key", "fact_key")
    return {"open": suppress_reviewed(classify(drift), reviews), "excluded": excluded}
