"""Kinds of selectors: an open registry of resolvers, and drift checks of citations of any kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pointer import is_pointer, json_at, read_json
from ..model import JSON_SELECTOR, SVG_SELECTOR, TEXT_SELECTOR, XPATH_SELECTOR
from ..plans.lineage import cut_unsized
from .drift import changed
from .resolve import resolve_regions, resolve_texts, resolve_xpath

#: Takes citations of one kind and named source tables; gives property_shape_iri, status, content, current_hash.
Resolver = Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]
_RESOLVERS: dict[str, Resolver] = {}


def register(kind: str, resolver: Resolver, replace: bool = False) -> None:
    """Make a kind of selector known; a known one is replaced only if asked."""
    if kind in _RESOLVERS and not replace:
        raise ValueError(f"selector kind {kind!r} is already registered")
    _RESOLVERS[kind] = resolver


def unregister(kind: str) -> None:
    _RESOLVERS.pop(kind, None)


def kinds() -> list[str]:
    return sorted(_RESOLVERS)


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values at pointers, from rows sorted by document: each document (n > 0), then its citations (n = 0), which are answered with its n."""
    held, n, value = None, 0, None
    for batch in batches:
        out = []
        for doc_uri, count, document, shape, pointer in zip(batch["doc_uri"], batch["n"], batch["document"], batch["property_shape_iri"], batch["selector_value"]):
            if count:
                held, n, value = doc_uri, count, read_json(document)
            elif n and held == doc_uri:
                out.append((shape, pointer, n, json_at(value, pointer)))
            else:
                out.append((shape, pointer, 0, None))
        yield pd.DataFrame(out, columns=["property_shape_iri", "selector_value", "n", "value"])


def resolve_json(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """JSON pointers (RFC 6901) into ``documents`` (doc_uri, content): the value as canonical JSON, and its hash.

    A malformed pointer is UNCITABLE; an absent document, one that is no JSON, and a value that isn't there are
    NOT_FOUND; a document that is there twice is AMBIGUOUS. A document meets its citations in one task: it comes
    first, is parsed once and not copied to each of them.
    """
    none = F.lit(None).cast("string")
    found = documents.groupBy("doc_uri").agg(F.count("*").alias("n"), F.min("content").alias("document"))
    held = found.where("doc_uri IS NOT NULL").select("doc_uri", "n", F.when(F.col("n") == 1, F.col("document")).alias("document"), none.alias("property_shape_iri"), none.alias("selector_value"))
    asked = citations.select("doc_uri", F.lit(0).cast("long").alias("n"), none.alias("document"), "property_shape_iri", "selector_value")
    both = held.unionByName(asked).repartition("doc_uri").sortWithinPartitions("doc_uri", F.desc("n"))
    answered = both.mapInPandas(_answers, "property_shape_iri string, selector_value string, n long, value string")
    status = (
        F.when(~is_pointer(F.col("selector_value")), "UNCITABLE").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("value").isNull(), "NOT_FOUND").otherwise("RESOLVED")
    )
    done = F.col("status") == "RESOLVED"
    return answered.withColumn("status", status).select(
        "property_shape_iri", "status", F.when(done, F.col("value")).alias("content"), F.when(done, F.concat(F.lit("sha256:"), F.sha2("value", 256))).alias("current_hash")
    )


register(XPATH_SELECTOR, lambda rows, sources: resolve_xpath(rows.select("property_shape_iri", "doc_uri", "selector_value"), sources["nodes"]))
register(SVG_SELECTOR, lambda rows, sources: resolve_regions(rows.select("property_shape_iri", "doc_uri", "page", "selector_value"), sources["words"], sources["boxes"], sources["pages"]))
register(JSON_SELECTOR, lambda rows, sources: resolve_json(rows.select("property_shape_iri", "doc_uri", "selector_value"), sources["json"]))
register(TEXT_SELECTOR, lambda rows, sources: resolve_texts(rows.select("property_shape_iri", "doc_uri"), sources["texts"]))


def resolve_any(citations: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """(property_shape_iri, status, content, current_hash) of citations of all kinds, each by its kind's resolver.

    The kinds that occur are looked up first: an unknown one is a LookupError before anything
    is resolved, and resolvers of kinds that don't occur (and their sources) aren't asked.
    """
    rows = cut_unsized(citations)
    present = sorted(r[0] or "" for r in rows.select("selector_type").distinct().collect())
    unknown = [k for k in present if k not in _RESOLVERS]
    if unknown:
        raise LookupError(f"no resolver for selector kinds {unknown}; known are {kinds()}")
    found = None
    for kind in present:
        own = _RESOLVERS[kind](rows.where(F.col("selector_type") == kind), sources).select("property_shape_iri", "status", "content", "current_hash")
        found = own if found is None else found.unionByName(own)
    empty = "property_shape_iri string, status string, content string, current_hash string"
    return citations.sparkSession.createDataFrame([], empty) if found is None else found


def check_any_drift(citations: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
    """Drift of citations of all registered kinds: (property_shape_iri, changed, current_status, content_hash, current_hash).

    As many citations as resolved rows meet, in a sort-merge join whatever sizes are estimated.
    """
    resolved = resolve_any(citations, sources)
    return citations.select("property_shape_iri", "content_hash").join(resolved.hint("merge"), "property_shape_iri").select(
        "property_shape_iri",
        changed(F.col("status"), F.col("current_hash"), F.col("content_hash")).alias("changed"),
        F.col("status").alias("current_status"),
        "content_hash",
        "current_hash",
    )
