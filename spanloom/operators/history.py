"""History: revisions, decisions, corrections, runs and what lies between them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.follow import follow
from ..plans.lineage import cut, shared_folder

TRIPLE = ["s", "p", "o", "o_dt", "o_lang"]


def numbered(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Append-only revisions with ``seq`` from 1 by arrival."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def current_revision(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last revision of each key: an aggregate, so a key's history is never gathered."""
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order)).alias("r")
    return events.groupBy(key).agg(last).select(key, "r.*")


def page_summary(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Number of revisions and the last one's identity for each key."""
    return events.groupBy(key).agg(F.count("*").alias("revisions"), F.max(F.struct(*order)).alias("last"))


def latest_decision(decisions: DataFrame, key: str, outcome: str, *order: str) -> DataFrame:
    return decisions.groupBy(key).agg(F.max_by(outcome, F.struct(*order)).alias("outcome"))


def supersede(proposals: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Proposals with the one that replaced them while they were pending, if any."""
    following = F.lead(F.struct(*order)).over(Window.partitionBy(*keys).orderBy(*order))
    return proposals.withColumn("superseded_by", following).withColumn("superseded", F.col("superseded_by").isNotNull())


def pending(corrections: DataFrame, decisions: DataFrame, key: str = "correction") -> DataFrame:
    """Corrections nobody decided on; the proposer is the last part of the id."""
    return corrections.join(decisions.select(key).distinct(), key, "left_anti").withColumn("proposer", F.substring_index(key, "-", -1))


def propose(corrections: DataFrame, decisions: DataFrame, proposal: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Add proposals; an earlier pending one on the same subject, predicate and language is rejected by the system.

    Ids and the time come from the caller: a plan makes neither.
    """
    keys = ["s", "p", "o_lang"]
    open_ = corrections.join(decisions.select("correction").distinct(), "correction", "left_anti")
    replaced = open_.join(proposal.select(*keys).distinct(), keys, "left_semi").select(
        "correction", F.lit("rejected").alias("outcome"), F.lit("system").alias("decider"), F.lit(at).alias("generated_at")
    )
    return corrections.unionByName(proposal), decisions.unionByName(replaced)


def decision_faults(decisions: DataFrame, proposals: DataFrame, key: str = "correction") -> DataFrame:
    """Decisions by the proposer, and outcomes other than approved and rejected."""
    both = decisions.join(proposals.select(key, "proposer"), key)
    fault = F.when(F.col("decider") == F.col("proposer"), "self-approval").when(~F.col("outcome").isin("approved", "rejected"), "unknown outcome")
    return both.withColumn("fault", fault).where("fault IS NOT NULL")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that came and went between two sets of rows."""
    columns = before.columns
    added = after.join(before, columns, "left_anti").distinct().withColumn("change", F.lit("added"))
    removed = before.join(after, columns, "left_anti").distinct().withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def overlay(raw: DataFrame, approved: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Raw rows with the approved value in place of their own."""
    new = approved.select(*keys, F.col(value).alias("corrected"))
    return raw.join(new, keys, "left").withColumn(value, F.coalesce("corrected", value)).withColumn("is_corrected", F.col("corrected").isNotNull()).drop("corrected")


def stale(corrections: DataFrame, run: DataFrame, keys: list[str], prior: str, value: str) -> DataFrame:
    """Corrections whose prior value the new run doesn't hold any more."""
    now = run.select(*keys, F.col(value).alias(prior)).distinct()
    return corrections.join(now, [*keys, prior], "left_anti")


def run_index(run_id: str, created_at: str, sources: DataFrame) -> DataFrame:
    """Index row of a run: its id, time, and the sha256 of each source's content, by path."""
    digests = F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.sha2("content", 256)))))
    return sources.agg(digests.alias("sources")).select(F.lit(run_id).alias("run_id"), F.lit(created_at).alias("created_at"), "sources")


def list_runs(index: DataFrame) -> DataFrame:
    """Distinct runs by time, compared as text."""
    return index.select("run_id", "created_at").distinct().orderBy("created_at", "run_id")


def with_provenance(triples: DataFrame, provenance: DataFrame) -> DataFrame:
    """Triples with the record kept for them, NULL where untracked; of several the smallest."""
    one = provenance.groupBy(*TRIPLE).agg(F.min("source").alias("source"))
    return triples.join(one, TRIPLE, "left")


def facts_at(provenance: DataFrame, key: str, value: str) -> DataFrame:
    """Facts whose source holds exactly ``key=value`` as a whole part of its locator."""
    parts = F.split(F.regexp_replace("source", r"^[^#?]*[#?]", ""), "&")
    return provenance.where(F.array_contains(parts, f"{key}={value}"))


def global_constructs(provenance: DataFrame, uri: str = "s") -> DataFrame:
    """Rows whose IRI has a fragment without a dot."""
    fragment = F.substring_index(uri, "#", -1)
    return provenance.where((F.instr(uri, "#") > 0) & (F.instr(fragment, ".") == 0))


def union_hash(parts: DataFrame, key: str, digest: str, *order: str) -> DataFrame:
    """Hash of a reference's parts in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(digest).alias("_d"))))
    return parts.groupBy(key).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["_d"]), "|"), 256).alias("union_hash"))


def placed_leaves(parts: DataFrame, roots: DataFrame, depth: int = 1000) -> DataFrame:
    """(root, position, leaf) of nested references given as (ref_id, part_ref_id) and, if parts have an order, place.

    Parts are followed until none are unions; leaves of a root are numbered from 0 as they stand
    in it. A cycle is an error, as is nesting deeper than ``depth``.
    """
    place = F.col("place") if "place" in parts.columns else F.lit(0)
    edges = parts.select(F.col("ref_id").alias("at"), place.alias("place"), F.col("part_ref_id").alias("to"))
    found = follow(roots.select(F.col("ref_id").alias("root"), F.col("ref_id").alias("at")), edges, depth)
    circle = found.where("state = 'cycle'").select("root", "at").head()
    if circle is not None:
        raise ValueError(f"the reference {circle.root} leads in a circle at {circle['at']}")
    order = Window.partitionBy("root").orderBy("places", "at")
    return found.select("root", (F.row_number().over(order) - 1).alias("position"), F.col("at").alias("leaf"))


def leaves(parts: DataFrame, roots: DataFrame, depth: int = 1000) -> DataFrame:
    """(root, leaf) of nested references, see :func:`placed_leaves`."""
    return placed_leaves(parts, roots, depth).select("root", "leaf")


def check_references(parts: DataFrame, roots: DataFrame, checked: DataFrame, depth: int = 1000) -> DataFrame:
    """(root, position, leaf, changed, current_status): the check of every leaf of nested references, in their order.

    ``checked`` has leaf, changed, current_status of the leaves that are known; others are NOT_FOUND, and so changed.
    """
    status = F.coalesce("current_status", F.lit("NOT_FOUND"))
    return placed_leaves(parts, roots, depth).join(checked.select("leaf", "changed", "current_status"), "leaf", "left").select(
        "root", "position", "leaf", F.coalesce("changed", F.lit(True)).alias("changed"), status.alias("current_status")
    )


def fold_references(parts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(ref_id, document, digest) of all references: their JSON and content hash, from the leaves up.

    ``parts`` has ref_id, place, part_ref_id; ``leaves`` ref_id, document (JSON text), digest. A
    union is ``{"parts":[...]}`` of its parts in order, and its digest the sha256 of theirs, joined
    by bars. A round folds every reference whose parts are all known; as many rounds follow as
    references nest, each written to the shared folder. A part that is never known, or a
    circle, is an error.
    """
    spark = parts.sparkSession
    folder = f"{shared_folder(spark)}/fold-{uuid4()}"
    columns = "ref_id string, document string, digest string"
    leaves.select("ref_id", "document", "digest").write.parquet(folder)
    waiting = cut(parts.select("ref_id", "place", "part_ref_id"))
    while not waiting.isEmpty():
        done = spark.read.schema(columns).parquet(folder).withColumnRenamed("ref_id", "part_ref_id")
        row = F.struct("place", "part_ref_id", "document", "digest")
        whole = waiting.join(done, "part_ref_id", "left").groupBy("ref_id").agg(F.count("*").alias("n"), F.count("document").alias("known"), F.array_sort(F.collect_list(row)).alias("rows"))
        listed = lambda k: F.transform("rows", lambda r: r[k])
        document = F.concat(F.lit('{"parts":['), F.array_join(listed("document"), ","), F.lit("]}"))
        new = cut(whole.where("n = known").select("ref_id", document.alias("document"), F.sha2(F.array_join(listed("digest"), "|"), 256).alias("digest")))
        if new.isEmpty():
            raise ValueError(f"{waiting.first().ref_id} has parts that are unknown or lead in a circle")
        new.write.mode("append").parquet(folder)
        waiting = cut(waiting.join(new, "ref_id", "left_anti"))
    return spark.read.schema(columns).parquet(folder)


def audit_json(tables: dict[str, Column]) -> Column:
    """One JSON document of named columns, as a run's audit keeps them."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in tables.items()]))


def record_reviews(revisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Append one revision for each review document, which is cited whole.

    ``reviews`` has fact_key, review_id, reviewer, created_at, document (JSON text); ids and
    times are the caller's. The revision refers to the document by the hash of its text.
    """
    cited = reviews.select(
        "fact_key",
        F.col("review_id").alias("revision_id"),
        F.concat(F.lit("sha256:"), F.sha2("document", 256)).alias("reference"),
        F.col("reviewer").alias("author"),
        F.lit("review").alias("comment"),
        F.lit(False).alias("is_correction"),
        "created_at",
    )
    return revisions.unionByName(cited)


def add_citations(revisions: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append a revision for every candidate that resolves, and return the others with their status.

    ``resolved`` has the columns of ``revisions`` but reference, and status, current_hash; a
    family that the snapshot lacks is among the rejected as NOT_FOUND.
    """
    good = resolved.where("status = 'RESOLVED'").withColumn("reference", F.col("current_hash")).select(*revisions.columns)
    return revisions.unionByName(good), resolved.where("status <> 'RESOLVED'")
