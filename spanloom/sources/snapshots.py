"""Snapshots of a corpus, JSON catalogs, reviews and task documents as tables."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusIntegrityError, ReviewLoadError
from ..plans.lineage import cut

REVIEW = (
    "fact_key string, family string, drift_kind string, reviewed_fingerprint string, reviewer string, "
    "reviewed_at string, verdict string, reasoning string"
)
_EVIDENCE = "struct<commits:array<string>,prs:array<string>>"
TASKS = (
    "master struct<tasks:array<struct<id:string,status:string,evidence:" + _EVIDENCE + ",subtasks:array<struct<id:string,"
    "status:string,evidence:" + _EVIDENCE + ">>>>,metadata:struct<taskCount:bigint,completedCount:bigint>>"
)


def current_version(root: str) -> str | None:
    """The version that the corpus's pointer names, or None without a pointer."""
    pointer = Path(root, "_current")
    return pointer.read_text().strip() if pointer.exists() else None


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(version, family, rel_path) of the current snapshot; no rows without a pointer.

    A missing manifest, a path that leaves the snapshot, or a missing file is a
    :class:`CorpusIntegrityError`.
    """
    schema = "version string, family string, rel_path string"
    version = current_version(root)
    if version is None:
        return spark.createDataFrame([], schema)
    folder = Path(root, version)
    listing = folder / "_manifest.json"
    if not listing.exists():
        raise CorpusIntegrityError(f"snapshot {version} has no manifest")
    rows = []
    for family, relative in sorted(json.loads(listing.read_text()).items()):
        target = (folder / relative).resolve()
        if not target.is_relative_to(folder.resolve()):
            raise CorpusIntegrityError(f"{family}: {relative} leaves snapshot {version}")
        if not target.exists():
            raise CorpusIntegrityError(f"{family}: {relative} is not in snapshot {version}")
        rows.append((version, family, relative))
    return spark.createDataFrame(rows, schema)


def resolve_families(references: DataFrame, current: DataFrame) -> DataFrame:
    """References with the place of their family now; status NOT_FOUND where the snapshot lacks it."""
    placed = references.join(current, "family", "left")
    return placed.withColumn("location_status", F.when(F.col("rel_path").isNull(), "NOT_FOUND").otherwise("RESOLVED"))


def families(current: DataFrame) -> DataFrame:
    return current.select("family").distinct().orderBy("family")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(fact_key, seq, revision) of a JSON catalog: an object whose values are lists."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), "value")
    shape = F.schema_of_variant("v")
    text = text.withColumn("checked", F.when(shape.startswith("OBJECT"), F.lit(True)).otherwise(F.raise_error(F.lit("a catalog is a JSON object"))))
    pages = text.where("checked").select(F.explode(F.from_json("value", "map<string,string>")).alias("fact_key", "page"))
    listed = F.when(F.schema_of_variant(F.parse_json("page")).startswith("ARRAY"), F.from_json("page", "array<string>")).otherwise(
        F.raise_error(F.concat(F.lit("not a list: "), "fact_key"))
    )
    return pages.select("fact_key", F.posexplode(listed).alias("seq", "revision"))


def write_catalog(pages: dict[str, list], path: str) -> None:
    """Write a catalog with sorted keys: all of it or nothing."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, partial = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w") as out:
            json.dump(pages, out, sort_keys=True, indent=2, ensure_ascii=False)
        os.replace(partial, path)
    except BaseException:
        os.unlink(partial)
        raise


def read_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """All review documents of a folder; none if there is no folder; a malformed one is an error."""
    files = sorted(str(p) for p in Path(folder).glob("*.json")) if Path(folder).is_dir() else []
    if not files:
        return spark.createDataFrame([], REVIEW)
    rows = spark.read.schema(REVIEW + ", _corrupt_record string").json(files, multiLine=True, mode="PERMISSIVE")
    rows = cut(rows)
    if not rows.where("_corrupt_record IS NOT NULL OR fact_key IS NULL OR verdict IS NULL").isEmpty():
        raise ReviewLoadError(f"a review in {folder} is malformed")
    return rows.drop("_corrupt_record")


def read_task_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASKS).json(path, multiLine=True, mode="FAILFAST").withColumn("doc_uri", F.input_file_name())
