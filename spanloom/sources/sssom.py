"""Mapping files: tab-separated rows under a commented header, with physical line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SssomParseError
from ..functions.terms import expand_curie, python_float, split_lines
from ..model import NAMESPACES

#: Prefixes that every file has, and the columns that every row needs.
BUILT_IN = {p: NAMESPACES[p] for p in ("owl", "rdf", "rdfs", "semapv", "skos")} | {"sssom": "https://w3id.org/sssom/"}
REQUIRED = ("subject_id", "predicate_id", "object_id", "mapping_justification")
OPTIONAL = ("subject_label", "object_label", "author_id")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(src_path, line_num from 1, line) of whole files; an empty file has one NULL line."""
    files = spark.read.format("binaryFile").load(path)
    text = files.select(F.col("path").alias("src_path"), F.decode("content", "UTF-8").alias("value"))
    return text.select("src_path", F.posexplode_outer(split_lines(F.col("value"))).alias("pos", "line")).select(
        "src_path", (F.coalesce("pos", F.lit(0)) + 1).alias("line_num"), "line"
    )


def header_lines(lines: DataFrame) -> DataFrame:
    """Comment lines with whether they stand in the curie_map block.

    The block opens at a line that reads exactly ``#curie_map:`` and closes at the first
    header line that doesn't start with ``#`` and two blanks.
    """
    body = F.substr("line", F.lit(2))
    opens, entry = body == "curie_map:", body.startswith("  ")
    mark = F.when(opens, F.lit(True)).when(~entry, F.lit(False))
    order = Window.partitionBy("src_path").orderBy("line_num")
    return (
        lines.where(F.col("line").startswith("#"))
        .select("src_path", "line_num", "line", body.alias("body"), opens.alias("opens"), F.last(mark, ignorenulls=True).over(order).alias("inside"))
        .withColumn("is_prefix", F.coalesce("inside", F.lit(False)) & ~F.col("opens"))
    )


def prefix_faults(lines: DataFrame) -> DataFrame:
    entries = _prefix_entries(lines)
    again = Window.partitionBy("src_path", "prefix").orderBy("line_num")
    fault = (
        F.when(F.instr("entry", ":") == 0, F.lit("curie_map entry has no colon"))
        .when(F.col("iri") == "", F.lit("curie_map entry has no IRI"))
        .when(F.row_number().over(again) > 1, F.lit("curie_map prefix is declared twice"))
    )
    return entries.select("src_path", "line_num", "line", fault.alias("fault"))


def _prefix_entries(lines: DataFrame) -> DataFrame:
    entry = F.btrim("body")
    at = F.instr(entry, ":")
    return header_lines(lines).where("is_prefix").select(
        "src_path",
        "line_num",
        "line",
        entry.alias("entry"),
        F.btrim(F.substring_index(entry, ":", 1)).alias("prefix"),
        F.btrim(F.when(at > 0, F.substr(entry, at + 1)).otherwise("")).alias("iri"),
    )


def header(lines: DataFrame) -> DataFrame:
    """(src_path, metadata map): the last value of each key outside the curie_map block."""
    at = F.instr("body", ":")
    pairs = header_lines(lines).where((~F.col("is_prefix")) & ~F.col("opens") & (at > 0)).select(
        "src_path", "line_num", F.btrim(F.substring_index("body", ":", 1)).alias("k"), F.btrim(F.substr("body", at + 1)).alias("v")
    )
    last = pairs.groupBy("src_path", "k").agg(F.max_by("v", "line_num").alias("v"))
    return last.groupBy("src_path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))


def parse_mappings(lines: DataFrame) -> DataFrame:
    """Mapping rows with a ``fault`` column: NULL on good rows, else what is wrong with the line."""
    files = lines.select("src_path").distinct()
    data = lines.where(~F.col("line").startswith("#"))
    first = data.groupBy("src_path").agg(F.min_by("line", "line_num").alias("columns"), F.min("line_num").alias("at"))
    builtin = F.create_map(*[F.lit(x) for pair in BUILT_IN.items() for x in pair])
    own = (
        _prefix_entries(lines)
        .groupBy("src_path", "prefix")
        .agg(F.min_by("iri", "line_num").alias("iri"))
        .where(~F.col("prefix").isin(*BUILT_IN))
        .groupBy("src_path")
        .agg(F.map_from_entries(F.collect_list(F.struct("prefix", "iri"))).alias("own"))
    )
    known = F.when(F.col("own").isNull(), builtin).otherwise(F.map_concat(builtin, F.col("own")))
    fields, columns = F.split("line", "\t", -1), F.split("columns", "\t", -1)
    wide = F.size(fields) == F.size(columns)
    rows = (
        data.join(first, "src_path")
        .join(own, "src_path", "left")
        .where((F.col("line_num") > F.col("at")) & (F.btrim("line") != ""))
        .select("src_path", "line_num", "line", known.alias("known"), F.when(wide, F.map_from_arrays(columns, fields)).alias("row"))
    )

    def cell(name: str) -> Column:
        return F.try_element_at("row", F.lit(name))

    def blank(name: str) -> Column:
        return F.nullif(cell(name), F.lit(""))

    confidence = python_float(cell("confidence"))
    bad_number = (F.btrim(F.coalesce(cell("confidence"), F.lit(""))) != "") & confidence.isNull()
    fault = F.when(F.col("row").isNull(), F.lit("wrong number of columns"))
    for name in REQUIRED:
        fault = fault.when(F.coalesce(cell(name), F.lit("")) == "", F.lit(f"required column {name} is missing or empty"))
    for name in REQUIRED:
        unknown = F.concat(
            F.lit(f"unknown prefix in {name} "), cell(name), F.lit("; built in are " + ", ".join(sorted(BUILT_IN)))
        )
        fault = fault.when(expand_curie(cell(name), F.col("known")).isNull(), unknown)
    fault = fault.when(bad_number, F.concat(F.lit("confidence is no number: "), cell("confidence")))
    good = rows.select(
        *[expand_curie(cell(n), F.col("known")).alias(n) for n in REQUIRED],
        *[blank(n).alias(n) for n in OPTIONAL],
        confidence.alias("confidence"),
        "src_path",
        "line_num",
        "line",
        fault.alias("fault"),
    )
    no_body = files.join(first, "src_path", "left")
    header_fault = (
        F.when(F.col("columns").isNull(), F.lit("the file has no column header"))
        .when(~F.array_contains(columns, "subject_id"), F.lit("the column header has no subject_id"))
    )
    empty = [F.lit(None).cast("string").alias(n) for n in (*REQUIRED, *OPTIONAL)] + [F.lit(None).cast("double").alias("confidence")]
    heads = no_body.select(*empty, "src_path", F.coalesce("at", F.lit(1)).alias("line_num"), F.col("columns").alias("line"), header_fault.alias("fault"))
    maps = prefix_faults(lines).select(*empty, "src_path", "line_num", "line", "fault")
    return good.unionByName(heads.where("fault IS NOT NULL")).unionByName(maps.where("fault IS NOT NULL"))


def load_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Mappings of the files under ``path``; the first bad line, top to bottom, is raised."""
    lines = read_lines(spark, path)
    if lines.isEmpty():
        raise SssomParseError(path, "the file has no column header")
    parsed = parse_mappings(lines)
    worst = parsed.where("fault IS NOT NULL").orderBy("src_path", "line_num").limit(1).collect()
    if worst:
        raise SssomParseError(worst[0].src_path, worst[0].fault, worst[0].line_num, worst[0].line)
    return parsed.where("fault IS NULL").drop("line", "fault")


def load_header(spark: SparkSession, path: str) -> dict[str, str]:
    rows = header(read_lines(spark, path)).collect()
    return rows[0].metadata if rows else {}
