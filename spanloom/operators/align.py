"""Alignment of citations with a vocabulary: referential integrity of mappings, and their triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptyVocabularyError, UnresolvedObjectError, UnresolvedSubjectError
from ..model import iri
from ..sources.sssom import load_mappings

TYPE = iri("rdf:type")
VOCABULARY_TYPES = (iri("owl:Class"), iri("owl:NamedIndividual"))


def unresolved_subjects(mappings: DataFrame, graph: DataFrame) -> DataFrame:
    """Mappings whose subject is no property shape of the graph."""
    shapes = graph.where((F.col("p") == TYPE) & (F.col("o") == iri("sh:PropertyShape"))).select(F.col("s").alias("subject_id")).distinct()
    return mappings.join(shapes, "subject_id", "left_anti")


def vocabulary_terms(graph: DataFrame) -> DataFrame:
    return graph.where((F.col("p") == TYPE) & F.col("o").isin(*VOCABULARY_TYPES)).select(F.col("s").alias("object_id")).distinct()


def unresolved_objects(mappings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Mappings whose object is neither class nor individual: one anti join over both kinds."""
    return mappings.join(vocabulary_terms(vocabulary), "object_id", "left_anti")


def all_failures(bad: DataFrame, message: Column, *order: str) -> DataFrame:
    """One row with every failure's message, joined by ``; `` in input order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, message.alias("m"))))
    return bad.agg(F.array_join(F.transform(listed, lambda x: x["m"]), "; ").alias("message"))


def validate_mappings(mappings: DataFrame, graph: DataFrame, vocabulary: DataFrame) -> None:
    """Subjects, then whether the vocabulary holds anything, then objects; each failure lists all its mappings."""

    def refuse(bad: DataFrame, column: str, kind: type[Exception]) -> None:
        text = F.concat(F.col("src_path"), F.lit(":"), F.col("line_num").cast("string"), F.lit(": "), F.col(column))
        message = all_failures(bad, text, "src_path", "line_num").first()[0]
        if message:
            raise kind(message)

    refuse(unresolved_subjects(mappings, graph), "subject_id", UnresolvedSubjectError)
    if vocabulary_terms(vocabulary).isEmpty():
        raise EmptyVocabularyError("the vocabulary holds neither classes nor individuals")
    refuse(unresolved_objects(mappings, vocabulary), "object_id", UnresolvedObjectError)


def load_and_validate(spark: SparkSession, path: str, graph: DataFrame, vocabulary: DataFrame) -> DataFrame:
    mappings = load_mappings(spark, path)
    validate_mappings(mappings, graph, vocabulary)
    return mappings


def mapping_triples(mappings: DataFrame, graph: str = "") -> DataFrame:
    """One plain triple for each mapping; equal ones are one."""
    none = F.lit("")
    return mappings.select(
        F.lit(graph).alias("graph"), F.col("subject_id").alias("s"), F.lit("iri").alias("s_kind"), F.col("predicate_id").alias("p"),
        F.col("object_id").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"),
    ).distinct()
