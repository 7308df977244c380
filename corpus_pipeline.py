"""From raw documents to packed training sequences.

Five stages, each by one operator of ``spanloom.llm`` over all that the stage before kept:

1. ``language``: texts in which no language can be recognised go (NULL, or without a letter).
2. ``lines``: lines that three or more documents hold stay in the last of them only.
3. ``near_duplicates``: of each group that 5-word shingles link at a Jaccard similarity of 0.8
   or more, the document with the smallest id stays.
4. ``benchmark``: documents that hold a benchmark item, or nearly one, go.
5. ``pack``: what is left becomes sequences of at most 2048 tokens.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import language
from spanloom.llm.common import cut, fold, shared_folder, small, table
from spanloom.llm.decontaminate import find_leaks
from spanloom.llm.jaccard import jaccard_components
from spanloom.llm.line_dedup import line_dedup
from spanloom.llm.packing import pack


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns as one struct, so that no operator's own columns can clash with them."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return rows.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in columns))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; the model learns as op6 does.

    NULL texts and texts without a letter go; where no language can be learned, no other goes.
    """
    model = language.train(docs.where(fold() != 0))
    found = language.identify(packed(docs), model, carry=["row"])
    return unpacked(found.where(F.col("score") > 0), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; n_chars is counted anew. NULL texts become empty."""
    kept = line_dedup(packed(docs))
    return unpacked(kept, docs.columns, text=F.col("text"), n_chars=F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; all rows of its id stay, and rows without an id."""
    groups = jaccard_components(docs, words=5, percent=80)
    losers = cut(groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct())
    return docs.join(small(losers), "doc_id", "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; NULL texts and rows without an id stay."""
    leaks = cut(find_leaks(docs, table(spark, sf_dir, "benchmark"), words=5, least=0.8).select("doc_id").distinct())
    return docs.join(small(leaks), "doc_id", "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences; a NULL text is its end alone."""
    return pack(docs, capacity=2048)


STAGES = [
    ("language", keep_languages),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_leaks),
    ("pack", pack_sequences),
]

#: Language ID and packing have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    The files go once the last stage has read them; it works on from its own checkpoint.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4()}"
    for number, (name, stage) in enumerate(STAGES[:-1]):
        place = f"{folder}/{number}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    sequences = STAGES[-1][1](spark, docs, sf_dir)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return sequences
