"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from ..plans.lineage import cut, shared_folder

__all__ = ["ascii_lower", "cut", "fold", "map_texts", "shared_folder", "slices", "small", "table", "tidy", "tidy_group", "with_texts"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space of the word and line rules: blank, tab, LF, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, megabytes: int = 32) -> DataFrame:
    """``df`` with a broadcast hint if its values take so many megabytes at most, else as it is.

    For tables that have been cut: all values are measured, lists and texts by their lengths.
    Beyond the bound Spark joins by shuffling.
    """

    def width(field: StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, ArrayType):
            return F.coalesce(F.size(col), F.lit(0)) * 8 + 32
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16 if isinstance(field.dataType, (StringType, BinaryType)) else F.lit(16)

    total = df.agg(F.sum(sum((width(f) for f in df.schema), F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= megabytes << 20 else df


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5; NULL for a NULL id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 5


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the quicker built-in."""
    pure = F.char_length(col) == F.octet_length(col)
    return F.when(pure, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))



#: Rows of a batch of texts between Spark and Python, at most.
BATCH_ROWS = 2000


def with_texts(df: DataFrame) -> DataFrame:
    """``df``, for a function over Arrow batches of whole texts: its session's batches get BATCH_ROWS rows at most.

    Spark counts a batch by rows alone, and its default of 10,000 texts is much for an
    executor that holds two batches of each task, in the JVM and in Python.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return None


def give_back() -> None:
    """Return memory that this Python worker has freed to the machine; workers live on from task to task and from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches, which gives memory back when it ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def tidy_group(work: Callable) -> Callable:
    """``work`` over a group's tables, which gives memory back when it ends."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return work(*tables)
        finally:
            give_back()

    # Spark counts the arguments of a function of groups
    return (lambda a: run(a)) if len(signature(work).parameters) == 1 else (lambda a, b: run(a, b))


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``size`` bytes of ``column`` each, one row at least; none of an empty batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(
    docs: DataFrame,
    work: Callable[[list[str | None]], dict[str, Sequence]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Apply ``work`` to some whole texts at a time; doc_id and ``carry`` columns pass as they are.

    ``work`` takes texts and returns a list for each column of ``schema``. ``carry`` may name
    the text column; a carried column may not have a name of ``schema`` (pass such columns in
    one struct). Other columns are ignored, whatever their names. Memory is bounded by the
    bytes of the texts, a few megabytes at a time beside the batch itself.
    """
    shown = ["doc_id", *carry]
    source = docs.select(F.col(f"`{id_col}`").alias("c0"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry, 1)), F.col(f"`{text_col}`").alias("text"))
    kept = [f"c{i}" for i in range(len(shown))]
    made_here = StructType.fromDDL(schema)
    names = made_here.names
    carried = [StructField(c, source.schema[k].dataType) for c, k in zip(shown, kept)]
    if len({*shown, *names}) < len(shown) + len(names):
        raise ValueError(f"a carried column has the name of a result column: {shown}, {names}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = work(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(_array(made[n]) for n in names)], [*shown, *names])

    return with_texts(source).mapInArrow(tidy(run), StructType([*carried, *made_here.fields]))


def _array(values: Sequence) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)
