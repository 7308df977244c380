"""Line dedup: drop lines that several documents hold, keep them in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Drop every line whose key at least ``min_docs`` documents hold, save in the last of them.

    A document's lines are what ``\\n`` separates; keys shorter than ``min_chars`` code points
    never count. Of the documents that hold a frequent key the one with the largest id keeps
    all its lines with that key. The result has the columns of ``docs`` with the new text, and
    ``n_lines`` (before), ``n_dropped``; columns of these names in ``docs`` are replaced.

    A NULL or empty text is one empty line and becomes ''. Rows that share an id are one
    document for the count, and each loses its own lines. A row without an id takes no part
    and keeps its lines. An empty table gives an empty result.

    Lines travel as 16-byte hashes. The count groups by (hash, id) before it groups by hash,
    so that a line of a third of all documents reaches its last task as one row per task. The
    frequent hashes are cut to the shared folder, so both sides of the join back to the lines
    come from a shuffle of their own and adaptive execution can split such a key. Positions,
    not texts, go back to the documents.
    """
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("rid"),
        F.split(text, "\n", -1).alias("lines"),
    )
    lines = (
        base.select("id", "rid", F.posexplode("lines").alias("pos", "line"))
        .where(F.col("id").isNotNull())
        .select("id", "rid", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "rid", "pos", F.unhex(F.md5("key")).alias("h"))
    )
    frequent = cut(
        lines.groupBy("h")
        .agg(F.countDistinct("id").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("h", "last")
    )
    drops = (
        lines.join(frequent, "h")
        .where(F.col("id") < F.col("last"))
        .groupBy("id", "rid")
        .agg(F.collect_set("pos").alias("drop"))
    )
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.transform(kept_at, lambda i: F.get("lines", i))
    )
    new_text = F.array_join(kept, "\n").alias(text_col)
    return base.join(drops, ["id", "rid"], "left").select(
        *[new_text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c == text_col or c in others],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
