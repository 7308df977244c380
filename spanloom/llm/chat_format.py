"""Preference formatting: one shared prompt and two masked completions per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """Render preference pairs turn by turn.

    ``turns`` has pair_id, side ('chosen' or 'rejected'), turn, role, text; other columns are
    ignored. The prompt is the longest prefix of turns that both sides hold with equal role
    and text; it is rendered once. Every later turn of either side is a part of that side's
    completion; ``loss`` is 1 on the assistant's turns there and 0 on all else, header and
    end mark included in ``rendered`` and excluded from the loss by ``body_start`` and
    ``body_end`` (code points in ``rendered``).

    Result: pair_id, part ('prompt', 'chosen', 'rejected'), turn, role, rendered, body_start,
    body_end, loss; a part's text is its ``rendered`` in the order of ``turn``.

    NULL text is '', NULL role is 'user'. Rows without pair_id, turn or a known side take no
    part. Of several rows for one turn of one side the smallest (role, text) counts. A side
    that is missing leaves the prompt empty. Identical sides are all prompt.

    One row per turn goes through the plan; no conversation is gathered in one place. The
    first difference is a minimum with partial aggregation, so a pair of any length is fine.
    """
    clean = turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()).select(
        "pair_id",
        "turn",
        "side",
        F.struct(
            F.coalesce(F.col("role"), F.lit("user")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    both = (
        clean.where(F.col("side").isin("chosen", "rejected"))
        .groupBy("pair_id", "turn")
        .agg(
            F.min(F.when(F.col("side") == "chosen", F.col("said"))).alias("chosen"),
            F.min(F.when(F.col("side") == "rejected", F.col("said"))).alias("rejected"),
        )
    )
    same = F.col("chosen").eqNullSafe(F.col("rejected"))
    fork = both.where(~same).groupBy("pair_id").agg(F.min("turn").alias("fork"))
    placed = both.join(fork, "pair_id", "left")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))

    def part(name: str, said: str) -> Column:
        return F.struct(F.lit(name).alias("part"), F.col(said).alias("said"))

    parts = F.when(shared, F.array(part("prompt", "chosen"))).otherwise(
        F.array(part("chosen", "chosen"), part("rejected", "rejected"))
    )
    role, text = F.col("p.said.role"), F.col("p.said.text")
    start = F.char_length(role) + 5
    return (
        placed.select("pair_id", "turn", F.explode(parts).alias("p"))
        .where(F.col("p.said").isNotNull())
        .select(
            "pair_id",
            F.col("p.part").alias("part"),
            "turn",
            role.alias("role"),
            render(role, text).alias("rendered"),
            start.alias("body_start"),
            (start + F.char_length(text)).alias("body_end"),
            F.when((F.col("p.part") != "prompt") & (role == "assistant"), 1).otherwise(0).alias("loss"),
        )
    )


def pair_records(parts: DataFrame) -> DataFrame:
    """A training record of each pair from the turns of :func:`format_preferences`.

    Result: pair_id, prompt, chosen, rejected (texts), chosen_spans and rejected_spans: the
    (begin, end) code points of a completion that the loss counts, in order. A side without
    turns is an empty text without spans. A record holds its pair's turns, as the texts do.
    """
    turn = F.struct("turn", "rendered", "body_start", "body_end", "loss")

    def text(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: t["rendered"]), "")

    def spans(turns: Column) -> Column:
        def add(done: Column, t: Column) -> Column:
            span = F.struct((done["at"] + t["body_start"]).alias("begin"), (done["at"] + t["body_end"]).alias("end"))
            found = F.when(t["loss"] == 1, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
            return F.struct((done["at"] + F.char_length(t["rendered"])).alias("at"), found.alias("spans"))

        start = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<begin:int,end:int>>").alias("spans"))
        return F.aggregate(turns, start, add, lambda done: done["spans"])

    sides = {name: F.array_sort(F.collect_list(F.when(F.col("part") == name, turn))).alias(name) for name in ("prompt", "chosen", "rejected")}
    return parts.groupBy("pair_id").agg(*sides.values()).select(
        "pair_id",
        *(text(F.col(name)).alias(name) for name in sides),
        *(spans(F.col(name)).alias(f"{name}_spans") for name in ("chosen", "rejected")),
    )
