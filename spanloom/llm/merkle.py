"""Merkle manifests of a table: one tree for each group of rows, one tree over the groups, a proof for each row."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Children of a node, and levels of a superblock, which has FAN ** LEVELS nodes at its bottom.
FAN, LEVELS = 16, 3


def row_digest(fields: Sequence[Column]) -> Column:
    """sha256 (lower hex) of a row: each field as UTF-8 byte count, ``:`` and value; ``-`` if NULL."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown)), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position``: their place (from 0) by id, then digest, among those of their group ``g``.

    Rows are dealt by ranges of (g, id, digest), so that a large group lies in many tasks; a
    position is a row's place in its range, and what smaller ranges hold of the group. The
    table of these counts has a row for each group in each range.
    """
    order = ["g", "id", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    held = dealt.groupBy("g", "part").agg(F.min("at").alias("begin"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift"))
    return dealt.join(held, ["g", "part"]).withColumn("position", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("position", 4 * depth))


def levels_of(digests: list[str], block: int, depth: int) -> list[list[str]]:
    """The nodes of a superblock, level by level. A group that fits in one block ends with one node."""
    levels = [digests]
    whole = block > 0 or len(digests) == FAN**depth
    while len(levels) <= depth if whole else len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i : i + FAN])) for i in range(0, len(low), FAN)])
    return levels


def climb(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The tops (g, position, digest) of all superblocks, those of the superblocks of these, until each group has one."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows.block.iloc[0])
        levels = levels_of(rows.sort_values("position").digest.tolist(), block, depth)
        return pd.DataFrame({"g": [rows.g.iloc[0]], "position": [block], "digest": levels[-1]})

    rounds: list[DataFrame] = []
    while True:
        own = blocks(nodes, depth).select("g", "block", "position", "digest")
        nodes = cut(own.groupBy("g", "block").applyInPandas(top, "g string, position long, digest string"))
        rounds.append(nodes)
        if not nodes.agg(F.max("position")).first()[0]:
            return rounds


def siblings(levels: list[list[str]]) -> list[tuple[list[str], list[str]]]:
    """For each node at the bottom what stands left and right of it in its run, on every level below the top."""
    found = [([], []) for _ in levels[0]]
    for depth, level in enumerate(levels[:-1]):
        step = FAN**depth
        sides = []
        for i in range(len(level)):
            run = level[i - i % FAN : i - i % FAN + FAN]
            sides.append(("".join(run[: i % FAN]), "".join(run[i % FAN + 1 :])))
        for at, (left, right) in enumerate(found):
            a, b = sides[at // step]
            left.append(a)
            right.append(b)
    return found


_OUTER = "lefts array<string>, rights array<string>, subroot string, root string"


def exchange(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """Nodes with their proofs up to the root: nodes and the path of their superblock's top meet by superblock.

    ``outer`` has a row (g, position, lefts, rights, subroot, root) for each superblock. If
    nodes have ``id`` and ``claimed`` (a digest; NULL: the node's own), the claimed digest is
    folded with the proof in the same place.
    """
    ends = "claimed" in nodes.columns
    id_type = nodes.schema["id"].dataType.simpleString() if ends else ""

    def work(_: tuple, rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        above = path.iloc[0]
        own = siblings(levels_of(rows.digest.tolist(), int(above.position), depth))
        lefts = [[*a, *above.lefts] for a, _ in own]
        rights = [[*b, *above.rights] for _, b in own]
        made = {"g": rows.g, "position": rows.position, "digest": rows.digest, "lefts": lefts, "rights": rights, "subroot": above.subroot, "root": above.root}
        if ends:
            folded = []
            for node, claimed, left, right in zip(rows.digest, rows.claimed, lefts, rights):
                now = node if claimed is None else claimed
                for a, b in zip(left, right):
                    now = digest(a + now + b)
                folded.append(now)
            made |= {"id": rows.id, "folded_root": folded}
        return pd.DataFrame(made)

    schema = f"g string, position long, digest string, {_OUTER}" + (f", id {id_type}, folded_root string" if ends else "")
    above = outer.select("g", F.col("position").alias("block"), "position", "lefts", "rights", "subroot", "root")
    return blocks(nodes, depth).groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInPandas(work, schema)


def proved(nodes: DataFrame, rounds: list[DataFrame], outer: DataFrame, depth: int) -> DataFrame:
    """Proofs for ``nodes`` from the paths of their groups' tops (``outer``), down the rounds of :func:`climb`."""
    for tops in reversed(rounds[:-1]):
        outer = cut(exchange(tops, outer, depth))
    return exchange(nodes, outer, depth)


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[Column],
    group: Column,
    id_col: str = "doc_id",
    claimed: Column | None = None,
    depth: int = LEVELS,
) -> DataFrame:
    """A Merkle manifest of a table's rows, with a proof for each row.

    A leaf is the row digest of ``fields``. In each group leaves ascend by id, then digest;
    while a level has several nodes, every FAN consecutive ones (the last run fewer, even one)
    become the sha256 of their hex digests. What remains is the group's subroot. Subroots,
    ordered by group (NULL first, then by UTF-8 bytes), likewise give the root.

    Result: doc_id, group, position (in the group), leaf, subroot, root, lefts and rights (the proof:
    for every level from the leaf to the root, the hex digests left and right of the node in
    its run), folded_root (``claimed``, a digest, folded with the proof; the leaf itself where
    it is NULL), verified (folded_root is the root).

    Rows that are equal in all fields have equal leaves and a place each; a NULL id comes
    first; a NULL group is a group; NULL and empty fields differ. An empty table gives an
    empty result. Other columns are ignored, whatever their names. Texts are hashed where
    they are read, by built-in functions; only digests are shuffled. A task holds one
    superblock of FAN ** depth nodes and the path of its top.
    """
    leaf = row_digest(fields)
    key = F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))
    claim = F.lit(None).cast("string") if claimed is None else F.when(claimed != leaf, claimed)
    leaves = numbered(docs.select(key.alias("g"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"), claim.alias("claimed")))
    rounds = climb(leaves, depth)
    groups = cut(numbered(rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("id"), "digest")))
    upper = climb(groups, depth)
    none = F.array().cast("array<string>")
    top = upper[-1].select("g", "position", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = proved(groups.withColumn("claimed", F.lit(None).cast("string")), upper, top, depth)
    outer = cut(paths.select(F.col("id").alias("g"), F.lit(0).cast("long").alias("position"), "lefts", "rights", F.col("digest").alias("subroot"), "root"))
    return proved(leaves, rounds, outer, depth).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("g") != "n", F.substring("g", 2, 1 << 30)).alias("group"),
        "position",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "lefts",
        "rights",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def proof_text(lefts: Column, rights: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), "")
