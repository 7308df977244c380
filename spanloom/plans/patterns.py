"""Graph patterns over triples as DataFrame plans.

A pattern is (subject, predicate, object); a term that starts with ``?`` is a variable, any
other a constant (prefixed names are expanded). Text queries are not parsed here: a query is
a function from the triples to a DataFrame, written with these helpers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import bnode
from ..model import NAMESPACES, iri
from .lineage import cut

Pattern = tuple[str, str, str]


def term(text: str) -> str:
    prefix = text.partition(":")[0]
    if text == "a":
        return iri("rdf:type")
    return iri(text) if prefix in NAMESPACES else text


def _bound(pattern: Pattern) -> int:
    return sum(not t.startswith("?") for t in pattern)


def one(triples: DataFrame, pattern: Pattern, graph: str | None = None) -> DataFrame:
    """Solutions of a single pattern; constants become filters that reach the scan."""
    rows = triples if graph is None else triples.where(F.col("graph") == graph)
    names: dict[str, str] = {}
    for column, t in zip("spo", pattern):
        if not t.startswith("?"):
            rows = rows.where(F.col(column) == term(t))
        elif t in names:
            rows = rows.where(F.col(column) == F.col(names[t]))
        else:
            names[t] = column
    return rows.select(*[F.col(c).alias(t[1:]) for t, c in names.items()])


def match(triples: DataFrame, patterns: list[Pattern], graph: str | None = None) -> DataFrame:
    """Solutions of all patterns together: equi-joins on the variables they share.

    The most bound pattern comes first, and then always one that shares a variable with what
    is there, so that no step is a product while the pattern is connected. Joins are sort-merge joins:
    a pattern's size is only estimated, from compressed files before they are unfolded to
    triples, and a side broadcast on that estimate would pass through the driver whole.
    """
    rest = sorted(patterns, key=lambda p: -_bound(p))
    plan = one(triples, rest.pop(0), graph)
    while rest:
        linked = next((p for p in rest if any(t[1:] in plan.columns for t in p if t.startswith("?"))), None)
        if linked is None:
            raise ValueError("patterns share no variable")
        rest.remove(linked)
        found = one(triples, linked, graph)
        plan = plan.join(found.hint("merge"), [c for c in found.columns if c in plan.columns])
    return plan




def match_star(citations: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The same solutions from the wide table: a star needs no join.

    ``wanted`` maps result columns to the star's parts: shape, path, annotation, target,
    selector, or a column of the citation.
    """
    shape = F.col("property_shape_iri")
    parts = {
        "shape": shape,
        "path": F.concat(shape, F.lit("/path")),
        "annotation": F.concat(shape, F.lit("/annotation")),
        "target": bnode(shape, "target"),
        "selector": bnode(shape, "selector"),
    }
    return citations.select(*[parts.get(part, F.col(part)).alias(name) for name, part in wanted.items()])


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in b.columns if c in a.columns]


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solutions without a compatible one on the right; without shared variables nothing is taken away."""
    shared = _shared(left, right)
    return left.join(right, shared, "left_anti") if shared else left


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _shared(left, right), "left_anti")


def bind(rows: DataFrame, name: str, expression: str) -> DataFrame:
    """A computed variable; use ``try_`` functions, so that an error leaves it unbound."""
    return rows.withColumn(name, F.expr(expression))


def values(rows: DataFrame, column: str, allowed: list) -> DataFrame:
    return rows.where(F.col(column).isin(*allowed))


def path_closure(triples: DataFrame, predicate: str, depth: int = 64) -> DataFrame:
    """(start, end) over one or more steps of a predicate, doubling the path length each round; rounds are cut."""
    step = triples.where(F.col("p") == term(predicate)).select(F.col("s").alias("start"), F.col("o").alias("end")).distinct()
    reached, n = step, step.count()
    for _ in range(depth):
        longer = reached.join(reached.withColumnRenamed("start", "mid").withColumnRenamed("end", "far"), F.col("end") == F.col("mid"))
        reached = reached.union(longer.select("start", F.col("far").alias("end"))).distinct()
        reached = cut(reached)
        more = reached.count()
        if more == n:
            break
        n = more
    return reached


def path_star(triples: DataFrame, predicate: str) -> DataFrame:
    """(start, end) over zero or more steps."""
    ends = triples.where(F.col("p") == term(predicate))
    nodes = ends.select(F.col("s").alias("n")).union(ends.select(F.col("o").alias("n"))).distinct()
    return path_closure(triples, predicate).union(nodes.select(F.col("n").alias("start"), F.col("n").alias("end"))).distinct()


# Property paths: every path is a DataFrame (start, end) with a row for each way of getting there.


def step(triples: DataFrame, predicate: str, graph: str | None = None) -> DataFrame:
    return one(triples, ("?start", predicate, "?end"), graph)


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("end").alias("start"), F.col("start").alias("end"))


def sequence(path: DataFrame, *more: DataFrame) -> DataFrame:
    """One path after the other: a join where one ends and the next starts."""
    for following in more:
        path = path.withColumnRenamed("end", "_at").join(following.withColumnRenamed("start", "_at"), "_at").select("start", "end")
    return path


def alternative(*paths: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, paths)


def zero_or_one(triples: DataFrame, path: DataFrame) -> DataFrame:
    """A path or none: every node of the triples ends at itself too; each pair once."""
    nodes = triples.select(F.col("s").alias("start")).union(triples.select(F.col("o").alias("start"))).distinct()
    return path.union(nodes.select("start", F.col("start").alias("end"))).distinct()
