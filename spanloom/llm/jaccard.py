"""N-gram Jaccard join: sparse products of document by n-gram incidence, with size bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, small, tidy, tidy_group, with_texts
from .components import connected_components
from .hashing import factors, hashed_words, mix, shingles

#: A shingle is called frequent if tasks that met it at least LOCALLY times in about WINDOW
#: shingles met it FREQUENT times in all; the FREQUENT_KEPT most frequent are broadcast (8 bytes
#: each). Frequent shingles come last in prefixes; that saves work and changes no result.
WINDOW, LOCALLY, FREQUENT, FREQUENT_KEPT = 1 << 20, 4, 48, 500_000
#: Smallest hashes of a set by which close copies find each other first.
HEADS = 6
#: Shingles of a block of whole sets, rows of a block of prefix columns, and pairs worked on at a time, about.
CELLS = 1 << 19
#: A prefix column of more classes is cut into strips of about so many.
STRIP = 8192
#: Keys of sets that a task remembers while it counts.
REMEMBERED = 1 << 17


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its shingles (uint64)."""
    weights = factors(words)
    for hashes, first in hashed_words(texts):
        grams = shingles(hashes, words)
        for begin, end in zip(first[:-1], first[1:]):
            if end - begin >= words:
                yield np.unique(grams[begin : end - words + 1])
            elif end > begin:
                short = (hashes[begin:end] * weights[: end - begin]).sum(dtype=np.uint64)
                yield mix(np.array([short + np.uint64(end - begin)]))
            else:
                yield grams[:0]


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total])).view(np.int64)[0])


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection with which sets of n and m shingles link."""
    return F.ceil((n + m) * percent / (100 + percent))


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of frequent shingles, counted over all documents (equal sets of a task once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), [])
            many = np.asarray(counts) >= LOCALLY
            return pa.RecordBatch.from_arrays(
                [pa.array(values[many].view(np.int64)), pa.array(np.asarray(counts, np.int64)[many])], ["shingle", "n"]
            )

        for batch in batches:
            for found in shingle_sets(batch.column("text"), words):
                key = set_key(found)
                if key in met:
                    continue
                if len(met) >= REMEMBERED:
                    met.clear()
                met.add(key)
                held.append(found)
                size += len(found)
                if size >= WINDOW:
                    yield counted()
                    held, size = [], 0
        yield counted()

    rows = (
        with_texts(docs.select("text"))
        .mapInArrow(tidy(run), "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "shingle")
        .limit(FREQUENT_KEPT)
        .toArrow()
    )
    return np.sort(rows.column("shingle").to_numpy().astype(np.int64).view(np.uint64))


def profiles(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (set size), cls (key of the set), typical, heads and prefix of every document.

    ``typical`` is the share of frequent shingles: within a large group of close copies it is
    highest for the text that the others were made from.

    Two sets can only link if their prefixes meet: the first n - ceil(t n) + 1 shingles in an
    order that all documents share, rare shingles before frequent ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            sizes, keys, typical, heads, prefixes = [], [], [], [], []
            for found in shingle_sets(batch.column("text"), words):
                n = len(found)
                sizes.append(n)
                keys.append(set_key(found) if n else None)
                heads.append(found[:HEADS].view(np.int64))
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                    common = often[at] == found
                    ordered = np.concatenate([found[~common], found[common]])
                    typical.append(float(common.mean()))
                else:
                    ordered = found
                    typical.append(0.0)
                prefixes.append(ordered[: n - -(-percent * n // 100) + 1 if n else 0].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(typical, pa.float64()),
                    pa.array(heads, longs),
                    pa.array(prefixes, longs),
                ],
                ["doc_id", "n", "cls", "typical", "heads", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_texts(docs).mapInArrow(tidy(run), f"doc_id {kind}, n long, cls long, typical double, heads array<long>, prefix array<long>")


def overlap_counts(sets: pa.Table, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlap and both sizes of the pairs (u, v) of one block.

    ``sets`` is the block's incidence by rows (cls, shingles; a class given twice counts once).
    Its columns are numbered, so that a row is a list of column numbers; the row of each v is
    spread out over the columns and the rows of its partners add up what they meet there.
    """
    keys, at = np.unique(sets.column("cls").to_numpy(), return_index=True)
    blobs = sets.column("shingles").take(pa.array(at)).to_pylist()
    size = np.array([len(b) // 8 for b in blobs], np.int64)
    first = np.append(0, np.cumsum(size))
    _, column = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)
    met = np.zeros(int(column.max(initial=-1)) + 1, bool)
    i, j = np.searchsorted(keys, u), np.searchsorted(keys, v)
    both = np.zeros(len(u), np.int64)
    order = np.argsort(j, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(j[order])) + 1) if len(order) else []:
        spread = column[first[j[group[0]]] : first[j[group[0]] + 1]]
        met[spread] = True
        for rows in np.array_split(i[group], -(-int(size[i[group]].sum()) // CELLS)):
            begins = np.append(0, np.cumsum(size[rows]))
            cells = np.repeat(first[rows] - begins[:-1], size[rows]) + np.arange(begins[-1])
            both[group[: len(rows)]] = np.add.reduceat(met[column[cells]], begins[:-1], dtype=np.int64)
            group = group[len(rows) :]
        met[spread] = False
    return both, size[i], size[j]


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The candidate pairs (u, v, n) whose whole sets link, as (u, v); n is the size of u.

    Pairs are dealt into blocks by v, those of a v with many partners over several blocks, so
    that a block holds about CELLS shingles. Sets are made again from the text of one document
    of each class and are sent once to each block that needs them.
    """
    cells = pairs.groupBy("v").agg(F.sum("n").alias("cells"))
    many = small(cut(cells.where(F.col("cells") > CELLS).select("v", F.ceil(F.col("cells") / CELLS).alias("parts"))))
    blocks = int((pairs.agg(F.sum("n")).first()[0] or 0) // CELLS) + 1
    part = F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1)))
    dealt = cut(pairs.join(many, "v", "left").select("u", "v", F.pmod(F.xxhash64("v", part), F.lit(blocks)).alias("block")))
    ends = dealt.select("block", F.col("u").alias("cls")).union(dealt.select("block", F.col("v").alias("cls"))).distinct()
    wanted = small(cut(ends.groupBy("cls").agg(F.collect_list("block").alias("blocks")).join(classes.select("cls", "rep"), "cls")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                keys, to, blobs = [], [], []
                for want, where, found in zip(rows.column("cls").to_pylist(), rows.column("blocks").to_pylist(), shingle_sets(rows.column("text"), words)):
                    if len(found) and set_key(found) == want:
                        keys += [want] * len(where)
                        to += where
                        blobs += [found.tobytes()] * len(where)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["block", "cls", "shingles"]
                )

    made = (
        docs.join(wanted, docs["doc_id"] == wanted["rep"])
        .select("cls", "blocks", "text")
        .mapInArrow(tidy(sets), "block long, cls long, shingles binary")
    )

    def links(rows: pa.Table, wished: pa.Table) -> pa.Table:
        u, v = (wished.column(c).to_numpy() for c in ("u", "v"))
        both, n, m = overlap_counts(rows, u, v)
        return wished.select(["u", "v"]).filter(pa.array(100 * both >= percent * (n + m - both)))

    return made.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(tidy_group(links), "u long, v long")


def close_sizes(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def star_pairs(profile: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, n) of every class with the most typical and the first class that share one of its heads."""
    heads = profile.select("cls", "n", "typical", F.explode("heads").alias("shingle")).distinct()
    ends = (
        heads.groupBy("shingle")
        .agg(F.min(F.struct("cls", "n")).alias("low"), F.max(F.struct("typical", "cls", "n")).alias("high"), F.max("cls").alias("last"))
        .where("low.cls <> last")
        .select("shingle", "low", F.struct("high.cls", "high.n").alias("high"))
    )
    met = heads.join(ends, "shingle").select("cls", "n", F.explode(F.array("low", "high")).alias("end"))
    return (
        met.where((F.col("cls") != F.col("end.cls")) & close_sizes("n", "end.n", percent))
        .select(F.col("cls").alias("u"), F.col("end.cls").alias("v"), "n")
        .distinct()
    )


def wanted_in_prefixes(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles the prefixes of linking sets of n and m shingles share at least."""
    return -(-(n + m) * percent // (100 + percent)) - (-(-np.maximum(n, m) * percent // 100) - 1)


def block_product(block: pa.Table, percent: int) -> pa.Table:
    """Pairs (u, v, n, m) of one block of prefix columns with the overlap inside it.

    The block's rows are (shingle, cls, n, comp, i, d, strip, a, b): class cls has shingle as
    the i-th of its d columns. In each column the classes outside its commonest component
    meet all others of another component and a close size. A pair's places i and j bound its
    overlap over all blocks; where that is below what its sizes need, it is left out. In a
    tile of different strips a and b only classes of different strips meet.
    """
    shingle, cls, n, comp, i, d, strip = (block.column(c).to_numpy() for c in ("shingle", "cls", "n", "comp", "i", "d", "strip"))
    crossing = block.num_rows > 0 and block.column("a")[0] != block.column("b")[0]
    order = np.lexsort((n, shingle))
    shingle, cls, n, comp, i, d, strip = (x[order] for x in (shingle, cls, n, comp, i, d, strip))
    opens = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] - 1)) if len(shingle) else np.zeros(0, np.int64)
    column = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(shingle))))
    _, comp = np.unique(comp, return_inverse=True)
    runs, times = np.unique(column * (int(comp.max(initial=0)) + 1) + comp, return_counts=True)
    run_column, run_comp = np.divmod(runs, int(comp.max(initial=0)) + 1)
    by_size = np.lexsort((times, run_column))
    common = run_comp[by_size[np.append(np.flatnonzero(np.diff(run_column[by_size])), len(by_size) - 1)]] if len(runs) else runs
    outside = comp != common[column]
    # sizes are placed on one line, column after column, so that one search finds every size's range
    line = column * (2 * int(n.max(initial=0)) + 3) + n
    low = np.searchsorted(line, line - n - (-n * percent // 100), side="left")
    high = np.searchsorted(line, line - n + np.minimum(n * 100 // percent, n.max(initial=0)), side="right")
    names, cls = np.unique(cls, return_inverse=True)
    askers = np.flatnonzero(outside)
    found, totals = np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = high[askers] - low[askers]
    for part in np.split(askers, np.flatnonzero(np.diff(np.cumsum(width) // CELLS)) + 1):
        count = high[part] - low[part]
        p = np.repeat(part, count)
        q = np.arange(len(p)) - np.repeat(np.cumsum(count) - count - low[part], count)
        keep = (comp[p] != comp[q]) & (~outside[q] | (p < q))
        if crossing:
            keep &= strip[p] != strip[q]
        p, q = p[keep], q[keep]
        reach = np.minimum(i[p], i[q]) + 1 + np.minimum(d[p] - i[p], d[q] - i[q]) - 1
        keep = reach >= wanted_in_prefixes(n[p], n[q], percent)
        one, other = cls[p[keep]], cls[q[keep]]
        keys, inverse = np.unique(np.append(found, np.minimum(one, other) * len(names) + np.maximum(one, other)), return_inverse=True)
        found, totals = keys, np.bincount(inverse, weights=np.append(totals, np.ones(len(one))), minlength=len(keys)).astype(np.int64)
    u, v = np.divmod(found, max(1, len(names)))
    size = np.zeros(len(names), np.int64)
    size[cls] = n
    return pa.table({"u": names[u], "v": names[v], "n": size[u], "m": size[v], "shared": totals})


def product_pairs(profile: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v, n) of classes of different groups whose prefix overlap leaves a link possible.

    The incidence of classes and prefix shingles is multiplied by its transpose, in blocks of
    columns that more than one group uses; a column of more than STRIP classes is cut into
    strips, and each pair of strips is a block. Every block adds up overlaps of its columns
    and leaves out pairs that the bounds rule out; the sums over blocks are then held against
    what the two sizes need, with the longest suffix that can still match.
    """
    grouped = profile.join(small(groups), profile["cls"] == groups["node"], "left").select(
        "cls", "n", F.coalesce("comp", "cls").alias("comp"), F.posexplode("prefix").alias("at", "shingle")
    )
    mixed = cut(
        grouped.groupBy("shingle")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low <> high")
        .select("shingle")
    )
    used = grouped.join(small(mixed), "shingle").distinct()
    own = Window.partitionBy("cls")
    placed = cut(
        used.withColumn("i", F.row_number().over(own.orderBy("at")) - 1).withColumn("d", F.count("*").over(own)).drop("at")
    )
    long_columns = cut(placed.groupBy("shingle").agg(F.ceil(F.count("*") / STRIP).alias("strips")).where("strips > 1"))
    blocks = placed.count() // CELLS + 1
    strips = F.coalesce("strips", F.lit(1))
    others = F.sequence(F.lit(0).cast("long"), strips - 1)
    dealt = (
        placed.join(small(long_columns), "shingle", "left")
        .withColumn("strip", F.pmod(F.xxhash64("cls"), strips))
        .withColumn("block", F.when(strips == 1, F.pmod("shingle", F.lit(blocks))).otherwise(F.col("shingle")))
        .withColumn("other", F.explode(others))
        .withColumn("a", F.least("strip", "other"))
        .withColumn("b", F.greatest("strip", "other"))
        .select("block", "shingle", "cls", "n", "comp", F.col("i").cast("long"), "d", "strip", "a", "b")
    )
    suffix = F.ceil(F.greatest("n", "m") * percent / 100) - 1
    return (
        dealt.groupBy("block", "a", "b")
        .applyInArrow(tidy_group(lambda block: block_product(block, percent)), "u long, v long, n long, m long, shared long")
        .groupBy("u", "v", "n", "m")
        .agg(F.sum("shared").alias("shared"))
        .where(F.col("shared") + suffix >= least_overlap(F.col("n"), F.col("m"), percent))
        .select("u", "v", "n")
    )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """Group documents whose sets of ``words``-word shingles reach a Jaccard similarity of ``percent`` / 100.

    Words are runs of non-blank characters with A-Z in lower case. A set holds the distinct
    shingles of the whole text; a text with fewer words is one shingle, one without words has
    an empty set and no links. Result: doc_id, n_shingles, component_id (the smallest id that
    links lead to, itself included), a row per input row. Rows with the same id share its
    component; a row without an id is no candidate and gets a NULL component. Other columns
    are ignored; an empty table gives an empty result.

    Equal sets are one class from the start. Then classes are compared with the ends of each
    group that shares one of their smallest hashes, which joins groups of close copies by as
    many pairs as there are copies; what links is settled by connected components. The blocked
    product of the incidence of classes and prefix shingles then runs between different groups
    only. Overlaps of surviving pairs are counted in blocks of whole sets. Nothing that grows
    with the data goes to the driver.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = plain.where(F.col("doc_id").isNotNull())
    profile_all = cut(profiles(plain, words, percent, frequent_shingles(named, words)))
    profile = profile_all.where(F.col("doc_id").isNotNull() & F.col("cls").isNotNull())
    classes = profile.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    close = linked(cut(star_pairs(profile, percent)), named, classes, words, percent)
    groups = cut(connected_components(close))
    links = linked(cut(product_pairs(profile, groups, percent)), named, classes, words, percent)
    # Rows of one id with different texts are one document.
    first = profile.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high")
    same_id = profile.join(first, "doc_id").select(F.col("cls").alias("u"), F.col("low").alias("v")).where("u <> v")
    settled = groups.select(F.col("node").alias("u"), F.col("comp").alias("v")).where("u <> v")
    final = cut(connected_components(settled.union(links).union(same_id)))
    placed = (
        profile_all.select("doc_id", "n", "cls")
        .join(final, F.col("cls") == F.col("node"), "left")
        .select("doc_id", "n", F.coalesce("comp", "cls").alias("comp"))
    )
    roots = placed.where("doc_id IS NOT NULL AND comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("root"))
    return placed.join(roots, "comp", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    )
