"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, with_texts
from .hashing import PUNCTUATION, hashed_words, mix, shingles

#: A fingerprint has BITS bits in BLOCKS blocks. Two fingerprints within RADIUS differ by at
#: most RADIUS // BLOCKS in one block at least, which is what the index looks up. At a
#: similarity of 0.8 about 20 bits of 128 differ, with a standard deviation of 4.
BITS, BLOCKS, RADIUS = 128, 8, 31
WIDTH = BITS // BLOCKS
#: Bounds of a block of benchmark items, which is what a task holds at a time.
BLOCK_ITEMS, BLOCK_WORDS = 1000, 200_000


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of weighted shingles: each occurrence votes on every bit. Returned as BLOCKS 16-bit numbers."""
    both = np.stack([mix(own), mix(own ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(own), BITS // 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).view(np.uint16)


def similarity(one: Counter, other: Counter) -> float:
    """Weighted Jaccard: each shingle weighs as often as it occurs."""
    least = sum(min(n, other[s]) for s, n in one.items() if s in other)
    return least / (one.total() + other.total() - least)


@cache
def near_masks() -> np.ndarray:
    """All WIDTH-bit masks with at most RADIUS // BLOCKS bits."""
    return np.array(
        [sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(WIDTH), k)], np.uint16
    )


class Items:
    """A block of benchmark items, as hashed words: anchors, fingerprints and their multi-index."""

    def __init__(self, rows: list[tuple[object, np.ndarray]], size: int):
        self.ids = [item for item, _ in rows]
        self.size_of = np.array([min(size, len(words)) for _, words in rows])
        own = [shingles(words, s) for (_, words), s in zip(rows, self.size_of)]
        self.counts = [Counter(x.tolist()) for x in own]
        self.prints = np.stack([fingerprint(x) for x in own])
        self.anchors: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for s in sorted(set(self.size_of.tolist())):
            lengths: dict[int, set[int]] = {}
            for i in np.flatnonzero(self.size_of == s):
                for shingle in self.counts[i]:
                    lengths.setdefault(shingle, set()).add(len(rows[i][1]))
            keys = np.array(sorted(lengths), np.uint64)
            self.anchors[s] = (keys, [sorted(lengths[k]) for k in keys.tolist()])
        masks = near_masks()
        self.index = []
        for block in range(BLOCKS):
            near = (self.prints[:, block][:, None] ^ masks[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            starts = np.searchsorted(near[order], np.arange((1 << WIDTH) + 1))
            self.index.append((starts, (order // len(masks)).astype(np.int32)))

    def candidates(self, print_: np.ndarray) -> np.ndarray:
        """Items whose fingerprint is within RADIUS, by way of the index."""
        near = [rows[starts[v] : starts[v + 1]] for v, (starts, rows) in zip(print_.tolist(), self.index)]
        found = np.unique(np.concatenate(near))
        apart = np.bitwise_count(self.prints[found] ^ print_).sum(axis=1)
        return found[apart <= RADIUS]

    def best_windows(self, grams: np.ndarray, windows: set[tuple[int, int]], size: int, least: float) -> Iterator[tuple]:
        """(item, first word, words, similarity) of the best window for every item found in one text."""
        best: dict[int, tuple[float, int, int]] = {}
        for start, length in sorted(windows):
            own = grams[start : start + length - size + 1]
            counts = None
            for i in self.candidates(fingerprint(own)).tolist():
                if self.size_of[i] == size:
                    counts = counts or Counter(own.tolist())
                    value = similarity(counts, self.counts[i])
                    if value >= least and value > best.get(i, (0, 0, 0))[0]:
                        best[i] = (value, start, length)
        for i, (value, start, length) in sorted(best.items()):
            yield self.ids[i], start, length, value

    def search(self, texts: pa.Array, least: float) -> Iterator[tuple[int, tuple]]:
        """(row, (item, first word, words, similarity)) of a column of texts.

        Windows begin with an item's shingle, or end with the text. A window that shares
        shingles with an item can be moved to begin with the first of them without losing
        one, so no other window is better and none without a shingle can reach the threshold.
        """
        base = 0
        for hashes, first in hashed_words(pc.utf8_lower(texts), PUNCTUATION):
            for size, (keys, lengths) in self.anchors.items():
                grams = shingles(hashes, size)
                place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                at = np.flatnonzero(keys[place] == grams)
                row = np.searchsorted(first, at, side="right") - 1
                inside = at + size <= first[row + 1]
                windows: dict[int, set[tuple[int, int]]] = {}
                for p, r in zip(at[inside].tolist(), row[inside].tolist()):
                    begin, n_words = int(first[r]), int(first[r + 1] - first[r])
                    for n in lengths[place[p]]:
                        windows.setdefault(r, set()).add((max(0, min(p - begin, n_words - n)), min(n, n_words)))
                for r, own in windows.items():
                    for leak in self.best_windows(grams[first[r] : first[r + 1] - size + 1], own, size, least):
                        yield base + r, leak
            base += len(first) - 1


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The benchmark as hashed words, in blocks of bounded size, one at a time."""
    rows: list[tuple[object, np.ndarray]] = []
    held = 0
    for row in benchmark.select(F.col(id_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        words = np.concatenate([h for h, _ in hashed_words(pc.utf8_lower(pa.array([row[1]])), PUNCTUATION)])
        if not len(words):
            continue
        if rows and (len(rows) >= BLOCK_ITEMS or held + len(words) > BLOCK_WORDS):
            yield rows
            rows, held = [], 0
        rows.append((row[0], words))
        held += len(words)
    if rows:
        yield rows


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    least: float = 0.8,
) -> DataFrame:
    """Find benchmark items in documents.

    Words are lower-cased runs of letters, digits, underscores and non-ASCII characters. A
    leak is a window of a document, as many words long as the item, whose ``words``-word shingles reach a weighted Jaccard
    similarity of ``least`` with the item's (a shingle weighs as often as it occurs; an item
    of fewer words is one shingle; a document shorter than the item is one window). Result:
    doc_id, item_id, start_word, n_words, similarity, a row for each document and item with
    the best window, the first of equals.

    NULL and empty texts and items have no leaks. Rows with the same document and item ids
    give one row. Other columns are ignored; empty tables give an empty result.

    Documents are read where they lie and never shuffled. The benchmark goes out in blocks of
    bounded size, one pass over the documents for each; a benchmark of up to BLOCK_ITEMS items
    takes one pass. Only leaks are grouped.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (source.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    schema = f"doc_id {kinds[0]}, item_id string, start_word long, n_words long, similarity double"

    def passed(items: Items) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                origin, found = [], []
                for i, leak in shared.value.search(batch.column("text"), least):
                    origin.append(i)
                    found.append(leak)
                item, start, n, value = zip(*found) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(origin, pa.int64())),
                        pa.array(item, pa.string()),
                        pa.array(start, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(value, pa.float64()),
                    ],
                    ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                )

        return with_texts(source).mapInArrow(tidy(run), schema)

    passes = [passed(Items(rows, words)) for rows in item_blocks(benchmark, item_col, item_text_col)]
    if not passes:
        return spark.createDataFrame([], schema).withColumn("item_id", F.col("item_id").cast(kinds[1]))
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), "n_words")).alias("best")
    return (
        reduce(DataFrame.unionByName, passes)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            F.col("item_id").cast(kinds[1]).alias("item_id"),
            (-F.col("best.back")).alias("start_word"),
            F.col("best.n_words").alias("n_words"),
            F.col("best.similarity").alias("similarity"),
        )
    )
