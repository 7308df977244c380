"""Spelling variants: words one edit apart, found by k-d trees over letter counts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, with_texts
from .hashing import BLANK, chunks, words_of

#: Letters: a-z, and U+00C0 to U+00FF as they are. All are Latin-1, so a word is a row of bytes.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)])
_CODE = np.zeros(256, np.uint8)
_CODE[LETTERS] = np.arange(len(LETTERS))
#: Words of a cell (of up to LONG letters; fewer of longer ones), of a leaf, and of a sample for the outer trees.
CELL, LEAF, SAMPLE, LONG = 8192, 48, 1 << 18, 64
#: Queries that go through a tree at a time, and query words that a task gets for one cell.
QUERIES, CROWD = 2048, 64 * CELL
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 17
_SAME = np.arange(256, dtype=np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of ``data[begins[i]:ends[i]]``, each carried on from the crc32 ``seeds[i]``: a byte of all words at a time."""
    sizes = ends - begins
    order = np.argsort(-sizes, kind="stable")
    state = seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    start, longest = begins[order], int(min(sizes.max(initial=0), LONG))
    going = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    for k, n in enumerate(going.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[start[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = zlib.crc32(data[begins[i] : ends[i]].tobytes(), int(seeds[i]))
    return out


def letters_only(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased, and all but letters blank."""
    kept = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    wide = data == 0xC3
    kept |= wide
    kept[1:] |= wide[:-1]
    return np.where(kept, np.where((data >= 65) & (data <= 90), data + 32, data), 0x20).astype(np.uint8)


def count_words(docs: DataFrame, least: int, drop_every: int | None, id_col: str, text_col: str) -> DataFrame:
    """(word, n): partial counts of the words of ``least`` letters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                at = 0
                ids = part.column("id").to_pylist()
                for data, bounds in chunks(part.column("text")):
                    data = letters_only(data)
                    hashes, begins, ends, first = words_of(data, bounds, BLANK, _SAME)
                    so_far = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    length = so_far[ends] - so_far[begins]
                    usual = length >= least
                    if drop_every:
                        seeds = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in ids[at : at + len(bounds) - 1]], np.uint32)
                        crc = checksums(data, begins, ends, np.repeat(seeds, np.diff(first)))
                        hit = crc % drop_every == 0
                        for i in np.flatnonzero(hit & (length > least)).tolist():
                            word = data[begins[i] : ends[i]].tobytes().decode()
                            k = int(crc[i]) % len(word)
                            word = word[:k] + word[k + 1 :]
                            held[word] = held.get(word, 0) + 1
                        usual &= ~hit
                    own = np.flatnonzero(usual)
                    _, index, n = np.unique(hashes[own], return_index=True, return_counts=True)
                    raw = data.tobytes()
                    for b, e, k in zip(begins[own[index]].tolist(), ends[own[index]].tolist(), n.tolist()):
                        word = raw[b:e].decode()
                        held[word] = held.get(word, 0) + k
                    at += len(bounds) - 1
                    if len(held) > HELD:
                        yield passed_on()
        yield passed_on()

    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return with_texts(texts).mapInArrow(run, "word string, n long")


def letter_rows(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letter codes."""
    return _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)].reshape(len(words), length)


def count_vectors(rows: np.ndarray) -> np.ndarray:
    """How often each letter stands in each row."""
    flat = np.arange(len(rows))[:, None] * len(LETTERS) + rows
    return np.bincount(flat.reshape(-1), minlength=len(rows) * len(LETTERS)).reshape(len(rows), len(LETTERS)).astype(np.int32)


@dataclass
class Node:
    """A box of a k-d tree: ``low`` and ``high`` are the bounds of the letters split on so far."""

    low: dict[int, int]
    high: dict[int, int]
    number: int = -1  # of a leaf
    points: np.ndarray | None = None  # of a leaf
    letter: int = -1
    most: int = -1  # in the lower half
    halves: tuple[Node, Node] | None = None

    def reached(self, vectors: np.ndarray, up: int, down: int) -> np.ndarray:
        """Vectors from which ``up`` letters more and ``down`` letters fewer may lead into the box."""
        more, fewer = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int32)
        for letter, low in self.low.items():
            more += np.maximum(low - vectors[:, letter], 0)
        for letter, high in self.high.items():
            fewer += np.maximum(vectors[:, letter] - high, 0)
        return (more <= up) & (fewer <= down)


def kd_tree(vectors: np.ndarray, leaf: float) -> tuple[Node, int]:
    """A k-d tree over letter counts and its number of leaves: boxes of more than ``leaf`` points are halved at the widest letter."""
    root = Node({}, {})
    waiting, leaves = [(root, np.arange(len(vectors)))], 0
    while waiting:
        node, own = waiting.pop()
        if len(own) > leaf:
            node.letter = int(vectors[own].var(axis=0).argmax())
            values = vectors[own, node.letter]
            if values.min() < values.max():
                middle = int(np.median(values))
                node.most = middle - 1 if (values < middle).sum() > (values > middle).sum() or middle == values.max() else middle
                node.halves = (Node(node.low, node.high | {node.letter: node.most}), Node(node.low | {node.letter: node.most + 1}, node.high))
                waiting += [(node.halves[0], own[values <= node.most]), (node.halves[1], own[values > node.most])]
                continue
        node.number, node.points = leaves, own
        leaves += 1
    return root, leaves


def search(root: Node, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Each leaf with the vectors that reach its box; other boxes are pruned with all that lies in them."""
    waiting = [(root, np.arange(len(vectors)))]
    while waiting:
        node, own = waiting.pop()
        own = own[node.reached(vectors[own], up, down)]
        if not len(own):
            continue
        if node.halves is None:
            yield node, own
        else:
            waiting += [(half, own) for half in node.halves]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by one replaced letter, or (rows of b are longer by one) by one inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def near_pairs(tree: Node, rows: np.ndarray, vectors: np.ndarray, asked: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, point) one edit apart. With ``own`` the queries are the points, and each pair comes once.

    Count vectors of such words differ by one letter more and (at equal length) one fewer, which is a squared
    distance of 2, or of 1 where the point is longer; letter order decides among these.
    """
    longer = rows.shape[1] > asked.shape[1]
    far = 1 if longer else 2
    step = max(16, QUERIES * LONG // max(LONG, rows.shape[1]))
    real = vectors.astype(np.float64)
    norm = (real * real).sum(axis=1)
    for at in range(0, len(asked), step):
        batch = asked[at : at + step]
        counts = count_vectors(batch)
        for leaf, those in search(tree, counts, 1, 0 if longer else 1):
            query = counts[those].astype(np.float64)
            distance = (query * query).sum(axis=1)[:, None] + norm[leaf.points] - 2 * query @ real[leaf.points].T
            i, k = np.nonzero(np.abs(distance - far) < 0.5)
            i, k = those[i], leaf.points[k]
            if own:
                i, k = i[i + at < k], k[i + at < k]
            for cut_at in range(0, len(i), 1 << 16):
                x, y = i[cut_at : cut_at + (1 << 16)], k[cut_at : cut_at + (1 << 16)]
                good = one_edit(batch[x], rows[y])
                if good.any():
                    yield x[good] + at, y[good]


def best_near(words: list[str], n: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(word, n_near, form_n, form) from pairs of places in ``words``, both ways: number, and the most frequent, then first, one."""
    empty = np.zeros(0, np.int64)
    a = np.concatenate([empty, *(x for x, _ in pairs), *(y for _, y in pairs)]).astype(np.int64)
    b = np.concatenate([empty, *(y for _, y in pairs), *(x for x, _ in pairs)]).astype(np.int64)
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((place[b], -n[b], a))
    own, first, count = np.unique(a[order], return_index=True, return_counts=True)
    best = b[order][first]
    text = lambda at: pd.Series([words[i] for i in at], dtype=object)
    return pd.DataFrame({"word": text(own), "n_near": count, "form_n": n[best], "form": text(best)})


def outer_trees(words: DataFrame, cell: int) -> dict[int, Node]:
    """For each length with more words than a cell holds a k-d tree whose leaves are cells, from a sample of SAMPLE words at most."""
    sizes = {r["length"]: r["count"] for r in words.groupBy("length").count().where(F.col("count") > cell).collect()}
    if not sizes:
        return {}
    share = max(1, SAMPLE // len(sizes))
    keep = F.create_map(*(F.lit(x) for length, n in sizes.items() for x in (length, min(1.0, share / n))))
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < keep[F.col("length")] * (1 << 20))
    trees = {}
    for length, own in drawn.select("length", "word").limit(2 * SAMPLE).toPandas().groupby("length"):
        rows = letter_rows(own.word.tolist(), int(length))
        tree, _ = kd_tree(count_vectors(rows), cell * len(own) / sizes[int(length)])
        waiting = [tree]
        while waiting:  # cells keep no sampled words
            node = waiting.pop()
            node.points = None
            waiting += node.halves or ()
        trees[int(length)] = tree
    return trees


def dealer(trees: dict[int, Node], slots: dict[tuple[int, int], tuple[int, int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sends words to their home cell and, as queries, to all cells they reach; a pair of words of one length meets once.

    ``slots`` gives cells with too many words, or too many queries, the numbers into which these are dealt: each part
    of the words meets each part of the queries.
    """

    def cells(length: int, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        if length not in trees:
            yield 0, np.arange(len(counts))
            return
        for leaf, own in search(trees[length], counts, up, down):
            yield leaf.number, own

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, own in batch.groupby("length"):
                length = int(length)
                counts = count_vectors(letter_rows(own.word.tolist(), length))
                home = np.zeros(len(own), np.int64)
                salt = own.salt.to_numpy()
                for cell, those in cells(length, counts, 0, 0):
                    home[those] = cell
                parts: list[tuple[int, int, np.ndarray, int, bool]] = []
                for cell in np.unique(home).tolist():
                    at = np.flatnonzero(home == cell)
                    across, crowd = slots.get((length, cell), (1, 1))
                    for part in range(across):
                        mine = at[salt[at] % across == part]
                        parts += [(cell, part * crowd + q, mine, length, True) for q in range(crowd)]
                        # words of the parts before are queries here
                        before = at[salt[at] % across < part]
                        parts += [(cell, part * crowd + q, before[salt[before] // 4096 % crowd == q], length, False) for q in range(crowd)]
                for target, up, down in ((length, 1, 1), (length + 1, 1, 0)):
                    for cell, those in cells(target, counts, up, down):
                        if target == length:
                            those = those[home[those] < cell]
                        across, crowd = slots.get((target, cell), (1, 1))
                        parts += [(cell, p * crowd + q, those[salt[those] // 4096 % crowd == q], target, False) for p in range(across) for q in range(crowd)]
                for cell, part, at, target, is_own in parts:
                    if len(at):
                        yield pd.DataFrame({"target": target, "cell": cell, "part": part, "own": is_own, "word": own.word.to_numpy()[at], "length": length, "n": own.n.to_numpy()[at]})

    return deal


_DEALT = "target int, cell long, part long, own boolean, word string, length int, n long"


def cell_pairs(crowds: dict[tuple[int, int], tuple[int, int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(group: pd.DataFrame) -> pd.DataFrame:
        target, cell, part = int(group.target.iloc[0]), int(group.cell.iloc[0]), int(group.part.iloc[0])
        group = pd.concat([group[group.own], group[~group.own & (group.length == target)], group[~group.own & (group.length < target)]])
        words, n = group.word.tolist(), group.n.to_numpy()
        size, even = int(group.own.sum()), int((group.length == target).sum())
        pairs = []
        if size:
            rows = letter_rows(words[:size], target)
            vectors = count_vectors(rows)
            tree, _ = kd_tree(vectors, LEAF)
            if part % crowds.get((target, cell), (1, 1))[1] == 0:
                pairs += list(near_pairs(tree, rows, vectors, rows, True))
            for begin, until, length in ((size, even, target), (even, len(words), target - 1)):
                if until > begin:
                    pairs += [(i + begin, k) for i, k in near_pairs(tree, rows, vectors, letter_rows(words[begin:until], length), False)]
        return best_near(words, n, pairs)

    return work


def near_words(words: DataFrame, cell: int = CELL, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have a near word: how many, and the most frequent one.

    Words meet by pairs of lengths in cells of a k-d tree over their letter counts: each has one
    home, and is a query in the other cells that one edit can reach. A cell's task holds about
    ``cell`` words; where many share a place of the tree the cell is dealt into parts.
    """
    rows = words.select("word", "n", F.char_length("word").alias("length"), F.pmod(F.xxhash64("word"), F.lit(1 << 40)).alias("salt"))
    trees = outer_trees(rows, cell)
    dealt = cut(rows.mapInPandas(dealer(trees, {}), _DEALT))
    counted = dealt.groupBy("target", "cell").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("asked"))
    room = F.greatest(F.lit(1), F.col("target") / LONG)
    slots = counted.select(
        "target", "cell", F.ceil(F.col("own") * room / (2 * cell)).alias("across"), F.ceil(F.col("asked") * room / (2 * crowd)).alias("crowd")
    )
    large = {(r["target"], r["cell"]): (max(1, r["across"]), max(1, r["crowd"])) for r in slots.where("across > 1 OR crowd > 1").collect()}
    if large:
        dealt = rows.mapInPandas(dealer(trees, large), _DEALT)
    found = dealt.groupBy("target", "cell", "part").applyInPandas(cell_pairs(large), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) from each word ends. Chains double in each round, and forms never go in circles."""
    current = forms.select("word", F.col("form").alias("root"))
    while True:
        after = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut(current.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def spelling_variants(
    docs: DataFrame,
    least_letters: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    drop_every: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    cell: int = CELL,
    crowd: int = CROWD,
) -> DataFrame:
    """Words with the spelling they are likely a variant of.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased, of at
    least ``least_letters`` letters and ``least_count`` occurrences. With ``drop_every``, a run
    whose crc32 with its id (``<id>:<run>``) that number divides loses the letter at
    crc32 % length first (planted errors). Words are near if one letter inserted, deleted or
    replaced makes one the other. A word's form is its most frequent near word (ties: the
    first in code-point order), if that occurs at least ``ratio`` times as often.

    Result: word, form (or NULL), root (where forms lead from the word; the word itself if it
    has none), n, n_near, form_n (or NULL); one row per word. NULL and empty texts hold no words, a NULL
    id counts as an empty one, repeated rows count each time, other columns are ignored. An
    empty table gives an empty result. Long texts and runs are worked on whole. A task holds about ``cell`` words
    of a cell and twice ``crowd`` queries at most.
    """
    counts = count_words(docs, least_letters, drop_every, id_col, text_col)
    words = cut(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    near = near_words(words, cell, crowd)
    joined = words.join(near, "word", "left").withColumn("takes", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    joined = cut(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("form")).alias("form"), F.when(F.col("takes"), F.col("form_n")).alias("form_n")
        )
    )
    ends = roots(joined.where(F.col("form").isNotNull()).select("word", "form"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
