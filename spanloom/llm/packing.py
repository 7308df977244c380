"""Packing: cutting-stock column generation over a histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy, with_texts
from .subword import encoder

#: The id that ends every document.
END = 1
#: Tokens in a unit of length; the linear program has a row for each number of units.
UNIT = 8
#: Pieces of one length and one salt that are ranked together, about.
RANKED = 20_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def tokenised(docs: DataFrame, capacity: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: whole sequences from a document's start, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in encoder(lower=False)(batch.column("_text")):
                origin, rows, ids = [], [], []
                for i, (begin, end) in enumerate(zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist())):
                    own = np.append(part.ids[begin:end], END).astype("<u4")
                    for start in range(0, len(own), capacity):
                        piece = own[start : start + capacity]
                        origin.append(done + i)
                        rows.append((start, len(piece), zlib.crc32(piece), len(own)))
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                columns.insert(0, batch.column("doc_id").take(pa.array(origin, pa.int64())))
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                done += len(part.bounds) - 1

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return with_texts(source).mapInArrow(tidy(run), f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids)


def knapsack(duals: np.ndarray, widths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest worth that fits each size up to ``room``, and the width taken last there (-1: none).

    An unbounded knapsack by dynamic programming; ``widths`` are sorted.
    """
    worth, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for size in range(int(widths[0]), room + 1):
        fitting = np.searchsorted(widths, size, side="right")
        values = worth[size - widths[:fitting]] + duals[:fitting]
        best = int(values.argmax())
        worth[size] = worth[size - 1]
        if values[best] > worth[size] + 1e-12:
            worth[size], choice[size] = values[best], best
    return worth, choice


def priced(duals: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The largest worth of a pattern, and for each width the pattern (row) of largest worth that holds it."""
    worth, choice = knapsack(duals, widths, room)
    patterns = np.eye(len(widths))
    size = room - widths
    rows = np.arange(len(widths))
    while len(rows):
        taken = choice[size]
        step = np.where(taken < 0, 1, widths[taken])
        np.add.at(patterns, (rows[taken >= 0], taken[taken >= 0]), 1)
        size = size - step
        rows, size = rows[size > 0], size[size > 0]
    return float(worth[room]), patterns


#: How far the duals that price patterns stay with the best ones so far.
STEADY = 0.5
#: Simplex steps without gain after which the rule against circles holds.
STALL = 100


def column_generation(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used in the linear program's optimum.

    The rows of the program are the widths, its columns patterns of widths that fit ``room``.
    It starts from patterns of one width. Duals, smoothed towards those of the best bound so
    far, price new patterns; those worth more than the sequence they take enter by simplex steps.
    The program is done when no pattern is worth more than a sequence, or when its value
    rounds up to the same whole number as a lower bound: the area, or the value over the
    largest worth. Either is a proof that no better patterns would save a sequence. After STALL
    simplex steps without gain the pattern met first enters and leaves (Bland's rule), so steps can't go in circles.
    """
    widths = np.array(sorted(demand))
    need = np.array([demand[w] for w in widths], dtype=np.float64)
    columns = np.diag((room // widths).astype(np.float64))
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ need
    lower = float(widths @ need) / room
    steady, pool, bound = None, np.zeros((0, len(widths))), -np.inf
    names: dict[bytes, int] = {}  # patterns are numbered as they are met
    basis = np.array([names.setdefault(c.tobytes(), len(names)) for c in columns.T])
    stalled = 0
    while np.ceil(amount.sum() - 1e-6) > np.ceil(lower - 1e-6):
        duals = inverse.sum(axis=0)
        asked = duals if steady is None else STEADY * steady + (1 - STEADY) * duals
        value, found = priced(asked, widths, room)
        if float(asked @ need) / value > bound:
            bound, steady = float(asked @ need) / value, asked / value
        lower = max(lower, bound)
        if (found @ duals).max() <= 1 + 1e-7 and steady is not None:
            value, found = priced(duals, widths, room)
            lower = max(lower, float(duals @ need) / value)
            if value <= 1 + 1e-7:
                break
            steady, bound = None, -np.inf
        pool = np.unique(np.concatenate([pool, found]), axis=0)
        while True:
            worth = pool @ inverse.sum(axis=0)
            entering = int(worth.argmax())
            if worth[entering] <= 1 + 1e-7:
                break
            if stalled > STALL:
                good = np.flatnonzero(worth > 1 + 1e-7)
                entering = int(min(good, key=lambda i: names.setdefault(pool[i].tobytes(), len(names))))
            direction = inverse @ pool[entering]
            moving = direction > 1e-9
            ratios = np.where(moving, amount / np.where(moving, direction, 1), np.inf)
            leaving = int(ratios.argmin())
            step = ratios[leaving]
            if stalled > STALL:
                leaving = int(min(np.flatnonzero(ratios <= step + 1e-12), key=basis.__getitem__))
            stalled = stalled + 1 if step < 1e-9 else 0
            basis[leaving] = names.setdefault(pool[entering].tobytes(), len(names))
            amount = np.maximum(amount - step * direction, 0)
            amount[leaving] = step
            pivot = inverse[leaving] / direction[leaving]
            inverse -= np.outer(direction, pivot)
            inverse[leaving] = pivot
            columns[:, leaving] = pool[entering]
        pool = pool[worth > 1 - 0.05]
    return [
        ({int(w): int(n) for w, n in zip(widths, columns[:, j]) if n}, float(amount[j]))
        for j in range(len(widths))
        if amount[j] > 1e-9
    ]


def whole_patterns(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns used a whole number of times that hold exactly ``demand``.

    The program's amounts are rounded down; what that leaves, a few pieces for each pattern,
    is packed first-fit with the widest first.
    """
    demand = {w: n for w, n in demand.items() if n}
    if not demand:
        return []
    used: list[tuple[dict[int, int], int]] = []
    left = Counter(demand)
    for pattern, amount in column_generation(demand, room):
        times = min(int(amount + 1e-6), *(left[w] // n for w, n in pattern.items()))
        if times > 0:
            used.append((pattern, times))
            left.subtract({w: n * times for w, n in pattern.items()})
    open_by_room: dict[int, list[Counter]] = {}
    for width in sorted(left, reverse=True):
        for _ in range(left[width]):
            fitting = [r for r in open_by_room if r >= width]
            if fitting:
                best = min(fitting)
                bin_ = open_by_room[best].pop()
                if not open_by_room[best]:
                    del open_by_room[best]
            else:
                best, bin_ = room, Counter()
            bin_[width] += 1
            open_by_room.setdefault(best - width, []).append(bin_)
    merged = Counter(tuple(sorted(b.items())) for bins in open_by_room.values() for b in bins)
    return used + [(dict(pattern), times) for pattern, times in sorted(merged.items())]


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``capacity`` tokens.

    A document's tokens are the ids of its text and the end id 1. Its first multiples of
    ``capacity`` are sequences of their own; the piece that remains is rounded up to units of
    UNIT tokens, and the histogram of these widths is the cutting-stock problem. A pattern
    says how many pieces of each width share a sequence. Pieces of one width are ranked, and
    the rank decides which pattern, which of its sequences and which place in it they get.

    Result: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with
    ``with_ids``), a row for each piece; each id of each input row is in exactly one piece.
    NULL and empty texts are the end id alone. Repeated rows are packed each. An empty table
    gives an empty result; other columns are ignored.

    The driver sees the histogram and the patterns, at most capacity / UNIT widths and some
    hundreds of patterns whatever the table's size. Ranks are counted within salted parts of a
    width, so a width of a third of all pieces is no large group.
    """
    room = capacity // UNIT
    pieces = cut(tokenised(docs, capacity, with_ids, id_col, text_col))
    width = F.when(F.col("length") == capacity, 0).otherwise(F.ceil(F.col("length") / UNIT)).cast("int")
    sized = pieces.withColumn("width", width)
    histogram = {r["width"]: r["n"] for r in sized.groupBy("width").agg(F.count("*").alias("n")).collect()}
    salts = max(64, -(-sum(histogram.values()) // RANKED))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("width").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        salted.groupBy("width", "salt")
        .agg(F.count("*").alias("n"))
        .select("width", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    )
    own = Window.partitionBy("width", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        salted.withColumn("row", F.row_number().over(own))
        .join(parts, ["width", "salt"])
        .withColumn("rank", F.col("ahead") + F.col("row") - 1)
        .drop("salt", "row", "ahead")
    )

    slots, sequences = [], histogram.pop(0, 0)
    taken: Counter = Counter()
    for pattern, times in whole_patterns(histogram, room):
        place = 0
        for w, n in sorted(pattern.items(), reverse=True):
            slots.append((w, taken[w], taken[w] + n * times, n, sequences, place))
            taken[w] += n * times
            place += n
        sequences += times
    spark = docs.sparkSession
    schema = "w int, first long, past long, each long, base long, place long"
    plan = F.broadcast(spark.createDataFrame([*slots, (0, 0, 1 << 62, 1, 0, 0)], schema))
    seated = (
        ranked.join(
            plan, (F.col("width") == F.col("w")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
        )
        .withColumn("sequence_id", F.expr("base + (rank - first) DIV each"))
        .withColumn("seat", F.expr("place + (rank - first) % each"))
    )
    ahead = Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    return seated.select(*names, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
