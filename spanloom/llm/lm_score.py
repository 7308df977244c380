"""LM scoring: a unigram base over words, and a causal self-attention model over subword ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, with_texts
from .hashing import hashed_words
from .subword import encoder

#: The id that ends a text, free in the vocabulary of 50,256 ids.
END, VOCABULARY = 50_256, 50_257
#: A window predicts STRIDE tokens, each from the STRIDE to 2 STRIDE - 1 tokens before it.
STRIDE = 16
REACH = 2 * STRIDE - 1
#: Width of the model (its last column is 1 throughout, for biases and sums), rows of its input (each
#: id has its own, row 0 stands before a text), output classes (the most frequent ids have their own).
WIDTH, INPUTS, CLASSES, OWN_CLASS = 16, VOCABULARY + 1, 64, 48
#: Training texts are dealt into ROUNDS parts; a round trains on one of them. After all have had
#: their round, more follow, up to PASSES times all, while one gains GAIN (log10 a token, on texts held back).
ROUNDS, GAIN, PASSES = 4, 0.002, 6
#: One training text in HELD_BACK is left out of successor counts and training, to choose by.
HELD_BACK = 64
#: Weights of the model in its mixture with the unigram; the one best on texts held back is taken.
MIXTURES = np.array([0, 0.5, 0.8, 0.9, 0.95, 0.98, 1.0])
#: Pseudo-counts of the unigram among an id's successors, and among those inside a class.
SUCCESSORS, INSIDE = 8.0, 64.0
#: Size of a row's random mark beside its successors' directions, which are of size 1.
OWN_MARK = 0.3
#: Windows in a batch of attention, ids put in line at a time, ids of one task's share of a round at least.
BATCH, LINE, SHARE = 256, 1 << 16, 1 << 18
#: Words with their own count on every executor, at most; other words' counts come by a join.
HEAD_WORDS = 1 << 20
#: Words that a task counts before it passes counts on, and ids that it counts at a time.
COUNTED = 2 << 20
#: Stands for the end of a text among the hashes of words.
END_WORD = np.uint64(0x0E0DE0DE0DE0DE0D)


# ---------------------------------------------------------------- the attention model


@dataclass(frozen=True)
class Units:
    """What corpus counts say of the subword ids.

    ``class_of`` an id, ``share`` of an id in its class, ``mass`` of a class (probabilities).
    """

    class_of: np.ndarray
    share: np.ndarray
    mass: np.ndarray


def units(counts: np.ndarray) -> Units:
    """The most frequent ids get classes of their own; the other classes hold much the same mass, or number of ids."""
    smooth = counts + 0.5
    order = np.lexsort((np.arange(VOCABULARY), -counts))
    rest = smooth[order][OWN_CLASS:]
    part = (np.cumsum(rest) / rest.sum() + np.arange(1, len(rest) + 1) / len(rest)) / 2  # neither much mass nor many ids
    class_of = np.empty(VOCABULARY, np.int64)
    class_of[order[:OWN_CLASS]] = np.arange(OWN_CLASS)
    # no class is skipped, however much mass one id has, so that no probability goes to an empty class
    tail, n = CLASSES - OWN_CLASS, len(rest)
    begins = np.searchsorted(part, np.arange(tail) / tail)
    begins = np.maximum.accumulate(begins - np.arange(tail)) + np.arange(tail)
    begins = np.minimum(begins, n - tail + np.arange(tail))
    class_of[order[OWN_CLASS:]] = OWN_CLASS + np.searchsorted(begins, np.arange(n), side="right") - 1
    mass = np.bincount(class_of, weights=smooth, minlength=CLASSES)
    return Units(class_of, smooth / mass[class_of], mass / mass.sum())


@dataclass(frozen=True)
class Tables:
    """What is fixed before training, from counts over the training texts; float32.

    ``embed`` is each input row's vector; ``successor`` its log probabilities of the next
    class; ``inside[c, i]`` the log probability of id i in its class after an id of class c
    (the last class row stands for the place before a text). ``embed`` has the directions in
    which the rows' successors differ most, by their counts, and a random mark of each row, so
    that attention can tell ids with the same successors apart.
    """

    embed: np.ndarray
    successor: np.ndarray
    inside: np.ndarray


def tables(u: Units, successors: np.ndarray, insides: np.ndarray) -> Tables:
    """From counts of (input row, next class) and of (class before, id); ids alone in their class needn't be counted there."""
    seen = successors.sum(axis=1)
    chance = (successors + SUCCESSORS * u.mass) / (seen + SUCCESSORS)[:, None]
    lift = np.log(chance / u.mass)
    _, directions = np.linalg.eigh((lift * np.sqrt(seen)[:, None]).T @ (lift * np.sqrt(seen)[:, None]))
    embed = lift @ directions[:, ::-1][:, : WIDTH - 1]
    embed /= np.sqrt((embed**2 * seen[:, None]).sum() / max(1.0, seen.sum()) / WIDTH) + 1e-6
    embed += np.random.default_rng(5).normal(0, OWN_MARK, embed.shape)
    embed = np.column_stack([embed, np.ones(len(embed))])
    insides = np.where(u.class_of < OWN_CLASS, 0, insides)
    by_class = np.stack([np.bincount(u.class_of, weights=row, minlength=CLASSES) for row in insides])
    inside = (insides + INSIDE * u.share) / (by_class[:, u.class_of] + INSIDE)
    return Tables(*(x.astype(np.float32) for x in (embed, np.log(chance), np.log(inside))))


#: Query, key and value of an embedding; a weight for each distance; classes from what is attended to.
SHAPES = {"query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH - 1), "near": (1, REACH), "out": (WIDTH, CLASSES)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unflattened(flat: np.ndarray) -> dict[str, np.ndarray]:
    parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1])
    return {k: part.reshape(s) for (k, s), part in zip(SHAPES.items(), parts)}


#: Distance of each of a window's places (rows) from the place that asks (columns), and where it lies behind.
_DISTANCE = np.arange(STRIDE - 1, REACH)[None, :] - np.arange(REACH)[:, None]
_BEFORE = np.maximum(_DISTANCE, 0)
_MASK = np.where(_DISTANCE < 0, np.float32(-1e9), np.float32(0))


def start() -> dict[str, np.ndarray]:
    """A model that predicts classes by their successor counts alone; training adds attention to it."""
    rng = np.random.default_rng(7)
    p = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    for k in ("query", "key", "value"):
        p[k][:] = rng.normal(0, 0.3 * WIDTH**-0.5, SHAPES[k])
    p["value"] += np.eye(*SHAPES["value"], dtype=np.float32)
    p["near"][:] = -0.2 * np.arange(REACH)
    return p


Parts = tuple[np.ndarray, np.ndarray, np.ndarray]


def parts_of(p: dict[str, np.ndarray], x: np.ndarray) -> Parts:
    """Query of embeddings through the key's weights, and twice the embeddings, which stand for keys and values.

    A query meets the key of x where the query through the key's weights meets x itself. Values
    are averaged, so embeddings can be averaged and then take the value's weights once. The
    embeddings' last column is 1 and adds up weights.
    """
    return x @ (p["query"] @ p["key"].T * x.dtype.type(WIDTH**-0.5)), x, x


def value_of(p: dict[str, np.ndarray]) -> np.ndarray:
    """What takes averaged embeddings to averaged values, beside which their last column stays."""
    return np.hstack([p["value"], np.eye(WIDTH, dtype=p["value"].dtype)[:, -1:]])


def windows(line: np.ndarray) -> np.ndarray:
    """Overlapping windows over the rows of ``line`` (whole strides), as a view: windows x REACH x columns."""
    step, item = line.strides
    return np.lib.stride_tricks.as_strided(line, (len(line) // STRIDE - 1, REACH, line.shape[1]), (STRIDE * step, step, item), writeable=False)


def forward(p: dict[str, np.ndarray], parts: Parts, known: np.ndarray) -> dict[str, np.ndarray]:
    """Class scores behind each place of a line but those of its first stride.

    ``parts`` are those of ``parts_of``: the first of the places that ask, the others of all
    places; ``known`` are the successor log probabilities of the places that ask. Attention
    scores are kept transposed: places by place that asks.
    """
    q = parts[0].reshape(-1, STRIDE, WIDTH)
    k, v = windows(parts[1]), windows(parts[2])
    a = k @ q.transpose(0, 2, 1)
    a += p["near"][0][_BEFORE] + _MASK
    if a.max() > 60:
        a -= np.maximum(a.max(axis=1, keepdims=True), 0)
    np.exp(a, out=a)
    o = (a.transpose(0, 2, 1) @ v).reshape(-1, WIDTH)
    total = o[:, -1:].copy()
    o /= total  # its last column is 1 and meets the bias
    out = value_of(p) @ p["out"]
    scores = o @ out
    scores += known
    return {"k": k, "v": v, "a": a, "o": o, "total": total, "out": out, "scores": scores}


def chances(scores: np.ndarray) -> np.ndarray:
    """Exponentials of scores, in place, and their sums; of shifted ones where they would overflow."""
    if scores.max() > 60:
        scores -= np.maximum(scores.max(axis=1, keepdims=True) - 60, 0)
    np.exp(scores, out=scores)
    return scores @ np.ones(CLASSES, scores.dtype)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, known: np.ndarray, target: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean loss over the places where ``real``; ``x`` are the embeddings of a line, ``target`` the next classes."""
    asking = x[STRIDE - 1 : -1]
    q, k, v = parts_of(p, asking)[0], x, x
    f = forward(p, (q, k, v), known)
    d, o, n = f["scores"], f["o"], len(x) // STRIDE - 1
    total = chances(d)
    # exponentials less their sum at the target; the factor that makes them gradients goes to the narrower side of a product
    d.reshape(-1)[np.arange(0, d.size, CLASSES) + target] -= total
    factor = (real / (total * total.dtype.type(max(1, np.count_nonzero(real)))))[:, None].astype(d.dtype)
    both = (o * factor).T @ d  # gradient of value and out multiplied
    g = {"out": value_of(p).T @ both, "value": (both @ p["out"].T)[:, :-1]}
    do = d @ f["out"].T
    do *= factor / f["total"]
    do[:, -1] -= np.einsum("nd,nd->n", do, o)  # meets the ones that add up weights
    da = f["v"] @ do.reshape(n, STRIDE, WIDTH).transpose(0, 2, 1)
    da *= f["a"]
    both = asking.T @ (da.transpose(0, 2, 1) @ f["k"]).reshape(-1, WIDTH) * x.dtype.type(WIDTH**-0.5)  # of query and key multiplied
    g["query"], g["key"] = both @ p["key"], both.T @ p["query"]
    near = np.ones(n, da.dtype) @ da.reshape(n, -1)
    g["near"] = np.bincount(_BEFORE.ravel(), weights=near, minlength=REACH).astype(da.dtype)[None]
    return g


class Adam:
    """Steps of decreasing size along the gradients' running mean over their running scale."""

    def __init__(self, rate: float):
        self.rate, self.t = rate, 0
        self.mean, self.square = (np.zeros(SIZE, np.float32) for _ in range(2))

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        now = np.concatenate([g[k].ravel() for k in SHAPES])
        self.mean += np.float32(0.1) * (now - self.mean)
        self.square += np.float32(0.02) * (now * now - self.square)
        size = self.rate / (1 + self.t / 200) ** 0.5 * (1 - 0.98**self.t) ** 0.5 / (1 - 0.9**self.t)
        back = np.float32(size) * self.mean / (np.sqrt(self.square) + np.float32(1e-8))
        for k, part in unflattened(back).items():
            p[k] -= part


def in_line(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Input rows of all texts one after the other, each behind a stride of row 0 and filled up to whole strides; where texts begin."""
    lengths = np.array([STRIDE + len(t) + -len(t) % STRIDE for t in texts], np.int64)
    begins = np.append(0, np.cumsum(lengths))
    rows = np.zeros(begins[-1], np.int32)
    for at, text in zip(begins.tolist(), texts):
        rows[at + STRIDE : at + STRIDE + len(text)] = text
        rows[at + STRIDE : at + STRIDE + len(text)] += 1
    return rows, begins[:-1]


def batches_of(rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a line of BATCH windows at most: the places predicted, the part's input rows, those of the places that ask, which are real."""
    for at in range(0, len(rows) - STRIDE, BATCH * STRIDE):
        part = rows[at : at + (BATCH + 1) * STRIDE]
        yield slice(at + STRIDE, at + len(part)), part, part[STRIDE - 1 : -1], part[STRIDE:] > 0


def log_probabilities(
    p: dict[str, np.ndarray], texts: list[np.ndarray], u: Units, t: Tables, weights: np.ndarray = MIXTURES[-1:], parts: Parts | None = None
) -> np.ndarray:
    """log10 probability of each text (rows) under the model mixed with the unigram by each weight (columns).

    ``parts`` are those of all input rows, if they are at hand.
    """
    rows, begins = in_line(texts)
    q = parts_of(p, t.embed)[0] if parts is None else parts[0]
    class_before = np.append(CLASSES, u.class_of)
    line = np.zeros((len(rows), len(weights)))
    for to, part, asking, real in batches_of(rows):
        x = t.embed.take(part, axis=0)
        scores = forward(p, (q.take(asking, axis=0), x, x), t.successor.take(asking, axis=0))["scores"]
        ids = np.maximum(part[STRIDE:] - 1, 0)
        target = u.class_of.take(ids)
        total = chances(scores)
        chance = scores.reshape(-1).take(np.arange(0, scores.size, CLASSES) + target) / total
        shared = np.flatnonzero(target >= OWN_CLASS)  # other ids are alone in their class
        inside = np.zeros(len(ids))
        inside[shared] = t.inside.reshape(-1).take(class_before.take(asking[shared]) * VOCABULARY + ids[shared])
        for j, w in enumerate(weights):
            line[to, j] = (np.log(w * chance + (1 - w) * u.mass[target]) + inside) * real
    return np.add.reduceat(line, begins, axis=0) / np.log(10) if len(texts) else np.zeros((0, len(weights)))


def train_on(p: dict[str, np.ndarray], texts: list[np.ndarray], u: Units, t: Tables, steps: Adam) -> int:
    """Train ``p`` on every token of the texts once; how many there are."""
    rows, _ = in_line(texts)
    for _, part, asking, real in batches_of(rows):
        target = u.class_of[np.maximum(part[STRIDE:] - 1, 0)]
        steps.step(p, gradients(p, t.embed.take(part, axis=0), t.successor.take(asking, axis=0), target, real))
    return sum(map(len, texts))


def lines(batches: Iterator[pa.RecordBatch], line: int = LINE) -> Iterator[list[np.ndarray]]:
    """The ids of texts, about ``line`` at a time."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for blob in batch.column("ids"):
            held.append(np.frombuffer(blob.as_buffer(), "<u2"))
            size += len(held[-1])
            if size >= line:
                yield held
                held, size = [], 0
    if held:
        yield held


# ---------------------------------------------------------------- the corpus's counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words of ``texts`` and one end for each, by the word's hash.

    A task adds up about COUNTED words before it passes counts on, so a common word is one row for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

        for batch in batches:
            for hashes, first in hashed_words(batch.column("text")):
                held += [hashes, np.full(len(first) - 1, END_WORD)]
                size += len(hashes) + len(first) - 1
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return with_texts(texts.select("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def head_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and their counts: all down to a count, HEAD_WORDS at most."""
    held, least = 0, None
    for c, n in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        held += n
        if held > HEAD_WORDS:
            break
        least = c
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = counts.where(F.col("c") >= least).toArrow()
    words = rows.column("word").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], rows.column("c").to_numpy()[order].astype(np.float64)


def read_once(docs: DataFrame, head: tuple[np.ndarray, np.ndarray], total: int, distinct: int) -> DataFrame:
    """What scoring needs of each text: its ids and their end, its sums over head words, its other words with counts."""
    shared = docs.sparkSession.sparkContext.broadcast(head)
    below = total + 0.5 * (distinct + 1)
    names = ("doc_id", "rid", "learn", "held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = shared.value
        logs = np.append(np.log10((counts + 0.5) / below), 0.0)

        def look_up(hashes: np.ndarray) -> np.ndarray:
            """Places among the head words; the one behind them for others."""
            at = np.minimum(np.searchsorted(words, hashes), max(0, len(words) - 1))
            return np.where(words[at] == hashes, at, len(words)) if len(words) else np.zeros(len(hashes), np.int64)

        (end,) = look_up(np.array([END_WORD]))
        for batch in batches:
            done = 0
            for part in encoder(lower=True)(batch.column("text")):
                n = len(part.first) - 1
                at = look_up(part.words)[part.inverse]
                known, sums = (np.append(0, np.cumsum(x)) for x in (at < len(words), logs[at]))
                per_text = [s[part.first[1:]] - s[part.first[:-1]] for s in (known, sums)]
                text, other = np.repeat(np.arange(n), np.diff(part.first)), part.words[part.inverse]
                text, other = text[at == len(words)], other[at == len(words)]
                if end == len(words):
                    text, other = np.append(text, np.arange(n)), np.append(other, np.full(n, END_WORD))
                order = np.lexsort((other, text))
                text, other = text[order], other[order]
                opens = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.append(True, other[1:] != other[:-1])[: len(other)]))
                listed = pa.array(np.searchsorted(text[opens], np.arange(n + 1)), pa.int32())
                times = np.diff(np.append(opens, len(text)))
                ids = np.empty(len(part.ids) + n, "<u2")
                ends = part.bounds[1:] + np.arange(n)
                ids[ends] = END
                ids[np.arange(len(part.ids)) + np.repeat(np.arange(n), np.diff(part.bounds))] = part.ids
                cuts = pa.py_buffer(np.append(0, 2 * (ends + 1)).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(done, n) for c in names),
                        pa.array(np.diff(part.first) + 1, pa.int64()),
                        pa.array(per_text[0] + (end < len(words)), pa.int64()),
                        pa.array(per_text[1] + logs[end], pa.float64()),
                        pa.ListArray.from_arrays(listed, pa.array(other[opens].view(np.int64))),
                        pa.ListArray.from_arrays(listed, pa.array(times, pa.int64())),
                        pa.Array.from_buffers(pa.binary(), n, [None, cuts, pa.py_buffer(ids.tobytes())]),
                    ],
                    [*names, "n_tokens", "known", "base", "rare", "times", "ids"],
                )
                done += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_texts(docs).mapInArrow(
        run,
        f"doc_id {kind}, rid long, learn boolean, held_out boolean, n_tokens long, known long, base double, "
        "rare array<long>, times array<long>, ids binary",
    )


def summed(texts: DataFrame, cells: int, places: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each of ``cells`` cells is met; ``places`` gives the cells of some lines of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int32)
        for held in lines(batches, COUNTED):
            counts += np.bincount(places(in_line(held)[0]), minlength=cells).astype(np.int32)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found].astype(np.int64))], ["at", "n"])

    rows = texts.select("ids").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out


def successor_tables(texts: DataFrame, u: Units) -> Tables:
    """Tables from all pairs of neighbours in the texts."""
    first = INPUTS * CLASSES
    class_before = np.append(CLASSES, u.class_of).astype(np.int32)
    class_of = u.class_of.astype(np.int32)

    def places(rows: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(rows[1:]) + 1
        before, ids = rows[at - 1], rows[at] - 1
        target = class_of[ids]
        shared = target >= OWN_CLASS  # other ids are alone in their class
        return np.append(before * CLASSES + target, first + class_before[before[shared]] * VOCABULARY + ids[shared])

    counts = summed(texts, first + (CLASSES + 1) * VOCABULARY, places)
    return tables(u, counts[:first].reshape(INPUTS, CLASSES), counts[first:].reshape(CLASSES + 1, VOCABULARY))


def train_round(texts: DataFrame, model: dict[str, np.ndarray], shared: Broadcast, rate: float) -> dict[str, np.ndarray]:
    """The mean, by tokens, of what each task makes of ``model`` over its share of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, t = shared.value
        own, steps = {k: v.copy() for k, v in model.items()}, Adam(rate)
        size = sum(train_on(own, held, u, t, steps) for held in lines(batches))
        flat = np.concatenate([own[k].ravel() for k in SHAPES]).astype(np.float64)
        if size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * size), pa.array(np.full(len(flat), size))], ["at", "value", "size"]
            )

    rows = (
        texts.select("ids").mapInArrow(run, "at int, value double, size long")
        .groupBy("at").agg((F.sum("value") / F.sum("size")).alias("value"))
        .toArrow()
    )
    if not rows.num_rows:
        return model
    flat = np.empty(rows.num_rows, np.float32)
    flat[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return unflattened(flat)


def judge(texts: DataFrame, model: dict[str, np.ndarray], shared: Broadcast) -> np.ndarray:
    """Mean log10 probability of a token, for each of MIXTURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, t = shared.value
        parts = parts_of(model, t.embed)
        for held in lines(batches):
            total = log_probabilities(model, held, u, t, MIXTURES, parts).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), sum(map(len, held))))], ["at", "value", "size"]
            )

    rows = (
        texts.select("ids").mapInArrow(run, "at int, value double, size long")
        .groupBy("at").agg((F.sum("value") / F.sum("size")).alias("value"))
        .toArrow()
    )
    out = np.zeros(len(MIXTURES))
    out[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return out


def train(texts: DataFrame, u: Units, tokens: int) -> tuple[Broadcast, dict[str, np.ndarray], float]:
    """Units and tables (shared), attention weights, and the model's weight in the mixture.

    Every token of the training texts but those held back is trained on in the first ROUNDS
    rounds; further rounds follow while one gains GAIN on the texts held back. Of the models
    after each round and of the untrained one, and of MIXTURES, those best on these texts are taken.
    """
    held_back = F.pmod("rid", F.lit(HELD_BACK)) == 0
    validation = cut(texts.where(held_back).select("ids"))
    if validation.isEmpty():
        validation, held_back = cut(texts.select("ids")), F.lit(False)
    rest = texts.where(~held_back)
    shared = texts.sparkSession.sparkContext.broadcast((u, successor_tables(rest, u)))
    rest = rest.coalesce(max(1, tokens // (ROUNDS * SHARE)))
    part = F.pmod(F.xxhash64("rid"), F.lit(ROUNDS))
    model = start()
    found = judge(validation, model, shared)
    best, before = (found.max(), model, float(MIXTURES[found.argmax()])), found.max()
    for k in range(ROUNDS * PASSES if tokens else 0):
        model = train_round(rest.where(part == k % ROUNDS), model, shared, 0.03 / (1 + k) ** 0.5)
        found = judge(validation, model, shared)
        if found.max() > best[0]:
            best = (found.max(), model, float(MIXTURES[found.argmax()]))
        if k + 1 >= ROUNDS and found.max() < before + GAIN:
            break
        before = found.max()
    return shared, *best[1:]


def score_language_model(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by a unigram base and by a causal self-attention model.

    Words are runs of non-blank characters with A-Z in lower case, closed by one end token.
    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over a text's tokens, with counts
    over all rows where ``learn`` holds. ``score`` is the log10 probability that the attention
    model gives to the text's subword ids and their end: that of the id's class, by the counted
    successors of the id before and by attention over the ids before, mixed with the unigram,
    times that of the id inside its class after an id of the class before. Windows overlap and
    score each token once.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row per
    input row. NULL and empty texts are the end alone. Rows with a NULL id are scored; they
    are neither learned from nor held out. Other columns are ignored, whatever their names; an
    empty table gives an empty result; without training rows all words are unknown and the
    model is as it starts. Repeated rows are scored, and learned from, each.

    Counts cover all training rows. Frequent words' counts, up to HEAD_WORDS, go to the
    executors; other words are joined by their hash. Texts are encoded once, and the ids
    written to the shared folder serve the id counts, the training and the scores. The driver
    holds counts of ids and neighbours, and the model, all of fixed size.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    counts = cut(word_counts(source.where("learn")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    read = cut(read_once(source, head_of(counts), total, distinct))
    training = read.where("learn")
    of_ids = summed(training, INPUTS, lambda rows: rows[rows > 0])[1:]
    shared, model, weight = train(training, units(of_ids), int(of_ids.sum()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, t = shared.value
        parts = parts_of(model, t.embed)
        names = ["doc_id", "rid", "held_out", "n_tokens", "known", "base"]
        for batch in batches:
            sums = [log_probabilities(model, held, u, t, np.array([weight]), parts)[:, 0] for held in lines(iter([batch]))]
            values = pa.array(np.concatenate([*sums, np.zeros(0)]), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], [*names, "score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = read.select("doc_id", "rid", "held_out", "n_tokens", "known", "base", "ids").mapInArrow(
        score, f"doc_id {kind}, rid long, held_out boolean, n_tokens long, known long, base double, score double"
    )
    c = F.coalesce("c", F.lit(0))
    rare = (
        read.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w"))
        .select("rid", F.col("w.rare").alias("word"), F.col("w.times").alias("n"))
        .distinct()
        .join(counts, "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1)))).alias("more_base"),
        )
    )
    return scored.join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
