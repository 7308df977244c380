"""Toxicity: a counterfactual-regularised linear classifier over words and word stems."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

#: Identity terms by group; a term may be swapped for any other of its group.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled"),
)
#: Terms learned besides: of the LEARNED most frequent words that COMMON of the sampled documents hold
#: and that go with neither label, those that are each other's nearest by the words around them.
#: There are no more than one such word for PER_TERM sampled documents of label 1, as each gets a weight.
LEARNED, COMMON, PER_TERM = 256, 0.02, 20
#: Tasks that count which of these words stand beside which.
COUNTERS = 4

Swaps = dict[str, tuple[str, ...]]


def swaps_of(groups: Iterable[Sequence[str]]) -> Swaps:
    """For each term the others of its group."""
    return {term: tuple(t for t in group if t != term) for group in groups for term in group}


SWAPS = swaps_of(IDENTITY_TERMS)

#: A document's words: runs of letters, digits and marks.
WORD = re.compile(r"\w+")
#: Stems are a word's first characters, of these lengths.
STEMS = (4, 5, 6, 7)
#: A feature that so many different words share counts once more.
SHARED = (2, 4)
BUCKETS = 1 << 21


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(word: str, swaps: Swaps = SWAPS) -> list[int]:
    """Hashed features of one lower-case word: itself and its stems; terms that can be swapped have no stems."""
    if word in swaps:
        return [bucket(f"={word}")]
    return [bucket(f"={word}"), *(bucket(f"^{word[:n]}") for n in STEMS if len(word) > n)]


def document_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swapped(words: set[str], swaps: Swaps = SWAPS) -> set[str] | None:
    """The counterfactual: every term becomes another of its group. None without any."""
    if words.isdisjoint(swaps):
        return None
    return {swaps[w][zlib.crc32(w.encode()) % len(swaps[w])] if w in swaps else w for w in words}


def lifted(feature: int, times: int) -> int:
    """The feature that at least ``times`` different words of a document share ``feature``."""
    return (feature * 0x9E3779B1 + times) % BUCKETS


def levels(counts: Counter[int]) -> set[int]:
    """Features of a document from the number of its words with each feature."""
    found = set(counts)
    found.update(lifted(f, times) for f, n in counts.items() for times in SHARED if n >= times)
    return found


def feature_set(words: set[str], swaps: Swaps = SWAPS) -> list[int]:
    return sorted(levels(Counter(f for word in words for f in word_features(word, swaps))))


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # features with a weight, ascending
    weights: np.ndarray
    bias: float
    swaps: Swaps = field(default_factory=lambda: SWAPS)

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts; remembers which words carry weight, so that most words cost one lookup."""

    REMEMBER = 500_000

    def __init__(self, model: Model):
        self.weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
        self.bias, self.swaps = model.bias, model.swaps
        self.seen: dict[str, tuple[int, ...]] = {}

    def active(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= self.REMEMBER:
                self.seen.clear()
            found = self.seen[word] = tuple(
                f for f in word_features(word, self.swaps) if f in self.weight or any(lifted(f, t) in self.weight for t in SHARED)
            )
        return found

    def score(self, text: str | None) -> float:
        counts: Counter[int] = Counter()
        for word in document_words(text):
            if found := self.active(word):
                counts.update(found)
        logit = self.bias + sum(self.weight.get(f, 0.0) for f in sorted(levels(counts)))
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(
    documents: list[np.ndarray],
    counterfactuals: list[np.ndarray | None],
    labels: np.ndarray,
    swaps: Swaps = SWAPS,
    penalty: float = 4.0,
    min_docs: int = 5,
    evidence: float = 16.0,
    decay: float = 1e-3,
    rounds: int = 400,
) -> Model:
    """Logistic regression on features that go with the label, plus a counterfactual penalty.

    The loss is the mean log loss, each class weighing half, plus ``penalty`` times the mean
    squared change of the logit when identity terms are swapped, plus weight decay. A feature
    gets a weight if at least ``min_docs`` of the documents hold it and label 1 is so frequent
    among them that chance would do it once in exp(``evidence``) features (by Chernoff's
    bound); features of terms in ``swaps`` always do, so that the penalty acts on them.
    """
    n = len(labels)
    positive, total = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for features, label in zip(documents, labels):
        total[features] += 1
        if label:
            positive[features] += 1
    n1 = max(1, int(labels.sum()))
    n0 = max(1, n - n1)
    often = np.flatnonzero(total >= min_docs)
    base = n1 / (n1 + n0)
    telling = (positive[often] > base * total[often]) & (surprise(positive[often], total[often], base) >= evidence)
    terms = np.unique([bucket(f"={t}") for t in swaps])
    buckets = np.union1d(often[telling], terms[total[terms] > 0])
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))

    def sparse(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = [place[s][place[s] >= 0] for s in sets]
        return np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate([*kept, np.zeros(0, np.int32)])

    rows, cols = sparse(documents)
    pairs = [i for i, c in enumerate(counterfactuals) if c is not None]
    rows_a, cols_a = sparse([documents[i] for i in pairs])
    rows_b, cols_b = sparse([counterfactuals[i] for i in pairs])
    weight = np.where(labels, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(buckets)), -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        logits = b + np.bincount(rows, weights=w[cols], minlength=n)
        error = (1 / (1 + np.exp(-logits)) - labels) * weight
        grad = np.bincount(cols, weights=error[rows], minlength=len(w)) + decay * w / max(1, len(w)) ** 0.5
        if pairs:
            change = np.bincount(rows_a, weights=w[cols_a], minlength=len(pairs)) - np.bincount(
                rows_b, weights=w[cols_b], minlength=len(pairs)
            )
            pull = 2 * penalty * change / len(pairs)
            grad = (
                grad
                + np.bincount(cols_a, weights=pull[rows_a], minlength=len(w))
                - np.bincount(cols_b, weights=pull[rows_b], minlength=len(w))
            )
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model(buckets, w, float(b), swaps)


def training_ids(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those with the smallest hash; one label for each id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = [known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_class) for label in (0, 1)]
    return cut(picked[0].unionByName(picked[1]))


def surprise(positive: np.ndarray, total: np.ndarray, base: float) -> np.ndarray:
    """Chernoff's exponent for so many positives among so many draws at the rate ``base``."""
    share = np.clip(positive / total, 1e-9, 1 - 1e-9)
    return total * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))


def learned_groups(sample: DataFrame, evidence: float = 8.0) -> list[tuple[str, str]]:
    """Pairs of words of the sampled documents (text, toxic) that stand for one another.

    Candidates are frequent words without a link to the label: chance would do what they show
    more often than once in exp(``evidence``) words. Two of them make a pair if each one's
    counts beside all other candidates are most like the other's. The driver sees the counts of
    words that COMMON of the documents hold, and LEARNED x LEARNED counts.
    """
    said = map_texts(sample, lambda texts: {"words": [sorted(document_words(t)) for t in texts]}, "words array<string>", carry=["toxic"])
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n1 < n:
        return []
    counts = (
        said.select(F.explode("words").alias("word"), "toxic")
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
        .where(F.col("n") >= max(5, COMMON * n))
        .toPandas()
        .sort_values(["n", "word"], ascending=[False, True])
    )
    neutral = counts[surprise(counts.n1.to_numpy(), counts.n.to_numpy(), n1 / n) < evidence].head(min(LEARNED, int(n1) // PER_TERM))
    terms = neutral.word.tolist()
    place = {word: i for i, word in enumerate(terms)}

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((len(terms), len(terms)), np.int64)
        for batch in batches:
            for words in batch.column("words").to_pylist():
                own = [place[w] for w in words if w in place]
                met[np.ix_(own, own)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(met.size)), pa.array(met.ravel())], ["at", "n"])

    # the sample is bounded, so a few tasks count it, and the cells of each are few rows
    rows = said.select("words").coalesce(COUNTERS).mapInArrow(beside, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    met = np.zeros(len(terms) ** 2)
    met[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    met = met.reshape(len(terms), len(terms))
    np.fill_diagonal(met, 0)
    shape = met / np.maximum(np.sqrt((met**2).sum(axis=1, keepdims=True)), 1e-9)
    alike = shape @ shape.T
    np.fill_diagonal(alike, -1)
    nearest = alike.argmax(axis=1) if len(terms) else np.zeros(0, np.int64)
    return [(terms[i], terms[j]) for i, j in enumerate(nearest) if i < j and nearest[j] == i]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, groups: Iterable[Sequence[str]] | None = None, penalty: float = 4.0) -> Model:
    """Fit on the texts of (doc_id, text) that (doc_id, toxic) labels.

    ``groups`` are the terms that may be swapped for one another; by default those of
    IDENTITY_TERMS and those that the sample itself shows (:func:`learned_groups`).
    ``per_class`` bounds the sample of labelled ids of each class; which ids are in it depends
    on their hash alone. The sample of ids is what is broadcast, so the documents are read
    where they lie and only the sample's features move. An id with both labels counts as
    toxic; all rows of a sampled id are learned from; other columns are ignored; without
    labelled rows the model is its prior.
    """

    def features(texts: list[str | None]) -> dict[str, list]:
        words = [document_words(t) for t in texts]
        others = [swapped(w, swaps) for w in words]
        return {
            "own": [np.array(feature_set(w, swaps), np.int32).tobytes() for w in words],
            "other": [None if o is None else np.array(feature_set(o, swaps), np.int32).tobytes() for o in others],
        }

    # at most 2 x per_class narrow rows are broadcast
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(training_ids(labels, per_class)), "doc_id"))
    swaps = swaps_of([*IDENTITY_TERMS, *learned_groups(sample)] if groups is None else groups)
    rows = map_texts(sample, features, "own binary, other binary", carry=["toxic"]).toArrow().sort_by([("doc_id", "ascending")])
    if not rows.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), -2.0, swaps)
    own = [np.frombuffer(b.as_buffer(), np.int32) for b in rows.column("own")]
    other = [np.frombuffer(b.as_buffer(), np.int32) if b.is_valid else None for b in rows.column("other")]
    return fit(own, other, rows.column("toxic").to_numpy().astype(np.int64), swaps, penalty)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every whole text.

    One row per input row, repeated rows and an empty table included; NULL and empty texts
    get the model's prior; long texts are read whole. Other columns are ignored, whatever
    their names. The model goes to the executors with the task: its size is bounded by the
    features that the sample supports.
    """
    holder: list[Scorer] = []

    def scores(texts: list[str | None]) -> dict[str, list]:
        if not holder:
            holder.append(model.scorer())
        values = [holder[0].score(t) for t in texts]
        return {"score": values, "predicted": np.array([v >= 0.5 for v in values], np.int32)}

    return map_texts(docs, scores, "score double, predicted int")
