"""Language ID: each text as a mixture of languages, by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, slices, tidy, with_texts

#: Character n-grams are hashed into this many cells.
CELLS = 1 << 15
#: The n-gram's length in characters.
N = 3


def grams(text: str) -> np.ndarray:
    """Cells of all character n-grams of the lower-cased text, digits and marks as one character."""
    plain = "  " + text.lower() + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint32)
    letters = np.where((codes < 128) & ((codes < 97) | (codes > 122)), 32, codes)
    mixed = letters[:-2] * np.uint32(0x9E3779B1) + letters[1:-1] * np.uint32(0x85EBCA77) + letters[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    cells = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    return cells[(letters[1:-1] != 32) | (letters[2:] != 32)]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a text and their counts."""
    cells = grams(text)
    if len(cells) > CELLS // 8:
        counts = np.bincount(cells, minlength=CELLS)
        found = np.flatnonzero(counts)
        return found, counts[found].astype(np.float64)
    found, counts = np.unique(cells, return_counts=True)
    return found, counts.astype(np.float64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # CELLS x languages, columns sum to 1


def mixture(chances: np.ndarray, counts: np.ndarray, members: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of ``members`` by EM, and the log likelihood."""
    own = chances[:, members]
    share = np.full(len(members), 1 / len(members))
    total = counts.sum()
    for _ in range(rounds):
        joint = own * share
        mass = joint.sum(axis=1)
        share = (counts / mass) @ joint / total
    return share, float(counts @ np.log(own @ share))


def infer(text: str, model: LanguageModel, rounds: int = 12) -> dict[str, float]:
    """Proportions of the languages in ``text``, for the set with the best penalised likelihood.

    Each language costs half the log of the number of n-grams (BIC) and has to explain five
    n-grams in a hundred. The set grows from the best single language, one language at a
    time, as long as the penalised likelihood does. Where even the mixture of all languages
    gains less than one language's cost, the single language is it.
    """
    cells, counts = bag(text)
    if not len(cells):
        return {}
    chances = model.likelihood[cells]
    alone = counts @ np.log(chances)
    best = int(np.argmax(alone))
    total = counts.sum()
    cost = 0.5 * np.log(total) + 0.05 * total
    members, share, value = np.array([best]), np.ones(1), float(alone[best])
    everything = np.arange(len(model.languages))
    if len(everything) > 1 and mixture(chances, counts, everything, rounds)[1] - value > cost:
        while len(members) < len(everything):
            tried = [
                (*mixture(chances, counts, np.append(members, k), rounds)[::-1], k) for k in everything if k not in members
            ]
            new_value, new_share, k = max(tried, key=lambda x: x[0])
            if new_value - value <= cost:
                break
            members, share, value = np.append(members, k), new_share, new_value
    return {model.languages[k]: float(p) for k, p in zip(members, share)}


def train(labelled: DataFrame) -> LanguageModel:
    """n-gram likelihoods of each language from all of (text, lang); rows without either are left out.

    Every task counts its own texts into one array for each language; Spark adds the counts
    by (language, cell). What reaches the driver is languages x CELLS at most. Repeated rows
    count each; other columns are ignored; an empty table gives the one language 'und'.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for part in (part for batch in batches for part in slices(batch, "text")):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                own = tables.setdefault(lang, np.zeros(CELLS, np.int64))
                cells = grams(text)
                if len(cells) > CELLS // 4:
                    own += np.bincount(cells, minlength=CELLS)
                else:
                    np.add.at(own, cells, 1)
        for lang, own in tables.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(own[cells])],
                ["lang", "cell", "n"],
            )

    rows = (
        with_texts(labelled.select("lang", "text"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(tidy(count), "lang string, cell int, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = tuple(sorted(set(rows.column("lang").to_pylist())))
    counts = np.full((CELLS, max(1, len(languages))), 0.05)
    if languages:
        place = {lang: i for i, lang in enumerate(languages)}
        column = np.array([place[x] for x in rows.column("lang").to_pylist()])
        counts[rows.column("cell").to_numpy(), column] += rows.column("n").to_numpy()
    return LanguageModel(languages or ("und",), counts / counts.sum(axis=0))


def identify(docs: DataFrame, model: LanguageModel, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and the whole mixture of every text.

    ``lang_pred`` is the language with the largest proportion and ``score`` that proportion;
    a text that is NULL or holds no letter gets 'und' and 0. Of equal proportions the first
    name counts. ``mixture`` lists language:share of the chosen set, largest first. One row
    per input row, repeated rows and an empty table included; ``carry`` columns pass, under
    other names than the three results; other columns are ignored, whatever their names.
    """

    def predict(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {"lang_pred": [], "score": [], "mixture": []}
        for text in texts:
            found = infer(text, model) if has_letter(text) else {}
            ranked = sorted(found.items(), key=lambda x: (-x[1], x[0])) or [("und", 0.0)]
            out["lang_pred"].append(ranked[0][0])
            out["score"].append(min(1.0, max(0.0, ranked[0][1])))
            out["mixture"].append(",".join(f"{k}:{p:.4f}" for k, p in ranked))
        return out

    return map_texts(docs, predict, "lang_pred string, score double, mixture string", carry=carry or [])
