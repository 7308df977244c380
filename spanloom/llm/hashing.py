"""64-bit hashes of words and shingles, over whole Arrow columns of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
CHUNK = 1 << 20

#: Bytes between words: white space; or all of ASCII but letters, digits and the underscore.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.array([b < 128 and not (chr(b).isalnum() or b == 0x5F) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = BLANK, same: np.ndarray = _LOWER) -> tuple[np.ndarray, ...]:
    """All words of the texts ``data[bounds[i]:bounds[i + 1]]``: hashes, where they begin and end, and each text's first word.

    Bytes with one value in ``same`` count as equal.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(bounds), np.int64)
    inside = ~between[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    starts, stops = bounds[:-1][bounds[:-1] < len(data)], bounds[1:][bounds[1:] > 0] - 1
    opens[starts], closes[stops] = inside[starts], inside[stops]
    begins, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(begins):
        return np.zeros(0, np.uint64), begins, ends, np.zeros(len(bounds), np.int64)
    # all bytes from the first word on are added up; those between words count nothing, whatever their place
    kept, value = data[begins[0] :], np.where(between, np.uint64(0), _BYTE[same])
    place = np.arange(len(kept)) - np.repeat(begins - begins[0], np.diff(np.append(begins, len(data))))
    longest = int((ends - begins).max())
    np.minimum(place, longest - 1, out=place)
    weight = mix((np.arange(longest, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
    terms = value[kept]
    terms *= (weight | np.uint64(1))[place]
    return mix(np.add.reduceat(terms, begins - begins[0])), begins, ends, np.searchsorted(begins, bounds)


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and bounds of about CHUNK bytes of texts at a time, one text at least; NULL is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
        own = bounds[at : to + 1]
        yield data[own[0] : own[-1]], own - own[0]
        at = to


def hashed_words(texts: pa.Array, between: np.ndarray = BLANK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk by chunk: hashes of all words, and where each text's words begin (one more than texts)."""
    for data, bounds in chunks(texts):
        hashes, _, _, first = words_of(data, bounds, between)
        yield hashes, first


def factors(words: int) -> np.ndarray:
    return mix(np.arange(11, 11 + words, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of every run of ``words`` words."""
    total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k, factor in enumerate(factors(words)):
        total += hashes[k : len(total) + k] * factor
    return mix(total)
