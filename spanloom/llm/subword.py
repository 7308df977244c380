"""Subword ids of a public byte-level vocabulary, a column of texts at a time."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from .hashing import BLANK, chunks, words_of

#: Words that a Python worker remembers the ids of, at most; of too many the half used most stays.
REMEMBER = 1 << 19
_BLANK, _FEED = 0x20, 0x0A
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AS_IS = np.arange(256, dtype=np.uint8)
#: How a word stands in its text: behind a blank, at the start, or behind a line feed; and what tells their keys apart.
_BEHIND, _START, _NEXT_LINE = 0, 1, 2
_KIND = np.array([0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A], np.uint64)


@cache
def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tiktoken.Encoding:
    """The public vocabulary, read once per Python worker from the installed package."""
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _begins_with_blank() -> np.ndarray:
    return np.array([vocabulary().decode_single_token_bytes(i)[:1] == b" " for i in range(vocabulary().n_vocab)])


def plain_ids(text: str) -> np.ndarray:
    """Ids of a text as the vocabulary gives them."""
    return np.array(vocabulary().encode_ordinary(text), np.uint16)


@dataclass(frozen=True)
class Encoded:
    """Some texts: the ids of text i are ``ids[bounds[i]:bounds[i + 1]]``.

    Their words have hashes ``words[inverse]`` (a hash can stand in ``words`` more than once);
    text i has the words from ``first[i]`` to ``first[i + 1]``.
    """

    ids: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    inverse: np.ndarray
    first: np.ndarray


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where each comes first, and which one each key is."""
    found = pa.array(keys).dictionary_encode()
    inverse = found.indices.to_numpy()
    index = np.empty(len(found.dictionary), np.int64)
    index[inverse[::-1]] = np.arange(len(keys) - 1, -1, -1)
    order = np.argsort(found.dictionary.to_numpy())  # in order they are found sooner
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.dictionary.to_numpy()[order], index[order], rank[inverse]


class Encoder:
    """Encodes each distinct word once and remembers its ids, as the vocabulary gives them for whole texts.

    The vocabulary's pattern joins at most one blank to the word behind it. So in a text whose
    white space is single blanks and line feeds, each word's ids depend on the word and on what
    stands before it alone. Other texts are encoded whole.
    """

    def __init__(self, lower: bool, remember: int = REMEMBER):
        self.same, self.remember = _LOWER if lower else _AS_IS, remember
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Forget all words but the ``keep`` ones used most."""
        if not keep:
            self.keys, self.starts, self.sizes, self.used = np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(3))
            self.pool = np.zeros(0, np.uint16)
            return
        kept = np.sort(np.argsort(-self.used, kind="stable")[:keep])
        starts, sizes = self.starts[kept], self.sizes[kept]
        begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.pool = self.pool[np.repeat(starts - begins, sizes) + np.arange(sizes.sum())]
        self.keys, self.starts, self.sizes, self.used = self.keys[kept], begins, sizes, self.used[kept] // 2

    def learn(self, keys: np.ndarray, kinds: np.ndarray, words: list[bytes]) -> None:
        """Remember the ids of words (bytes): words of one kind are encoded as one text and cut where words begin."""
        if len(self.keys) + len(keys) > self.remember:
            self.forget(min(self.remember // 2, len(self.keys)))
        starts, sizes, pools = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32), [self.pool]
        at = len(self.pool)
        for kind in (_BEHIND, _START, _NEXT_LINE):
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            lead = b" " if kind == _BEHIND else b"\n"
            ids = plain_ids((lead + lead.join(words[i] for i in own)).decode())
            cuts = np.flatnonzero(_begins_with_blank()[ids] if kind == _BEHIND else ids == plain_ids("\n")[0])
            ends = np.append(cuts[1:], len(ids))
            skip = kind == _START
            starts[own], sizes[own] = at + cuts + skip, ends - cuts - skip
            pools.append(ids)
            at += len(ids)
        order = np.argsort(keys)
        among = np.searchsorted(self.keys, keys[order])
        new = (keys, starts, sizes, np.zeros(len(keys), np.int32))
        old = (self.keys, self.starts, self.sizes, self.used)
        self.keys, self.starts, self.sizes, self.used = (np.insert(a, among, b[order]) for a, b in zip(old, new))
        self.pool = np.concatenate(pools)

    def __call__(self, texts: pa.Array) -> Iterator[Encoded]:
        for data, bounds in chunks(texts):
            yield self.chunk(self.same[data], bounds)

    def chunk(self, data: np.ndarray, bounds: np.ndarray) -> Encoded:
        hashes, begins, ends, first = words_of(data, bounds, BLANK, _AS_IS)
        count = np.diff(first)
        text_of = np.repeat(np.arange(len(count)), count)
        before = np.where(begins == bounds[text_of], 0, data[begins - 1]) if len(begins) else begins
        kinds = np.select([before == _BLANK, before == _FEED], [_BEHIND, _NEXT_LINE], _START)
        keys, index, inverse = distinct(hashes ^ _KIND[kinds])
        odd = self.odd(data, bounds)
        apart = {int(i): plain_ids(data[bounds[i] : bounds[i + 1]].tobytes().decode()) for i in np.flatnonzero(odd)}
        usual, place = np.ones(len(keys), bool), index
        if apart:
            own = np.flatnonzero(~odd[text_of])
            usual[:] = False
            usual[inverse[own]] = True
            # a usual text has the word: of its places, one in a usual text
            place = index.copy()
            place[inverse[own]] = own
        at = self.find(keys)
        new = np.flatnonzero((at < 0) & usual)
        if len(new):
            whole = data.tobytes()
            self.learn(keys[new], kinds[place[new]], [whole[b:e] for b, e in zip(begins[place[new]].tolist(), ends[place[new]].tolist())])
            at = self.find(keys)
            if (at[usual] < 0).any():  # what was remembered before had to go
                lost = np.flatnonzero((at < 0) & usual)
                self.learn(keys[lost], kinds[place[lost]], [whole[b:e] for b, e in zip(begins[place[lost]].tolist(), ends[place[lost]].tolist())])
                at = self.find(keys)
        size, start = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        there = at >= 0
        size[there], start[there] = self.sizes[at[there]], self.starts[at[there]]
        self.used[at[there]] += 1
        words = size[inverse]
        if apart:
            words[odd[text_of]] = 0
        so_far = np.append(0, np.cumsum(words))
        last = np.where(np.diff(bounds) > 0, data[np.maximum(bounds[1:] - 1, 0)] if len(data) else 0, 0)
        tail = ((last == _BLANK) | (last == _FEED)) & ~odd
        lengths = np.diff(so_far[first]) + tail
        for i, ids in apart.items():
            lengths[i] = len(ids)
        cuts = np.append(0, np.cumsum(lengths))
        place = np.arange(so_far[-1])
        ids = self.pool[np.repeat(start[inverse] - so_far[:-1], words) + place]
        if len(ids) < cuts[-1]:  # some texts have more ids than their words
            place += np.repeat(cuts[:-1] - so_far[first[:-1]], np.diff(so_far[first]))
            of_words, ids = ids, np.empty(cuts[-1], np.uint16)
            ids[place] = of_words
        blank, feed = (plain_ids(c)[0] for c in " \n")
        ids[cuts[1:][tail] - 1] = np.where(last[tail] == _BLANK, blank, feed)
        for i, own in apart.items():
            ids[cuts[i] : cuts[i + 1]] = own
        return Encoded(ids, cuts, hashes[index], inverse, first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is remembered; -1 if it isn't."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def odd(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts may hold white space other than single blanks and line feeds (ASCII separators and first bytes of others tell)."""
        strange = np.zeros(len(data) + 1, np.int32)
        space = BLANK[data]
        strange[1:] = (space & (data != _BLANK) & (data != _FEED)) | ((data >= 0x1C) & (data <= 0x1F))
        inner = np.flatnonzero(space[1:] & space[:-1]) if len(data) else np.zeros(0, np.int64)
        strange[inner + 1] = 1
        wide = np.flatnonzero((data[:-1] == 0xC2) | ((data[:-1] >= 0xE1) & (data[:-1] <= 0xE3))) if len(data) else inner
        following = data[wide + 1]
        first = data[wide]
        other = (
            ((first == 0xC2) & ((following == 0x85) | (following == 0xA0)))
            | ((first == 0xE1) & (following == 0x9A))
            | ((first == 0xE2) & ((following == 0x80) | (following == 0x81)))
            | ((first == 0xE3) & (following == 0x80))
        )
        strange[wide[other] + 1] = 1
        total = np.cumsum(strange)
        return total[bounds[1:]] > total[bounds[:-1]]


@cache
def encoder(lower: bool) -> Encoder:
    """This Python worker's encoder."""
    return Encoder(lower)
