"""Token counts by a finite-state transducer compiled from a public BPE vocabulary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Code points of a chunk, and of what a chunk's entry state is guessed from.
CHUNK, LOOK_BACK = 256, 32
#: Code points that are worked on at a time.
SEGMENT = 1 << 21
#: States that a Python worker keeps, at most; then it begins with none again.
STATES = 1 << 18
#: How a transition is packed: next state, and emitted tokens + EMIT_ZERO in the low bits.
_BITS, _EMIT_ZERO = 6, 32
_SPACE = "▁"
#: Classes of characters that join nothing: by the tokens they make. The first one stands behind a text's end.
_NONE, _APART = 0, 4


class _Full(Exception):
    """More than STATES states are needed at a time."""


class Transducer:
    """A deterministic transducer for a merge vocabulary, whose transitions carry how many tokens they add.

    A text's encoding is the one sequence of pieces in which each piece and its successor
    encode to themselves. So the last piece of every beginning of the text is known from the
    last pieces of shorter beginnings. A state is the longest suffix read so far that can
    still grow into a piece; with it, for each of its suffixes, the last piece before it and
    how many tokens there were (relative to all so far). A character leads to one next state.
    It may take tokens back, where it joins what were several into one.

    States and transitions are made when they are first met. Entries of ``table`` are -1 till then.
    The vocabulary must not normalise texts but for blanks, which it writes as U+2581, one
    more of them before a text; no piece may hold U+2581 behind another character.
    """

    def __init__(self, path: str, states: int = STATES):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usual}
        longer = [p for p in self.score if len(p) > 1]
        if any(_SPACE in p.lstrip(_SPACE) for p in longer):
            raise ValueError("a piece holds a blank behind another character")
        self.grows = {s: s for s in dict.fromkeys(p[:n] for p in longer for n in range(1, len(p)))}
        self.same = {p: p for p in self.score}
        joining = sorted({c for p in longer for c in p})
        self.chars = [*[None] * (_APART + 1), *joining]
        self.of_char = np.zeros(0x110000, np.uint16)
        self.of_char[:0x80], self.of_char[0x80:0x800], self.of_char[0x800:0x10000], self.of_char[0x10000:] = 1, 2, 3, 4
        for c in self.score:
            if len(c) == 1:
                self.of_char[ord(c)] = 1
        self.tokens = {c: int(self.of_char[ord(c)]) for c in joining}
        self.of_char[[ord(c) for c in joining]] = np.arange(len(joining)) + _APART + 1
        self.of_char[0x20] = self.of_char[ord(_SPACE)]
        self.states, self.fits = states, {}
        self.forget()

    def forget(self) -> None:
        self.keys: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.table = np.full((1024, len(self.chars)), -1, np.int32)
        self.entries: dict[tuple, tuple] = {}
        self.fits.clear()

    def state(self, key: tuple) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.keys)
            if at >= self.states:
                raise _Full
            self.keys.append(key)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table[: max(1024, at // 4)], -1)])
            self.table[at, _NONE] = at << _BITS | _EMIT_ZERO
        return at

    def encoded(self, text: str) -> list[str]:
        """The pieces of a short text: the best pair joins first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            at = max(range(len(scores)), key=scores.__getitem__)
            if scores[at] == -np.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, last: str | None, piece: str) -> bool:
        """Whether ``piece`` can follow ``last`` (None: what joins with nothing)."""
        known = self.fits.get((last, piece))
        if known is None:
            if len(self.fits) > 2 * self.states:
                self.fits.clear()
            known = self.fits[last, piece] = self.encoded((last or "") + piece) == ([piece] if last is None else [last, piece])
        return known

    @property
    def start(self) -> tuple:
        return (("", None, 0),)

    def step(self, key: tuple, kind: int) -> tuple[tuple, int]:
        """The next state's key and the tokens that a character of class ``kind`` adds."""
        char = self.chars[kind]
        if char is None:
            return self.start, kind
        if char == _SPACE and (key[-1][1] or _SPACE)[-1] != _SPACE:
            key = (*key[:-1], ("", None, key[-1][2]))  # nothing joins a blank to what stands before it
        for suffix, last, before in key:
            piece = suffix + char
            if (not suffix or piece in self.score) and self.fit(last, piece):
                break
        added = before + (1 if suffix else self.tokens[char])
        grown = ((self.grows[s + char], last, before - added) for s, last, before in key if s + char in self.grows)
        here = (*grown, ("", self.same.get(piece, piece), 0))
        return tuple(self.entries.setdefault(e, e) for e in here), added

    def build(self, cells: np.ndarray) -> None:
        """Make the transitions at the given places of the flat table."""
        width = len(self.chars)
        for cell in cells.tolist():
            at, kind = divmod(cell, width)
            key, added = self.step(self.keys[at], kind)
            to = self.state(key)
            self.table[at, kind] = to << _BITS | (added + _EMIT_ZERO)

    def run(self, entry: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes at once through the classes ``kinds[step, lane]``: exit states and tokens."""
        state, total, width = entry.astype(np.int64), np.zeros(len(entry), np.int64), len(self.chars)
        flat = self.table.reshape(-1)
        for row in kinds:
            cells = state * width + row
            went = flat[cells]
            if (went < 0).any():
                self.build(np.unique(cells[went < 0]))
                flat = self.table.reshape(-1)
                went = flat[cells]
            state = (went >> _BITS).astype(np.int64)
            total += went & ((1 << _BITS) - 1)
        return state, total - _EMIT_ZERO * len(kinds)

    def segment(self, codes: np.ndarray, bounds: np.ndarray, entries: Sequence[tuple]) -> tuple[np.ndarray, list[tuple]]:
        """Tokens that each part ``codes[bounds[i]:bounds[i + 1]]`` adds from its entry state, and its exit state.

        Parts are cut into chunks. A chunk's state map is known for some entry states; the first
        is guessed from the characters before the chunk. A prefix scan composes the maps. Where
        an exit state isn't among the entries of the next chunk's map, that map gets it, and the
        scan is repeated.
        """
        sizes = np.diff(bounds)
        n = np.maximum(-(-sizes // CHUNK), 1)
        first = np.cumsum(n) - n
        part = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(part)) - first[part]
        begin = bounds[part] + nth * CHUNK
        kinds = np.append(self.of_char[codes], _NONE)

        def lanes(at: np.ndarray, until: np.ndarray, width: int) -> np.ndarray:
            place = at + np.arange(width)[:, None]
            return kinds[np.where(place < until, place, len(codes))]

        entry = np.array([self.state(k) for k in entries])[part]
        later = np.flatnonzero(nth)
        if len(later):
            entry[later] = self.run(np.full(len(later), self.state(self.start)), lanes(begin[later] - LOOK_BACK, begin[later], LOOK_BACK))[0]
        body = lanes(begin, np.minimum(begin + CHUNK, bounds[part + 1]), CHUNK)
        leave, tokens = self.run(entry, body)
        entry, leave, tokens = entry[:, None], leave[:, None], tokens[:, None]
        reach = 1
        while True:
            lane, state = self._unmet(entry, leave, nth, reach)
            if not len(lane):
                break
            out, added = self.run(state, body[:, lane])
            # a column for each state that a map gets; maps that get fewer repeat their first entry
            column = np.arange(len(lane)) - np.searchsorted(lane, lane)
            more = [np.repeat(x[:, :1], column.max() + 1, axis=1) for x in (entry, leave, tokens)]
            for wide, values in zip(more, (state, out, added)):
                wide[lane, column] = values
            entry, leave, tokens = (np.column_stack([x, y]) for x, y in zip((entry, leave, tokens), more))
            reach *= 2
        leave, tokens = scan(entry, leave, tokens, nth)
        last = first + n - 1
        return tokens[last, 0], [self.keys[s] for s in leave[last, 0]]

    @staticmethod
    def _unmet(entry: np.ndarray, leave: np.ndarray, nth: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks in order, and states that their maps lack, though the chunk before leaves them.

        A state that a map lacks goes to so many maps (``reach``) from there on, as what repeats itself
        (one letter, one pattern) leaves each chunk in other states than those that were guessed.
        """
        at = np.flatnonzero(nth)
        lost = [at[(entry[at] != leave[at - 1, k][:, None]).all(axis=1)] for k in range(leave.shape[1])]
        pairs = np.unique(np.concatenate([np.stack([i, leave[i - 1, k]], axis=1) for k, i in enumerate(lost)]), axis=0)
        lane = (pairs[:, :1] + np.arange(reach)).reshape(-1)
        state = np.repeat(pairs[:, 1], reach)
        begun = np.repeat(pairs[:, 0] - nth[pairs[:, 0]], reach)
        inside = np.flatnonzero(lane < len(nth))
        inside = inside[lane[inside] - nth[lane[inside]] == begun[inside]]
        lane, state = lane[inside], state[inside]
        new = (entry[lane] != state[:, None]).all(axis=1)
        return tuple(np.unique(np.stack([lane[new], state[new]], axis=1), axis=0).T)

    def parts(self, codes: np.ndarray, bounds: np.ndarray, entries: Sequence[tuple]) -> tuple[np.ndarray, list[tuple]]:
        """As :meth:`segment`, in smaller portions where the states would be too many."""
        try:
            return self.segment(codes, bounds, entries)
        except _Full:
            self.forget()
        if len(entries) > 1:
            half = len(entries) // 2
            a = self.parts(codes[: bounds[half]], bounds[: half + 1], entries[:half])
            b = self.parts(codes[bounds[half] :], bounds[half:] - bounds[half], entries[half:])
            return np.append(a[0], b[0]), a[1] + b[1]
        half = len(codes) // 2
        if half < CHUNK:
            raise ValueError("more states are needed for some hundred characters than may be kept")
        a = self.parts(codes[:half], np.array([0, half]), entries)
        b = self.parts(codes[half:], np.array([0, len(codes) - half]), a[1])
        return a[0] + b[0], b[1]

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        batch: list[int] = []
        held = 0

        def work() -> None:
            nonlocal held
            if batch:
                shown = [_SPACE + texts[i] for i in batch]
                codes = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32)
                bounds = np.append(0, np.cumsum([len(t) for t in shown]))
                total[batch] = self.parts(codes, bounds, [self.start] * len(batch))[0]
            batch.clear()
            held = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > SEGMENT:  # a long text alone, a segment after the other
                entry = [self.start]
                for at in range(0, len(text), SEGMENT):
                    shown = (_SPACE if at == 0 else "") + text[at : at + SEGMENT]
                    codes = np.frombuffer(shown.encode("utf-32-le"), np.uint32)
                    added, entry = self.parts(codes, np.array([0, len(codes)]), entry)
                    total[i] += added[0]
                continue
            batch.append(i)
            held += len(text)
            if held > SEGMENT:
                work()
        work()
        return total


def scan(entry: np.ndarray, leave: np.ndarray, tokens: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exit states and token sums of each chunk's map after all maps of its part before it.

    Maps are rows of the three arrays, a column for each known entry state; ``nth`` is a chunk's
    number in its part. A round composes each map with the one so many chunks before it, and
    doubles that distance.
    """
    if leave.shape[1] == 1:  # each map has the one entry that the map before leaves
        so_far = np.cumsum(tokens[:, 0])
        head = np.flatnonzero(nth == 0)
        before = (so_far - tokens[:, 0])[head]
        return leave, (so_far - np.repeat(before, np.diff(np.append(head, len(nth)))))[:, None]
    leave, tokens = leave.copy(), tokens.copy()
    first = entry.copy()
    reach = 1
    while reach <= nth.max(initial=0):
        at = np.flatnonzero(nth >= reach)
        came, start = leave[at - reach], first[at - reach]
        slot = (first[at][:, None, :] == came[:, :, None]).argmax(axis=2)
        rows = at[:, None]
        leave[at], tokens[at], first[at] = leave[rows, slot], tokens[at - reach] + tokens[rows, slot], start
        reach *= 2
    return leave, tokens


@cache
def transducer(name: str) -> Transducer:
    """This Python worker's transducer."""
    return Transducer(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, without begin and end tokens, as the vocabulary's library counts them.

    Result: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). One row for each
    row, repeated rows included; NULL and empty texts have 0 bytes and 0 tokens; a NULL id
    stays NULL; other columns are ignored, whatever their names. Very long texts are worked
    on in segments, so that a task holds little beside the text itself. Nothing is
    shuffled, and what a worker keeps (transitions of the transducer) is bounded by STATES.
    """

    def work(texts: list[str | None]) -> dict[str, Sequence]:
        return {"n_tokens": transducer(vocabulary).count(texts), "n_bytes": [len((t or "").encode()) for t in texts]}

    counted = map_texts(docs, work, "n_tokens long, n_bytes long", id_col, text_col)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
