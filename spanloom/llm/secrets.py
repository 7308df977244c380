"""Secret scans: fixed patterns, and strings that a tokenizer finds hard to compress."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .subword import vocabulary

#: The base patterns, and the fewest characters that count (of group 2, of the match).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f] shorter than that match nowhere
KINDS = ("assign", "access", "hex", "token")

#: A candidate of the token test: an unbroken run of credential characters.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Those with separators around them, inside a run.
KNOWN_PART = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{128}|[0-9a-fA-F]{96}"
    r"|[0-9a-fA-F]{64}|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![A-Za-z0-9])"
)
#: The fewest characters of a token span, and what separators leave of a run; characters of a run that are encoded at a time.
LEAST, PART = 20, re.compile(r"[A-Za-z0-9+]+")
BLOCK = 4096
#: Digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 in hex) and identifiers (UUIDs, numbers, dates) are known.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9_+/=-]+)"
)
_WORDS = (b"passw", b"secret", b"token", b"api")
_IS_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_IS_RUN = bytes(1 if re.fullmatch(r"[A-Za-z0-9+/_=-]", chr(b)) else 0 for b in range(256))


@cache
def _token_sizes() -> np.ndarray:
    """Bytes of each token."""
    return np.array([len(vocabulary().decode_single_token_bytes(i)) for i in range(vocabulary().n_vocab)])


def token_ends(run: str) -> np.ndarray:
    """Where the tokens of a run (ASCII) end, behind a 0; long runs are encoded by blocks of BLOCK characters."""
    ids = [i for at in range(0, len(run), BLOCK) for i in vocabulary().encode_ordinary(run[at : at + BLOCK])]
    return np.append(0, np.cumsum(_token_sizes()[ids]))


def looks_random(size: int, tokens: int, letters: int, max_ratio: float) -> bool:
    """Takes many tokens for its length; one letter in five characters is no number or time."""
    return 5 * letters >= size and size <= max_ratio * tokens


def stretches(run: str, max_ratio: float) -> list[tuple[int, int]]:
    """The parts of a run that random-looking stretches cover: such are the fewest tokens, from each token on, with LEAST characters."""
    ends = token_ends(run)
    letters = np.append(0, np.cumsum([c.isalpha() for c in run]))
    last = np.searchsorted(ends, ends + LEAST)
    first = np.flatnonzero(last < len(ends))
    last = last[first]
    size = ends[last] - ends[first]
    good = (5 * (letters[ends[last]] - letters[ends[first]]) >= size) & (size <= max_ratio * (last - first))
    found: list[tuple[int, int]] = []
    for a, b in zip(ends[first[good]].tolist(), ends[last[good]].tolist()):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], b)
        else:
            found.append((a, b))
    return [(a, b) for a, b in found if not KNOWN.fullmatch(run[a:b])]


def random_parts(run: str, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what looks random in a run: between known digests and identifiers all of it, parts between separators, or their stretches.

    If not the whole is a span, a part of LEAST characters or more that looks random is; of other
    parts the random-looking stretches are. Each run is read, and each part encoded, once.
    """
    found: list[tuple[int, int]] = []
    at = 0
    for known in [*(m.span() for m in KNOWN_PART.finditer(run)), (len(run), len(run))]:
        begin, piece = at, run[at : known[0]]
        at = known[1]
        if len(piece) < LEAST or KNOWN.fullmatch(piece):
            continue
        if looks_random(len(piece), len(token_ends(piece)) - 1, sum(map(str.isalpha, piece)), max_ratio):
            found.append((begin, begin + len(piece)))
            continue
        for m in PART.finditer(piece):
            part = m[0]
            if len(part) < LEAST or KNOWN.fullmatch(part):
                continue
            if looks_random(len(part), len(token_ends(part)) - 1, sum(map(str.isalpha, part)), max_ratio):
                found.append((begin + m.start(), begin + m.end()))
            else:
                found += [(begin + m.start() + a, begin + m.start() + b) for a, b in stretches(part, max_ratio)]
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, ordered by start and kind."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    low = raw.lower()
    if any(word in low for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"\x01" * 24 in raw.translate(_IS_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, base: list[tuple[int, int, int]], max_ratio: float) -> list[tuple[int, int, int]]:
    """Spans that only the token test finds."""
    raw = text.encode("utf-8", "surrogatepass")
    if b"\x01" * 20 not in raw.translate(_IS_RUN):
        return []
    found = []
    for m in RUN.finditer(text):
        at = m.start()
        for start, _, end in [*base, (m.end(), 3, m.end())]:  # base spans are cut out of the run
            if end > at and start <= m.end():
                found += [(at + a, 3, at + b) for a, b in random_parts(text[at : max(at, start)], max_ratio)]
                at = max(at, end)
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 1.9) -> DataFrame:
    """Find secrets in every text.

    Base spans are matches of three patterns: ``assign`` (a key word, an assignment and six or
    more characters), ``access`` (an access key id of 20 or more), ``hex`` (24 or more hex
    digits). The token test adds ``token`` spans: 20 or more credential characters, whatever their
    kinds, that come out at ``max_ratio`` or fewer characters per token of a public vocabulary: of
    a run without the base spans in it, the whole, parts between separators, or stretches of a
    part; known digests and identifiers are none.

    Result: doc_id, n_assign, n_access, n_hex, n_token, base_sha256 (lower hex of the base
    spans as ``kind:start:end``, joined by commas), spans (all spans, written likewise);
    offsets count code points, ends are exclusive, order is by start, then kind. One row per
    input row, repeated rows included; NULL and empty texts have no spans; very long texts and runs
    are read whole, in time that grows with their length; other columns are ignored. Each text is scanned in its own task's batch; nothing is shuffled.
    """

    def scan(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in ("n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans")}
        for text in texts:
            base = base_spans(text) if text else []
            extra = token_spans(text, base, max_ratio) if text else []
            kinds = [kind for _, kind, _ in base]
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(kinds.count(k))
            out["n_token"].append(len(extra))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(sorted(base + extra)))
        return out

    schema = "n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"
    return map_texts(docs, scan, schema, id_col, text_col)
