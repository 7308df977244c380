"""Token counts against the vocabulary's library."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from spanloom.llm import token_counts
from spanloom.llm.queries import op13_token_counts
from spanloom.llm.token_counts import CHUNK, Transducer, count_tokens, scan

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = [
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "the a", "▁ \tab\n=-", "日本é中a ÀÿцшЖ😀\x00�\x85 ", "aeiou", "01", "=*-#/_ ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def compiled():
    return Transducer(PATH)


def strings(seed, sizes, each):
    rng = random.Random(seed)
    return ["".join(rng.choice(a) for _ in range(rng.choice(sizes))) for a in ALPHABETS for _ in range(each)]


def wanted(library, texts):
    return [len(library.encode(t or "")) for t in texts]


def test_counts_are_those_of_the_library(library, compiled):
    texts = strings(1, [1, 2, 5, 40, 300, 3000], 40)
    texts += [None, "", " ", "  " * 50, "\x00", "<s> </s> <unk> <0x0A>", "é ﬁ Ⅷ", "a" * 5000, "=" * 700 + " " * 900 + "x", "▁a ▁ ▁▁b", "tokenization" * 300]
    assert compiled.count(texts).tolist() == wanted(library, texts)


def test_long_texts_go_by_segments(library, compiled, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT", 1000)
    texts = strings(2, [990, 1000, 1001, 7013], 6)
    assert compiled.count(texts).tolist() == wanted(library, texts)


def test_few_states_may_be_kept(library):
    tiny = Transducer(PATH, states=900)
    texts = strings(3, [3, 700, 4000], 8)
    assert tiny.count(texts).tolist() == wanted(library, texts)
    assert len(tiny.keys) <= 900


def test_wrong_guesses_of_entry_states_are_met(library, monkeypatch):
    """Without any look back each later chunk begins in a state that is mostly wrong."""
    monkeypatch.setattr(token_counts, "LOOK_BACK", 0)
    tiny = Transducer(PATH)
    texts = strings(4, [CHUNK + 1, 5 * CHUNK + 7, 2000], 8)
    assert tiny.count(texts).tolist() == wanted(library, texts)


def test_repetitions_need_few_rounds(library, compiled, monkeypatch):
    """Each chunk is left in another state than the look back makes expect, over hundreds of chunks."""
    rounds = []
    run = Transducer.run
    monkeypatch.setattr(Transducer, "run", lambda self, entry, kinds: rounds.append(1) or run(self, entry, kinds))
    for text in ("a" * 100_001, " " * 70_003, "-" * 50_000, "ab" * 40_000, "xyzxyzx" * 9000):
        rounds.clear()
        assert compiled.count([text]).tolist() == [len(library.encode(text))]
        assert len(rounds) < 30


def test_maps_compose_by_a_scan():
    """Three entries for each map: composed along each part, all sums are those of a walk."""
    rng = np.random.default_rng(0)
    nth = np.concatenate([np.arange(n) for n in (1, 5, 8, 13)])
    entry = np.tile(np.arange(3), (len(nth), 1))
    leave, tokens = rng.integers(0, 3, entry.shape), rng.integers(0, 9, entry.shape)
    state, total, want = 0, 0, []
    for i, n in enumerate(nth):
        if n == 0:
            state, total = 0, 0
        state, total = leave[i, state], total + tokens[i, state]
        want.append((state, total))
    found = scan(entry, leave, tokens, nth)
    assert [(a, b) for a, b in zip(found[0][:, 0], found[1][:, 0])] == want


def test_count_tokens_of_a_table(spark, docs, library):
    clashing = docs.select("doc_id", "text", F.lit(1).alias("n_tokens"), F.lit("x").alias("n_bytes"), F.lit(2).alias("c0"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, wanted(library, [t for _, t in rows]))), key=str)
    assert sorted((tuple(r) for r in count_tokens(clashing, limit=100).collect()), key=str) == want
    assert count_tokens(docs.limit(0)).count() == 0


def test_query(spark, sf):
    found = op13_token_counts(spark, sf)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert found.where("over_limit").count() == 1
