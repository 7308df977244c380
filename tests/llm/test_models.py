"""Language ID, toxicity, secrets, language-model scores and packing."""

import hashlib
import math
import random
import re
import string
import uuid
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import hashing, language, lm_score, packing, secrets, subword, toxicity
from spanloom.llm.common import fold

# ---------------------------------------------------------------- subword ids


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "a ", "  a", " \nfoo", "foo\n bar", "x  y", "\n\n", "a\nb ", "end \n", "tab\tx y", "it's we'll 's", "<|endoftext|> x", "a \x1c b", "　x y", "é" * 50, "1234567 89", "a\r\nb", "👍 ok"]


def encoded(encoder, texts):
    return [c.ids[a:b].tolist() for c in encoder(pa.array(texts, pa.string())) for a, b in zip(c.bounds[:-1], c.bounds[1:])]


@pytest.mark.parametrize("remember", [1 << 20, 30])
def test_ids_are_those_of_the_tokenizer(reference, remember):
    rng = random.Random(4)
    pieces = ["a", "b", "The", "é", "—", "\u00a0", "\u2003", ".", "'s", "12", "\n", " ", " ", "  ", "\t", "\x1f", "日本", "👍"]
    texts = [*ODD, None, *("".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(1500))]
    plain, lower = subword.Encoder(False, remember), subword.Encoder(True, remember)
    for _ in range(2):
        assert encoded(plain, texts) == [reference(t or "") for t in texts]
        assert encoded(lower, texts) == [reference((t or "").translate(LOWER)) for t in texts]
    assert encoded(plain, []) == []


# ---------------------------------------------------------------- packing


def check_packing(rows, made, reference, capacity):
    documents = Counter()
    for doc, text in rows:
        documents[doc, tuple(reference(text or "") + [1])] += 1
    by_doc = {}
    for r in made:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    sequences = {}
    for r in made:
        assert 0 < r.length <= capacity and r.start + r.length <= r.doc_tokens
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for (doc, ids), n in documents.items():
        raw = np.array(ids, "<u4").tobytes()
        for r in by_doc[doc, len(ids)]:
            wanted[doc, r.start, r.length, len(ids), zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])] += 0
        starts = sorted({(r.start, r.length) for r in by_doc[doc, len(ids)]})
        assert sum(length for _, length in starts) == len(ids)
        for start, length in starts:
            wanted[doc, start, length, len(ids), zlib.crc32(raw[4 * start : 4 * (start + length)])] += n
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in made) == wanted
    return sequences


def test_packing_of_a_small_corpus(docs, reference):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    made = packing.pack(docs.withColumn("offset", F.lit(1)), capacity=256).collect()
    sequences = check_packing(rows, made, reference, 256)
    filled = sum(length for parts in sequences.values() for _, length in parts)
    assert filled / (256 * len(sequences)) > 0.9


def test_packing_edges(make, reference):
    rows = [(1, None), (2, ""), (2, ""), (3, "x " * 700), (None, "y"), (4, "same text"), (4, "same text")]
    check_packing(rows, packing.pack(make(rows), capacity=64).collect(), reference, 64)
    assert packing.pack(make([])).collect() == []
    ids = packing.pack(make([(1, "a b c")]), with_ids=True).first().ids
    assert ids == reference("a b c") + [1]


def test_patterns_hold_the_demand_and_come_close_to_the_bound():
    rng = random.Random(3)
    demand = {w: rng.randint(1, 4000) for w in range(1, 129)}
    patterns = packing.whole_patterns(demand, 128)
    held = Counter()
    for pattern, times in patterns:
        assert sum(w * n for w, n in pattern.items()) <= 128
        held.update({w: n * times for w, n in pattern.items()})
    assert held == demand
    optimum = sum(amount for _, amount in packing.column_generation(demand, 128))  # of the relaxed problem
    most = [w for w in demand if w > 64]  # no two of these share a sequence
    assert max(sum(demand[w] for w in most), sum(w * n for w, n in demand.items()) / 128) <= optimum + 1e-6
    assert sum(t for _, t in patterns) <= optimum + 3
    assert packing.whole_patterns({128: 3}, 128) == [({128: 3 // 3}, 3)] and packing.whole_patterns({}, 8) == []


@pytest.mark.parametrize(
    ("demand", "room", "least"),
    [({70: 10, 65: 7}, 128, 17), ({50: 9}, 128, 4.5), ({43: 30, 42: 31}, 128, 61 / 3), ({3: 4, 5: 4, 7: 4}, 15, 4), ({6: 3, 5: 4}, 10, 5), ({64: 10, 33: 1}, 128, 5.26)],
)
def test_the_program_ends_at_its_optimum_or_at_a_proof(demand, room, least):
    """Where the area bound can't be had, the value rounds up to the true optimum all the same."""
    found = packing.column_generation(demand, room)
    held = Counter()
    for pattern, amount in found:
        assert sum(w * n for w, n in pattern.items()) <= room
        for w, n in pattern.items():
            held[w] += n * amount
    assert all(abs(held[w] - n) < 1e-6 for w, n in demand.items())
    value = sum(amount for _, amount in found)
    assert value > least - 0.02 and math.ceil(value - 1e-6) == math.ceil(least - 1e-6)


def test_many_widths_come_within_one_sequence_of_the_area():
    rng = random.Random(6)
    for _ in range(3):
        demand = {w: rng.randint(1, 300) for w in rng.sample(range(1, 128), 90)}
        value = sum(amount for _, amount in packing.column_generation(demand, 256))
        area = sum(w * n for w, n in demand.items()) / 256
        assert area - 1e-6 <= value < math.ceil(area - 1e-6) + 1


# ---------------------------------------------------------------- language

SYLLABLES = {"aa": "th er on an re he in ed".split(), "bb": "der sch ung ein ich keit ver".split(), "cc": "que ción os as el la ie".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_and_mixtures(make):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang, rng.randint(20, 80)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(200, "x", None)]
    model = language.train(make(rows).where(fold() != 0))
    assert model.languages == ("aa", "bb", "cc") and np.allclose(model.likelihood.sum(axis=0), 1)
    held = [r for r in rows[:-1] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    got = {r.doc_id: r for r in language.identify(make(held), model).collect()}
    assert all(got[d].lang_pred == lang and got[d].score > 0.9 for d, _, lang in held)
    mixed = sentence(rng, "aa", 60) + " " + sentence(rng, "bb", 120)
    found = language.infer(mixed, model)
    assert set(found) == {"aa", "bb"} and abs(found["bb"] - 2 / 3) < 0.12
    odd = [(1, None), (2, ""), (3, "12 !? \n"), (4, "é"), (5, "th"), (5, "th"), (None, sentence(rng, "cc", 5000))]
    out = language.identify(make(odd).withColumn("score", F.lit(1)), model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] in model.languages and by[None][0] == "cc" and len(out) == 7
    assert language.identify(make([]), model).collect() == [] and language.train(make([])).languages == ("und",)


# ---------------------------------------------------------------- toxicity


def toxic_corpus(n=600):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zzidiotx", "qqmoron", "wwscum"]) + rng.choice(["", "s", "ish"])
        if rng.random() < (0.7 if toxic else 0.1):
            words.append(rng.choice(["muslim", "gay"]))
        rows.append((i, " ".join(words)))
        labels.append(int(toxic))
    return rows, labels


def test_toxicity_on_held_out_rows_and_swapped_terms(make, spark):
    rows, labels = toxic_corpus()
    known = spark.createDataFrame([*enumerate(labels), (None, 1), (9999, 1), (1, None)], "doc_id long, toxic int").where(fold() != 0)
    model = toxicity.train(make(rows), known)
    got = {r.doc_id: r for r in toxicity.score_toxicity(make(rows), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    again = toxicity.train(make(rows), known)
    assert np.array_equal(model.weights, again.weights)


def test_the_penalty_takes_weight_from_identity_terms():
    rows, labels = toxic_corpus()
    words = [toxicity.document_words(t) for _, t in rows]
    own = [np.array(toxicity.feature_set(w)) for w in words]
    other = [None if (s := toxicity.swapped(w)) is None else np.array(toxicity.feature_set(s)) for w in words]
    weight = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(own, other, np.array(labels), penalty=penalty)
        values = dict(zip(model.buckets.tolist(), model.weights.tolist()))
        terms = [values.get(toxicity.bucket(f"={t}"), 0.0) for t in ("muslim", "gay")]
        weight[penalty] = max(map(abs, terms))
        neutral = model.scorer().score("the muslim neighbours bake bread")
    assert weight[20.0] < 0.5 * weight[0.0] and neutral < 0.5


def test_scores_are_the_sum_of_a_texts_features(make, spark):
    rng = random.Random(12)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    bad = ["vile" + w for w in plain[:6]]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (rng.choices(bad, k=3) if i % 3 == 0 else []))) for i in range(150)]
    model = toxicity.train(make(rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    values = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    texts = [t for _, t in rows] + ["", "vileabc VILEdef, vile", "x " * 3000]
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(make(list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        counts = Counter(f for w in set(re.findall(r"\w+", text.lower())) for f in toxicity.word_features(w, model.swaps))
        held = set(counts) | {toxicity.lifted(f, k) for f, n in counts.items() for k in (2, 4) if n >= k}
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(values.get(f, 0.0) for f in held))))), abs_tol=1e-9)


def test_words_that_stand_for_one_another_are_learned(make, spark):
    """Two colours stand beside the same words, two beasts beside others; what goes with the label is no term."""
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        if i % 2:
            words = [rng.choice(["red", "blue"]), *rng.sample(["paint", "wall", "brush", "door"], 3)]
        else:
            words = [rng.choice(["cat", "dog"]), *rng.sample(["tail", "fur", "paw", "bark"], 3)]
        rows.append((i, " ".join(words + ["awful"] * toxic)))
        labels.append((i, int(toxic)))
    sample = make(rows).select("doc_id", "text").join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id")
    pairs = {frozenset(p) for p in toxicity.learned_groups(sample)}
    assert {frozenset(("red", "blue")), frozenset(("cat", "dog"))} <= pairs and not any("awful" in p for p in pairs)
    assert toxicity.learned_groups(sample.limit(0)) == [] and toxicity.learned_groups(sample.where("toxic = 0")) == []


def test_toxicity_edges(make, spark):
    prior = toxicity.train(make([]), spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(make([(1, None), (2, ""), (None, "x"), (2, "")]).withColumn("score", F.lit(9)), prior).collect()
    assert len(out) == 4 and len({r.score for r in out}) == 1 and toxicity.score_toxicity(make([]), prior).collect() == []


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(make):
    rng = random.Random(6)
    alphabet = "abcdefABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    random_key = "".join(rng.choice(alphabet) for _ in range(40)) + "a1B"
    digest = hashlib.sha256(b"x").hexdigest()
    texts = [
        'Password = "hunter22" é token:abc tOKEN : abcdef', f"key AKIA{'A1' * 8} and AKIAX", f"x{digest}y {digest[:23]} {digest[:24].upper()}",
        f"see {random_key} there", "ApiKey=1 api_key=\"Ab.cd-ef_=\" ſecret=abcdefg", "secret=short token=longenough", None, "",
        "Thisisonelongordinarywordwithoutanydigits and 123e4567-e89b-12d3-a456-426614174000", "passwd: " + "z" * 5000,
    ]
    got = {r.doc_id: r for r in secrets.scan_secrets(make(list(enumerate(texts))).withColumn("spans", F.lit(1))).collect()}
    for i, text in enumerate(texts):
        base = brute_spans(text or "")
        kinds = [k for _, k, _ in base]
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(map(kinds.count, range(3))), text
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("token")] == ([] if not written else written.split(","))
    assert got[3].spans == f"token:4:{4 + len(random_key)}" and got[8].n_token == 0 and secrets.scan_secrets(make([])).collect() == []


# ---------------------------------------------------------------- language-model scores

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_base(rows, got, learn):
    tokens = [(doc, WORDS.findall((text or "").translate(LOWER)) + [""]) for doc, text in rows]
    counts = Counter(t for doc, ts in tokens if learn(doc) for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    wanted = []
    for doc, ts in tokens:
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in ts)
        wanted.append((doc, len(ts), sum(counts[t] > 0 for t in ts), total, round(base, 6)))
    made = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(made, key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("head", [1 << 20, 40])
def test_base_scores(docs, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD_WORDS", head)
    monkeypatch.setattr(lm_score, "PASSES", 1)
    clashing = docs.withColumns({c: F.lit(1) for c in ("score", "learn", "rid", "ids", "word", "c")})
    got = lm_score.score_language_model(clashing, fold() != 1, fold() == 1).collect()
    rest = lambda doc: None if doc is None else zlib.crc32(str(doc).encode()) % 5
    check_base([(r.doc_id, r.text) for r in docs.collect()], got, lambda d: d is not None and rest(d) != 1)
    assert all(r.held_out == (rest(r.doc_id) == 1) and r.score < 0 for r in got)


def test_scores_of_an_empty_table_and_without_training(make):
    assert lm_score.score_language_model(make([]), fold() != 1, fold() == 1).collect() == []
    (row,) = lm_score.score_language_model(make([(1, None)]), F.lit(False), F.lit(True)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 0, 0) and row.score < 0


def some_model(seed, dtype=np.float32, of=400):
    """Units, tables and a model of made-up counts and weights."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(lm_score.VOCABULARY)
    counts[:of] = 20_000 // np.arange(1, of + 1)
    u = lm_score.units(counts)
    successors = rng.poisson(3, (lm_score.INPUTS, lm_score.CLASSES)) * (np.arange(lm_score.INPUTS) <= of)[:, None]
    insides = rng.poisson(2, (lm_score.CLASSES + 1, lm_score.VOCABULARY)) * (counts > 0)
    t = lm_score.tables(u, successors.astype(float), insides.astype(float))
    t = lm_score.Tables(*(getattr(t, k).astype(dtype) for k in ("embed", "successor", "inside")))
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(dtype) for k, v in lm_score.start().items()}
    return rng, u, t, p


def class_scores(p, t, line, known=None):
    q, k, v = lm_score.parts_of(p, t.embed[line])
    asking = (line if known is None else known)[lm_score.STRIDE - 1 : -1]
    return lm_score.forward(p, (q[lm_score.STRIDE - 1 : -1], k, v), t.successor[asking])["scores"]


def brute_log10(p, ids, u, t, weight):
    """Token by token, place by place."""
    rows = [0] * lm_score.STRIDE + [i + 1 for i in ids]
    query, key, value = (t.embed.astype(float) @ p[k].astype(float) for k in ("query", "key", "value"))
    total = 0.0
    for n, i in enumerate(ids):
        asking = lm_score.STRIDE - 1 + n
        begin = n // lm_score.STRIDE * lm_score.STRIDE
        marks = []
        for place in range(begin, asking + 1):
            marks.append(math.exp(query[rows[asking]] @ key[rows[place]] / lm_score.WIDTH**0.5 + p["near"][0][asking - place]))
        values = [value[rows[place]] for place in range(begin, asking + 1)]
        o = sum(m * v for m, v in zip(marks, values)) / sum(marks)
        scores = np.append(o, 1) @ p["out"].astype(float) + t.successor[rows[asking]]
        chance = np.exp(scores) / np.exp(scores).sum()
        c, before = u.class_of[i], lm_score.CLASSES if n == 0 else u.class_of[ids[n - 1]]
        total += math.log10(weight * chance[c] + (1 - weight) * u.mass[c]) + t.inside[before, i] / math.log(10)
    return total


def test_scores_are_those_of_brute_force():
    rng, u, t, p = some_model(3)
    texts = [rng.integers(0, 500, n) for n in (1, 2, 15, 16, 17, 31, 32, 33, 100, 5000)] + [np.array([lm_score.END])]
    got = lm_score.log_probabilities(p, texts, u, t, np.array([0.0, 0.7, 1.0]))
    for text, row in zip(texts[:9] + texts[10:], np.delete(got, 9, axis=0)):
        assert np.allclose(row, [brute_log10(p, text, u, t, w) for w in (0.0, 0.7, 1.0)], rtol=1e-4), len(text)
    assert got[9, 2] < 0 and lm_score.log_probabilities(p, [], u, t).shape == (0, 1)


def test_probabilities_add_up_to_one():
    rng, u, t, p = some_model(4)
    assert np.allclose(np.bincount(u.class_of, weights=u.share, minlength=lm_score.CLASSES), 1) and np.isclose(u.mass.sum(), 1)
    assert np.bincount(u.class_of, minlength=lm_score.CLASSES).min() > 0
    inside = np.stack([np.bincount(u.class_of, weights=np.exp(row.astype(float)), minlength=lm_score.CLASSES) for row in t.inside])
    assert np.allclose(inside, 1, atol=1e-3) and np.allclose(np.exp(t.successor.astype(float)).sum(axis=1), 1, atol=1e-4)
    scores = class_scores(p, t, rng.integers(0, 400, 64))
    total = lm_score.chances(scores)
    assert np.allclose((scores / total[:, None]).sum(axis=1), 1, atol=1e-4)
    huge = np.full((2, lm_score.CLASSES), 500, np.float32)
    assert np.isfinite(lm_score.chances(huge)).all()


def test_every_token_is_predicted_once_and_attention_is_causal():
    texts = [np.arange(n, dtype="<u2") for n in (1, 15, 16, 17, 700, 5001)]
    rows, begins = lm_score.in_line(texts)
    seen = Counter()
    for to, part, asking, real in lm_score.batches_of(rows):
        assert (rows[to] == part[lm_score.STRIDE :]).all() and (rows[to.start - 1 : to.stop - 1] == asking).all()
        seen.update((part[lm_score.STRIDE :][real] - 1).tolist())
    assert seen == Counter(i for t in texts for i in t.tolist()) and len(begins) == len(texts)
    rng, _, t, p = some_model(5)
    line = rng.integers(1, 400, 8 * lm_score.STRIDE)
    place = 4 * lm_score.STRIDE + 5
    later = line.copy()
    later[place] += 1
    a, b = (class_scores(p, t, x, line) for x in (line, later))
    asks = np.arange(lm_score.STRIDE - 1, len(line) - 1)
    changed = np.flatnonzero(~np.isclose(a, b, atol=1e-6).all(axis=1))
    assert asks[changed].min() == place and asks[changed].max() >= place + lm_score.STRIDE  # more than 15 ids of context


def test_gradients_match_differences():
    rng, u, t, p = some_model(9, np.float64)
    line = rng.integers(0, 400, 5 * lm_score.STRIDE)
    x, known = t.embed[line], t.successor[line[lm_score.STRIDE - 1 : -1]]
    target, real = rng.integers(0, lm_score.CLASSES, len(known)), rng.random(len(known)) < 0.8

    def loss():
        q, k, v = lm_score.parts_of(p, x)
        s = lm_score.forward(p, (q[lm_score.STRIDE - 1 : -1], k, v), known)["scores"]
        return -np.mean((s[np.arange(len(s)), target] - np.log(np.exp(s).sum(axis=1)))[real])

    g = lm_score.gradients(p, x, known, target, real)
    for k, shape in lm_score.SHAPES.items():
        for _ in range(6):
            i = (rng.integers(0, shape[0]), rng.integers(0, shape[1]))
            old = p[k][i]
            p[k][i] = old + 1e-5
            up = loss()
            p[k][i] = old - 1e-5
            down = loss()
            p[k][i] = old
            assert np.isclose((up - down) / 2e-5, g[k][i], atol=1e-8, rtol=1e-4), (k, i)


def test_keys_and_values_cost_no_product_for_each_place():
    """Embeddings themselves stand for keys and values, so a step's products of a place are the query's alone."""
    _, _, t, p = some_model(10, np.float64)
    x = t.embed[:40]
    q, k, v = lm_score.parts_of(p, x)
    assert k is x and v is x
    assert np.allclose(q @ k.T, (x @ p["query"]) @ (x @ p["key"]).T / lm_score.WIDTH**0.5)
    weights = np.random.default_rng(1).random((5, 40))
    assert np.allclose(weights @ v @ lm_score.value_of(p), np.column_stack([weights @ (x @ p["value"]), weights.sum(axis=1)]))


def test_words_are_told_apart_as_by_sorting():
    keys = np.random.default_rng(2).integers(0, 50, 700).astype(np.uint64) << np.uint64(58)
    for own in (keys, keys[:1], keys[:0]):
        assert all(np.array_equal(a, b) for a, b in zip(subword.distinct(own), np.unique(own, return_index=True, return_inverse=True)))


def test_words_are_where_brute_force_finds_them():
    """Also across texts without white space between them, and with white space longer than any word."""
    texts = ["", "ab", "Cd", " e  f" + " " * 50, "\n", "abcdefg h", "   ", "é x", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    hashes, begins, ends, first = hashing.words_of(data, bounds)
    found = [[data[b:e].tobytes().lower() for b, e in zip(begins[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    wanted = [re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) for t in texts]
    assert found == wanted
    words = sum(wanted, [])
    alone = [hashing.words_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in words]
    assert hashes.tolist() == alone and len(set(alone)) == len(set(words))


def test_attention_learns_what_the_last_id_does_not_tell():
    """Ids 0, 1 and 2 in turn, each with a filler behind it: after a filler only the id before it tells what comes."""
    counts = np.zeros(lm_score.VOCABULARY)
    counts[[0, 1, 2]], counts[3] = 100, 300
    u = lm_score.units(counts)
    texts = [np.tile([0, 3, 1, 3, 2, 3], 300).astype("<u2") for _ in range(4)]
    rows, _ = lm_score.in_line(texts)
    at = np.flatnonzero(rows[1:]) + 1
    successors, insides = np.zeros((lm_score.INPUTS, lm_score.CLASSES)), np.zeros((lm_score.CLASSES + 1, lm_score.VOCABULARY))
    np.add.at(successors, (rows[at - 1], u.class_of[rows[at] - 1]), 1)
    t = lm_score.tables(u, successors, insides)
    model, steps = lm_score.start(), lm_score.Adam(0.05)
    before = lm_score.log_probabilities(model, texts, u, t).sum()
    for _ in range(40):
        assert lm_score.train_on(model, texts, u, t, steps) == 7200
    after = lm_score.log_probabilities(model, texts, u, t).sum()
    assert after > 0.5 * before


def test_less_frequent_ids_have_rows_of_their_own_and_ids_inside_a_class_depend_on_the_one_before():
    rng, u, t, p = some_model(6, of=2000)
    assert len(np.unique(t.embed[1:2001], axis=0)) == 2000
    big = np.flatnonzero(np.bincount(u.class_of[:2000], minlength=lm_score.CLASSES) > 3)[-1]
    insides = np.zeros((lm_score.CLASSES + 1, lm_score.VOCABULARY))
    first, second = np.flatnonzero(u.class_of[:2000] == big)[:2]
    insides[0, first], insides[1, second] = 500, 500
    t = lm_score.tables(u, np.zeros((lm_score.INPUTS, lm_score.CLASSES)), insides)

    def score(*ids):
        return lm_score.log_probabilities(p, [np.array(ids)], u, t)[0, 0]

    assert score(0, first) > score(0, second) + 0.5 and score(1, second) > score(1, first) + 0.5


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_held_out_scores_beat_the_subword_unigram(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lm_score.score_language_model(rows, fold() != 1, fold() == 1).collect()}
    texts = rows.select("doc_id", "text").collect()
    ids = dict(zip((r.doc_id for r in texts), encoded(subword.Encoder(True), [r.text for r in texts])))
    counts = Counter({lm_score.END: 0})
    for doc, own in ids.items():
        if not got[doc].held_out:
            counts.update([*own, lm_score.END])
    total = sum(counts.values()) + 0.5 * lm_score.VOCABULARY
    held = [d for d in ids if got[d].held_out]
    unigram = sum(math.log10((counts[i] + 0.5) / total) for d in held for i in [*ids[d], lm_score.END])
    tokens = sum(len(ids[d]) + 1 for d in held)
    assert sum(got[d].score for d in held) / tokens > unigram / tokens + 0.4  # about -1.89 and -2.46


def test_secrets_of_few_kinds_of_characters_and_within_longer_runs(make):
    rng = random.Random(11)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    base32, base36, letters, key = draw(large + "234567", 32), draw(small + digits, 32), draw(small + large, 32), draw(small + large + digits, 24)
    path, sha = "/service/session/identifier/production/", draw("0123456789abcdef", 24)
    texts = [f"a {base32} b", f"a {base36} b", f"a {letters} b", f"see {path}{key}", f"x {sha}/{key} y", f"{path}configuration/description", "id=123E4567-e89b-12d3-a456-426614174000 2026-11-28T06-22-00Z"]
    got = {r.doc_id: r.spans.split(",") for r in secrets.scan_secrets(make(list(enumerate(texts)))).collect()}
    for i in range(3):
        assert got[i] == ["token:2:34"], texts[i]

    def covered(i):  # a key that holds its own stretches is found whole or nearly so
        at = texts[i].index(key)
        return any(s.startswith("token") and max(at, int(s.split(":")[1])) + 20 <= min(at + 24, int(s.split(":")[2])) for s in got[i])

    assert covered(3) and covered(4) and "hex:2:26" in got[4] and got[5] == got[6] == [""]


def test_secrets_in_very_long_runs():
    """One run of thousands of known identifiers, a text of one blob, and letters without an end."""
    rng = random.Random(8)
    ids = "/".join(str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(3000))
    assert secrets.token_spans(ids, [], 1.9) == []
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    assert secrets.token_spans(f"{ids}/{key}/{ids}", [], 1.9) == [(len(ids) + 1, 3, len(ids) + 41)] or secrets.token_spans(f"{ids}/{key}/{ids}", [], 1.9) == [(len(ids), 3, len(ids) + 42)]
    blob = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=10_000_000))
    assert secrets.token_spans(blob, [], 1.9) == [(0, 3, len(blob))]
    words = "understanding" * 100_000
    assert secrets.token_spans(words, [], 1.9) == []


def test_secrets_recall_and_compound_words():
    """Keys of 20 to 64 characters in four alphabets are found whole; long words joined are none."""
    rng = random.Random(9)
    lower = string.ascii_lowercase + string.digits
    for alphabet in (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits, lower):
        found = 0
        for _ in range(300):
            key = "".join(rng.choices(alphabet, k=rng.randint(20, 64)))
            found += any(a <= 4 and b >= 4 + len(key) for a, _, b in secrets.token_spans(f"see {key} for", [], 1.9))
        assert found >= 295
    words = "international understanding configuration management organization responsibility environment builder versicherung gesellschaft".split()
    for joint in ("", "_", "-"):
        for _ in range(200):
            assert secrets.token_spans(joint.join(rng.choices(words, k=4)), [], 1.9) == []


def test_simplex_steps_without_gain_end(monkeypatch):
    """Under the rule against circles from the first step on, programs end with as good a bound."""
    rng = random.Random(10)
    for _ in range(6):
        demand = {w: rng.randint(1, 40) for w in rng.sample(range(5, 100), 25)}
        usual = sum(n for _, n in packing.column_generation(demand, 100))
        monkeypatch.setattr(packing, "STALL", -1)
        ruled = sum(n for _, n in packing.column_generation(demand, 100))
        monkeypatch.undo()
        assert abs(np.ceil(usual - 1e-6) - np.ceil(ruled - 1e-6)) < 1
