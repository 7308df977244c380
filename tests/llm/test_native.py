"""Line dedup and chat formatting: no Python runs, and every edge has its result."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from spanloom.llm.chat_format import format_preferences, pair_records
from spanloom.llm.line_dedup import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_lines(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if doc is not None and len(key) >= 20:
                holders[key].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(line.strip(BLANKS).translate(LOWER), ())
            if len(ids) < 3 or doc is None or doc == max(ids):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def collected(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in frame.collect()), key=str)


def test_lines_of_a_small_corpus(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collected(line_dedup(docs)) == expected_lines(rows)


def test_line_edges(make):
    line, accents = "The Same Long Line Of Text", "ÉÀ une ligne assez longue É"
    rows = [
        (1, f"{line}\nx\n{line}"), (2, f"\t{line.lower()}\x0b\r"), (3, f"{line}\n{line}\ny"), (4, accents), (5, accents), (6, accents.lower()),
        (7, None), (8, ""), (9, "\n\n"), (None, line), (3, f"{line}\nother"), (10, "short line\n" * 3), (11, f"{line} {line}"), (2, f"\t{line.lower()}\x0b\r"),
    ]
    assert collected(line_dedup(make(rows))) == expected_lines(rows)


def test_lines_of_long_and_empty_tables(make):
    shared = [f"line number {i} that all of them share" for i in range(3000)]
    rows = [(i, "\n".join(shared + [f"own line of document {i} it is"])) for i in range(3)]
    assert collected(line_dedup(make(rows))) == expected_lines(rows)
    assert line_dedup(make([])).collect() == []


def test_other_columns_stay_and_clashes_are_replaced(make):
    rows = make([(1, "a\nb")]).withColumn("n_lines", F.lit("old")).withColumn("row", F.lit(1)).withColumn("id", F.lit(2)).withColumn("lines", F.lit(3))
    out = line_dedup(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "id", "lines", "n_lines", "n_dropped"]
    assert out.first().n_lines == 2 and out.first().row == 1


def test_native_plans(make):
    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    turns = make([(1, "x")]).selectExpr("doc_id AS pair_id", "'chosen' AS side", "0 AS turn", "'user' AS role", "text")
    for frame in (line_dedup(make([(1, "x")])), format_preferences(turns)):
        assert not any(word in plan(frame) for word in ("Python", "Arrow", "Pandas"))


TURNS = "pair_id long, side string, turn long, role string, text string"


def formatted(spark, rows):
    out = format_preferences(spark.createDataFrame(rows, TURNS))
    order = {"prompt": 0, "chosen": 1, "rejected": 2}
    return sorted(out.collect(), key=lambda r: (r.pair_id, order[r.part], r.turn))


def test_prompt_once_and_masked_completions(spark):
    shared = [(0, "system", "s"), (1, "user", "q")]
    rows = [(1, side, t, role, text) for side in ("chosen", "rejected") for t, role, text in shared]
    rows += [(1, "chosen", 2, "assistant", "good"), (1, "rejected", 2, "assistant", "bad"), (1, "rejected", 3, "user", "why")]
    got = [(r.part, r.turn, r.rendered, r.loss) for r in formatted(spark, rows)]
    assert got == [
        ("prompt", 0, "<|system|>\ns<|end|>\n", 0), ("prompt", 1, "<|user|>\nq<|end|>\n", 0), ("chosen", 2, "<|assistant|>\ngood<|end|>\n", 1),
        ("rejected", 2, "<|assistant|>\nbad<|end|>\n", 1), ("rejected", 3, "<|user|>\nwhy<|end|>\n", 0),
    ]
    for r in formatted(spark, rows):
        assert r.rendered[r.body_start : r.body_end] in ("s", "q", "good", "bad", "why")


def test_a_later_equal_turn_is_no_prompt(spark):
    rows = [(1, s, 0, "user", s) for s in ("chosen", "rejected")] + [(1, s, 1, "user", "same") for s in ("chosen", "rejected")]
    assert [r.part for r in formatted(spark, rows)] == ["chosen", "chosen", "rejected", "rejected"]


def test_pair_edges(spark):
    rows = [
        (1, "chosen", 0, None, None), (1, "rejected", 0, "user", ""),  # equal: all prompt
        (2, "chosen", 0, "assistant", "x"),  # no other side
        (3, "chosen", 0, "user", "b"), (3, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", "a"),  # repeated turn: the smallest
        (None, "chosen", 0, "user", "x"), (4, "chosen", None, "user", "x"), (5, "other", 0, "user", "x"),
    ]
    assert [(r.pair_id, r.part, r.loss) for r in formatted(spark, rows)] == [(1, "prompt", 0), (2, "chosen", 1), (3, "prompt", 0)]
    assert formatted(spark, []) == []


def test_hash_of_kept_text(make):
    row = line_dedup(make([(1, None)])).select(F.sha2("text", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()


def test_records_of_pairs(spark):
    rows = [(1, side, 0, "user", "q") for side in ("chosen", "rejected")]
    rows += [(1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bäd"), (1, "rejected", 2, "user", "why"), (1, "rejected", 3, "assistant", "so")]
    rows += [(2, "rejected", 0, "user", "x")]
    out = pair_records(format_preferences(spark.createDataFrame(rows, TURNS)))
    one, two = out.orderBy("pair_id").collect()
    assert one.prompt == "<|user|>\nq<|end|>\n" and one.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [one.chosen[a:b] for a, b in one.chosen_spans] == ["good"] and [one.rejected[a:b] for a, b in one.rejected_spans] == ["bäd", "so"]
    assert (two.prompt, two.chosen, two.rejected, two.chosen_spans, two.rejected_spans) == ("", "", "<|user|>\nx<|end|>\n", [], [])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and pair_records(format_preferences(spark.createDataFrame([], TURNS))).isEmpty()
