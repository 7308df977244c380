"""The registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, toxicity
from .chat_format import format_preferences, pair_records
from .common import ascii_lower, fold, table
from .decontaminate import find_leaks
from .jaccard import jaccard_components
from .line_dedup import line_dedup
from .lm_score import score_language_model
from .merkle import merkle_manifest, proof_text, row_digest
from .packing import pack
from .secrets import scan_secrets
from .spelling import spelling_variants
from .token_counts import count_tokens
from .topk import top_k


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, least=0.8)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=2048)


def held_out(rest: int):
    """Whether the id's remainder is ``rest``; false for a NULL id."""
    return F.coalesce(fold() == rest, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold() != 0)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out(0).alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(fold() != 0))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out(0).alias("held_out"), "lang_pred", "score", "mixture")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2i (chosen) and 2i + 1 (rejected) make pair i."""
    return format_preferences(paired_turns(spark, sf_dir))


def op9_pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs as records: a prompt and two completions, with the spans that the loss counts written as begin:end."""
    records = pair_records(format_preferences(paired_turns(spark, sf_dir)))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["begin"].cast("string"), x["end"].cast("string"))), ",")
    return records.select("pair_id", "prompt", "chosen", "rejected", *(written(f"{side}_spans").alias(f"{side}_spans") for side in ("chosen", "rejected")))


def paired_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.shiftright("conv_id", 1).alias("pair_id"),
        F.when(F.col("conv_id").bitwiseAND(1) == 0, "chosen").otherwise("rejected").alias("side"),
        "turn",
        "role",
        "text",
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language_model(table(spark, sf_dir, "documents"), learn=fold() != 1, held_out=fold() == 1)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), drop_every=199)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 5 divides the id's crc32, what is claimed is the row with its text's A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars"]
    claimed = F.when(fold() == 0, row_digest([*(F.col(n) for n in names), ascii_lower(F.col("text"))]))
    manifest = merkle_manifest(docs, [*(F.col(n) for n in names), F.col("text")], F.col("source"), claimed=claimed)
    proof = F.sha2(proof_text(F.col("lefts"), F.col("rights")), 256)
    return manifest.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified", "position")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op9_pair_records": op9_pair_records,
    "op10_lm_score": op10_lm_score,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_counts": op13_token_counts,
}

#: CTE ``p``: the turns of pairs by part.
_PAIRS = r"""
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, coalesce(role, 'user') AS role,
                  coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
u AS (SELECT pair_id, side, turn, min({'role': role, 'text': text}) AS said FROM t GROUP BY ALL),
c AS (SELECT pair_id, turn, said FROM u WHERE side = 0), r AS (SELECT pair_id, turn, said FROM u WHERE side = 1),
b AS (SELECT pair_id, turn, c.said AS c, r.said AS r FROM c FULL JOIN r USING (pair_id, turn)),
f AS (SELECT pair_id, min(turn) AS fork FROM b WHERE c IS DISTINCT FROM r GROUP BY pair_id),
p AS (SELECT pair_id, 'prompt' AS part, turn, c AS said FROM b LEFT JOIN f USING (pair_id) WHERE fork IS NULL OR turn < fork
      UNION ALL SELECT pair_id, 'chosen', turn, c FROM b JOIN f USING (pair_id) WHERE turn >= fork AND c IS NOT NULL
      UNION ALL SELECT pair_id, 'rejected', turn, r FROM b JOIN f USING (pair_id) WHERE turn >= fork AND r IS NOT NULL)"""

#: CTE with one list ``crc``: the 256 entries of the reflected CRC-32 table; and the checksum of an ASCII text.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """SQL: unsigned crc32 of a text's UTF-8 bytes, beside the CTE ``crc``."""
    codes = f"list_transform(range(1, strlen({text}) * 2, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** levels leaves: each level grouped from the one below, siblings and folds level by level."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    row = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tree(name: str, base: str) -> list[str]:
        """CTEs ``name``0 to ``name``N of (g, p, h) and ``name``top; ``base`` gives g, p, h."""
        out = [f"{name}0 AS ({base})"]
        for k in range(levels):
            grow = f"SELECT g, p // 16 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{k} WHERE g IN (SELECT g FROM {name}{k} WHERE p > 0) GROUP BY g, p // 16"
            out.append(f"{name}{k + 1} AS ({grow})")
        tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE g NOT IN (SELECT g FROM {name}{k} WHERE p > 0)" for k in range(levels + 1))
        return [*out, f"{name}top AS ({tops})"]

    def fold(name: str, start: str, sign: str) -> list[str]:
        """CTEs from ``start`` (doc_id, g, p, f, proof) up the tree ``name``: ``sign`` 0 to N."""
        out = [f"{sign}0 AS ({start})"]
        for k in range(levels):
            near = f"s.g = f.g AND s.p // 16 = f.p // 16 AND s.g IN (SELECT g FROM {name}{k + 1})"
            side = lambda test: f"coalesce(string_agg(s.h, '' ORDER BY s.p) FILTER (s.p {test} f.p), '')"
            folded = f"CASE WHEN count(s.p) = 0 THEN f.f ELSE sha256({side('<')} || f.f || {side('>')}) END"
            out.append(
                f"{sign}{k + 1} AS (SELECT doc_id, f.g, f.p // 16 AS p, {folded} AS f, f.proof || {side('<>')} AS proof "
                f"FROM {sign}{k} f LEFT JOIN {name}{k} s ON {near} GROUP BY doc_id, f.g, f.p, f.f, f.proof)"
            )
        return out

    parts = [
        _CRC_TABLE,
        f"d AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {row('text')} AS leaf, "
        f"CASE WHEN {_crc('doc_id::VARCHAR')} % 5 = 0 THEN {row(low)} ELSE {row('text')} END AS bad FROM documents, crc)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS p FROM d)",
        *tree("a", "SELECT g, p, leaf AS h FROM l"),
        *tree("b", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS p, h FROM atop"),
        *fold("a", "SELECT doc_id, g, p, bad AS f, '' AS proof FROM l", "x"),
        *fold("b", f"SELECT doc_id, 0 AS g, o.p, f, proof FROM x{levels} JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS p FROM atop) o USING (g)", "y"),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified, l.p AS position "
        f"FROM l JOIN atop t USING (g) JOIN y{levels} USING (doc_id) CROSS JOIN btop r"
    )


ORACLE = {
    "op1_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.last IS NOT NULL AND k.doc_id < f.last AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op2_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.y AS component_id
FROM n JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON n.doc_id = m.x""",
    "op9_chat_format": _PAIRS + r"""
SELECT pair_id, part, turn, said.role AS role,
       '<|' || said.role || '|>' || chr(10) || said.text || '<|end|>' || chr(10) AS rendered,
       (length(said.role) + 5)::INTEGER AS body_start, (length(said.role) + 5 + length(said.text))::INTEGER AS body_end,
       (CASE WHEN part <> 'prompt' AND said.role = 'assistant' THEN 1 ELSE 0 END)::INTEGER AS loss
FROM p""",
    "op9_pair_records": _PAIRS + r""",
w AS (SELECT pair_id, part, turn, said.role AS role, '<|' || said.role || '|>' || chr(10) || said.text || '<|end|>' || chr(10) AS rendered,
             length(said.role) + 5 AS a, length(said.role) + 5 + length(said.text) AS b FROM p),
o AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun FROM w)
SELECT pair_id, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(rendered, '' ORDER BY turn) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg((begun + a) || ':' || (begun + b), ',' ORDER BY turn) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((begun + a) || ':' || (begun + b), ',' ORDER BY turn) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_spans
FROM o GROUP BY pair_id""",
    # levenshtein() goes by bytes: U+00C0 to U+00FF become ! to ` first
    "op11_spelling_variants": f"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS k FROM t WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {_crc("id || run")} AS h FROM o, crc),
r AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n, length(word) AS l, translate(word, '{"".join(map(chr, range(0xC0, 0x100)))}', '{"".join(map(chr, range(33, 97))).replace("'", "''")}') AS s
      FROM r WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON b.l = a.l AND a.word <> b.word WHERE levenshtein(a.s, b.s) = 1
      UNION ALL SELECT a.word, b.word, b.n FROM v a JOIN v b ON b.l = a.l + 1 WHERE levenshtein(a.s, b.s) = 1
      UNION ALL SELECT a.word, b.word, b.n FROM v a JOIN v b ON b.l = a.l - 1 WHERE levenshtein(a.s, b.s) = 1),
m AS (SELECT word, count(*)::BIGINT AS n_near, min({{'x': -near_n, 'w': near}}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.x >= 5 * n THEN best.w END AS form,
             CASE WHEN -best.x >= 5 * n THEN -best.x END AS form_n FROM v LEFT JOIN m USING (word)),
c AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, max_by(root, depth) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)""",
    "op12_merkle_manifest": _merkle_sql(),
}
