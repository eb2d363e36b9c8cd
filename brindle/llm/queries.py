"""Queries over the supplied tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, common, decontam, mixing, neardup, quality_knn, quality_rules, secrets, tokens, toxicity, warc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(common.table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return tokens.encode_documents(docs, common.new_path(spark, "tokens"), tokenizer_path())


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.contract(common.table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(common.table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(common.table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(common.table(spark, sf_dir, "pages"), common.new_path(spark, "warc"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.contract(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_token_binary, op4_minhash_neardup, op5_quality_rules, op6_secret_scans, op7_decontamination, op8_chat_formatting, op9_warc, op10_quality_classifier)}



def _quality_sql() -> str:
    """The counts, votes, rounds of expectation-maximisation and verdicts of op5."""
    rules = [
        "n_symbols * 20 > n_words", "n_letters * 100 < 80 * word_chars", "(n_symbols - n_bars) * 6 > n_words", "n_bars * 8 > n_words", "n_upper * 4 > word_chars",
        "n_loud * 10 > n_words", "n_dup_lines * 4 > n_lines", "n_repeat_words * 10 > n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    ]
    spelled, calm = "n_letters * 100 >= 88 * word_chars AND n_symbols * 100 <= n_words", "n_upper * 8 <= word_chars AND n_loud * 20 <= n_words"
    fresh = "n_repeat_words * 20 <= n_words AND n_dup_lines * 8 <= n_lines"
    votes = [f"CASE WHEN {r} THEN -1 ELSE 0 END" for r in rules] + [f"CASE WHEN {r} THEN 1 ELSE 0 END" for r in (f"{spelled} AND {calm} AND {fresh} AND n_words >= 10", f"n_words >= 60 AND {spelled} AND {fresh}")]
    right = [f"least(0.999, greatest(0.55, (sum(CASE WHEN v[{j}] > 0 THEN g * n WHEN v[{j}] < 0 THEN (1 - g) * n ELSE 0 END) + 9) / (sum(CASE WHEN v[{j}] <> 0 THEN n ELSE 0 END) + 10)))" for j in range(1, len(votes) + 1)]
    odds = " + ".join(["ln(prior / (1 - prior))", *(f"v[{j}] * ln(a[{j}] / (1 - a[{j}]))" for j in range(1, len(votes) + 1))])
    start = ", ".join(["CAST(0.9 AS DOUBLE)"] * len(votes))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), p AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), q AS (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1
), r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM q GROUP BY doc_id
), f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '[!?]')) AS n_loud,
    len(regexp_extract_all(t, '\|')) AS n_bars, len(regexp_extract_all(t, '\p{{L}}')) AS n_letters
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id
), s AS (SELECT *, [{", ".join(votes)}] AS v FROM f
), c AS (SELECT v, count(*) AS n FROM s GROUP BY v
), em(k, prior, a) AS (
  SELECT 0, CAST(0.8 AS DOUBLE), [{start}]
  UNION ALL
  SELECT k + 1, (sum(g * n) + 8) / (sum(n) + 10), [{", ".join(right)}]
  FROM (SELECT k, v, n, 1 / (1 + exp(-({odds}))) AS g FROM em, c WHERE k < 25) GROUP BY k
), x AS (
  SELECT s.*, 1 / (1 + exp(-({odds}))) AS posterior, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s, (SELECT prior, a FROM em WHERE k = 25)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 6) AS posterior FROM x
"""


ORACLE_SQL = {
    "op5_quality_rules": _quality_sql(),
    "op4_minhash_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s
), x AS (SELECT doc_id, unnest(s) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.seen
)
SELECT n.doc_id, max(n.n) AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id
""",
    "op7_decontamination": r"""
WITH i AS (
  SELECT item_id, w, least(len(w), 5) AS width FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0
), si AS (
  SELECT item_id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda j: list_aggregate(w[j : j + width - 1], 'string_agg', ' ')))) AS g FROM i
), ni AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id
), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents
), sd AS (
  SELECT doc_id, width, unnest(list_distinct(list_transform(range(1, len(w) - width + 2), lambda j: list_aggregate(w[j : j + width - 1], 'string_agg', ' ')))) AS g
  FROM d, (SELECT DISTINCT width FROM i) WHERE len(w) >= width
)
SELECT sd.doc_id, si.item_id, CAST(max(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared
FROM sd JOIN si USING (width, g) JOIN ni ON ni.item_id = si.item_id GROUP BY sd.doc_id, si.item_id HAVING 100 * count(*) >= 80 * max(n)
""",
    "op8_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *,
    CASE WHEN regexp_matches(role, '[<\[]\\*/?(s>|INST\])') OR regexp_matches(text, '[<\[]\\*/?(s>|INST\])')
      THEN length(regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g'))
         + length(regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g'))
      ELSE length(role) + length(text) END + 10 + 9 + 5 AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""",
}
