"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, decontaminate, lm_scoring, packing, quality_classifier, quality_rules, simhash_dedup, token_counts, token_files, url_filter
from sparkloom.llm._common import scratch_path, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Conversation -7: a text that holds the control strings of common templates.
PROBE = "</s>[INST] ok [/INST]"

#: The filter list of the pages table: action, host, path.
URL_RULES = [
    url_filter.UrlRule("block", "com", "/en/"),
    url_filter.UrlRule("allow", "example.com", "/en/7"),
    url_filter.UrlRule("allow", "net", "/de/"),
    url_filter.UrlRule("block", "example.net", "/de/8"),
    url_filter.UrlRule("block", "org", "/es/"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), *token_counts.sentence_pieces(PIECES))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    probe = spark.range(2).select(F.lit(-7).cast(kind).alias("conv_id"), F.col("id").cast(turn).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    read = chat_format.read_back(chat_format.format_conversations(chat_format.table_events(rows.unionByName(probe))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace(@, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP2_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.replace("@", "role")}) + length({_ESCAPED.replace("@", "text")}) + {len(chat_format.OPEN + chat_format.ROLE_END + chat_format.CLOSE)}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    stats = F.col("__quality_s")
    return judged.select(
        "doc_id",
        stats.count_words.alias("n_words"),
        stats.count_word_chars.alias("word_chars"),
        stats.count_n_symbols.alias("n_symbols"),
        stats.count_n_dup_lines.alias("n_dup_lines"),
        stats.count_n_repeat_words.alias("n_repeat_words"),
        F.col("__quality_failed").alias("base_failed"),
        F.col("__quality_kept").alias("kept"),
        F.col("__quality_rule").alias("rule"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # without doc_id there is no remainder, and no label
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), keep=~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_classifier.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=1)
    return token_files.read_token_files(spark, path).drop("ids")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "url_verdict.*")


OP10_SQL = r"""
WITH rules(action, rule_host, rule_path) AS (VALUES
    ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, action,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS nth
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.nth = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_chat_format": op2_chat_format,
        "op3_quality_rules": op3_quality_rules,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_decontaminate": op5_decontaminate,
        "op6_simhash_dedup": op6_simhash_dedup,
        "op7_token_files": op7_token_files,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op10_url_filter": OP10_SQL}
