"""The registered queries of this package and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from backleaf.llm import ann, chat, classifier, licenses, mixing, packing, rules, simhash, token_output, warc
from backleaf.llm.common import new_folder

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(f):
    QUERIES[f.__name__] = f
    return f


@registered
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.apply_rules(docs, rules.MORE_RULES, measured=rules.BASE_RULES, keep_text=False)


ORACLE_SQL["op9_quality_rules"] = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS x
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM t) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) v(k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM w)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, text, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals
      FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR 10 * n_capitals > 4 * word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""


@registered
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registered
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@registered
def op10_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-matrices")
    token_output.write(table(spark, sf_dir, "documents"), path)
    return token_output.segments(spark, path)


@registered
def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")
    shards = F.expr("array_join(transform(array_sort(transform(draws, d -> d.shard)), s -> cast(s as string)), ',')")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


#: A conversation that op2 formats beside the table's, for its control strings.
TRICKY = "\\### Assistant: </turn> ok"


@registered
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    out = chat.format_chats(turns.unionByName(tricky))
    back = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    out = out.select("conv_id", "valid", "error_turn", "formatted", back.alias("back"), chat.loss_text(F.col("segments")).alias("loss_text"))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join("back", ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.coalesce("error_turn", F.lit(-1).cast("long")).alias("error_turn"),
    )


ORACLE_SQL["op2_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, lag(role, 1, '') OVER w AS prior, row_number() OVER w - 1 AS i,
             length(replace(replace(replace(text, '\', '\e'), '<turn:', '\oturn:'), '</turn>', '\c/turn>')) AS n,
             length(replace(replace(replace(replace(role, '\', '\e'), '<turn:', '\oturn:'), '</turn>', '\c/turn>'), '>', '\m')) AS m
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN prior IN ('', 'assistant') AND role = 'user' OR prior = '' AND role = 'system' AND i = 0
                      OR prior = 'system' AND role = 'user' OR prior = 'user' AND role = 'assistant' THEN NULL ELSE i END AS bad FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(6 + m + 2 + n + 8)::BIGINT AS formatted_chars,
       min(bad) IS NULL AND max_by(role, i) = 'assistant' AS valid,
       coalesce(min(bad), CASE WHEN max_by(role, i) <> 'assistant' THEN count(*) END, -1) AS error_turn
FROM f GROUP BY conv_id
"""


@registered
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", "license_id", F.array_join("notice_ids", ",").alias("notice_ids"))


ORACLE_SQL["op1_license_scan"] = licenses.scan_sql()


@registered
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.classify(docs, table(spark, sf_dir, "labels"), keep_columns=("doc_id",))


@registered
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


@registered
def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"), new_folder(spark, "warc")))


ORACLE_SQL["op8_warc_archives"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
