"""The registered queries of the text operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, lm, ogg, oracles, pieces, quality, repair, secret_scan, simhash, suffix_dedup, trie, warc, window_dedup

#: The conversation that op1 adds, in a layout of its own; both turns say this.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(1).select(F.to_json(F.struct(F.lit(-7).alias("conv_id"), F.lit(CONTROL_TEXT).alias("prompt"), F.lit(CONTROL_TEXT).alias("response"))).alias("record"))
    records = chat.records(table(spark, sf_dir, "conversations")).union(added)
    return chat.digests(chat.format_records(records))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digests(ogg.encode(table(spark, sf_dir, "documents")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.archive(table(spark, sf_dir, "pages")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_suffix_dedup, op3_simhash, op4_substring_dedup, op5_sentencepiece, op6_ogg_media, op7_lm_score, op8_warc, op9_quality, op10_decontaminate, op11_secret_scan, op12_prefix_trie, op13_structure_repair, pipeline)
}

SQL: dict[str, str] = {
    "op11_secret_scan": oracles.SECRETS,
    "op12_prefix_trie": oracles.TRIE,
    "op13_structure_repair": oracles.REPAIR,
    "op1_chat_format": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
coded AS (
  SELECT *, replace(replace(replace(text, '\\', '\\e'), '<', '\\l'), '#', '\\h') AS body,
    replace(replace(replace(replace(role, '\\', '\\e'), '<', '\\l'), '#', '\\h'), ':', '\\c') AS head FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id""",
    "op4_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM d, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k),
bad AS (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM bad, range(13) r(o)),
words AS (SELECT doc_id, j, ws[j] AS word FROM d, unnest(range(1, len(ws) + 1)) t(j)),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.j) AS n_removed, string_agg(CASE WHEN g.j IS NULL THEN word END, ' ' ORDER BY w.j) AS kept
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.j = g.j GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, g * 5 + 1, 5))::BIGINT >> (15 - 5 * s)) % 32) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM q""",
    "op10_decontaminate": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
items AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS k FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM items),
win AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k FROM d, sizes, unnest(range(1, len(ws) - n + 2)) t(i) WHERE len(ws) >= n),
found AS (SELECT win.doc_id, win.i, win.n, items.item FROM win JOIN items ON win.n = items.n AND win.k = items.k),
hit AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM found, unnest(range(0, n)) r(o) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id""",
}
