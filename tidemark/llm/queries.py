"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf_language, exact_dedup, jaccard_join, line_dedup, lm_score, mixing, quality, sharding, spelling, token_files, treap_search, url_filter
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).drop("mark")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(_table(spark, sf_dir, "documents"), Scratch(spark, "op3").path("shards"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), keep=False)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.round("_target", 6).alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


# Parameter of the query: a log of two lists' dated changes.
URL_LOG = [
    ("spam-farm.example.org", "add", "2024-01-01 00:00:00"),
    ("tionsh.example.net", "add", "2024-01-10 00:00:00"),
    ("tionsh.example.net", "remove", "2024-01-25 12:00:00"),
    ("tionsh.example.net", "add", "2024-02-14 00:00:00"),
    ("example.com", "add", "2024-02-01 00:00:00"),
    ("example.com", "remove", "2024-02-03 00:00:00"),
    ("ththth.example.org", "add", "2024-01-05 06:00:00"),
    ("ththth.example.org", "add", "2024-01-06 06:00:00"),
    ("m.tiontion.example.com", "remove", "2024-01-02 00:00:00"),
    ("m.tiontion.example.com", "add", "2024-01-20 00:00:00"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time: page k is taken as fetched 37 k minutes into 60 days from 2024-01-01."""
    log = spark.createDataFrame(URL_LOG, "entry string, action string, at string").withColumn("at", F.to_timestamp("at"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    pages = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(86400)) * 60))
    out = url_filter.filter_urls(pages, log)
    return out.select("page_id", F.col("_host").alias("host"), F.unix_seconds("fetched_at").alias("fetched_s"), F.col("_blocked").alias("blocked"), F.col("_entry").alias("entry"), F.unix_seconds("_since").alias("since_s"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op8").path("files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path("word_bpe_49k.json")), path)
    return token_files.checksums(spark, path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crf_language.held_out(F.col("doc_id"))
    tagger = crf_language.learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    out = crf_language.tag(docs.drop("lang"), tagger, runs=False)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "n_words")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.corpus_words(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_line_dedup, op3_sharding, op4_quality, op5_mixing, op6_url_filter, op7_jaccard_join, op8_token_files, op9_exact_dedup, op10_lm_score, op11_treap_search, op12_language_crf, op13_spelling_variants)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    term = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    log = ", ".join(f"('{e}', '{a}', TIMESTAMP '{t}')" for e, a, t in URL_LOG)
    return {
        "op5_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap,
      (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS goal FROM p),
l AS (SELECT *, (goal - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level, cap / weight AS full_at FROM w
      WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM l AS m WHERE level * weight <= cap ORDER BY full_at, source NULLS LAST LIMIT 1), cap)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  ((floor(rate) + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
        "op6_url_filter": f"""
WITH log(entry, action, moment) AS (VALUES {log}),
turns AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY entry ORDER BY moment) AS was FROM log) WHERE (was IS NULL AND action = 'add') OR action <> was),
spans AS (SELECT * FROM (SELECT entry, action, moment AS since, lead(moment) OVER (PARTITION BY entry ORDER BY moment) AS until FROM turns) WHERE action = 'add'),
c AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.'), '') AS host,
      1704067200 + ((page_id * 37) % 86400) * 60 AS fetched_s FROM pages),
hit AS (SELECT c.page_id, entry, since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(entry) DESC) AS k FROM c JOIN spans
      ON (c.host = entry OR c.host LIKE '%.' || entry) AND epoch(since)::BIGINT <= fetched_s AND (until IS NULL OR fetched_s < epoch(until)::BIGINT))
SELECT c.page_id, c.host, c.fetched_s::BIGINT AS fetched_s, h.entry IS NOT NULL AS blocked, h.entry, epoch(h.since)::BIGINT AS since_s
FROM c LEFT JOIN (SELECT * FROM hit WHERE k = 1) h ON c.page_id = h.page_id""",
        "op9_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""",
        "op11_treap_search": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all({fold}, '{term}') AS terms FROM documents),
p AS (SELECT k, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf, any_value(len(terms))::BIGINT AS n FROM (SELECT k, doc_id, terms, unnest(terms) AS term FROM d) GROUP BY k, term),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all({fold}, '{term}')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln(any_value(2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, k, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, k)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    }
