"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.ann import nearest_neighbours
from tidemark.llm.common import new_folder
from tidemark.llm.fingerprints import as_text, edited_fingerprints, likeness
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.sharding import shard_by_size
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_io import read_documents, write_sequences
from tidemark.llm.toxicity import fit_lexicon, score_toxicity
from tidemark.llm.url_filter import filter_urls

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    scored = score_toxicity(docs, fit_lexicon(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    placed = shard_by_size(docs, 24, size=size, group=F.xxhash64("text"), tie=F.col("doc_id"))
    return placed.select(
        "doc_id", size.cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), least=400, report_words=51)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return kept.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_read(spark, sf_dir, "documents"), tokens.default_path(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "op9-token-ids")
    manifest = write_sequences(_read(spark, sf_dir, "documents"), tokens.default_path(), folder, end_id=2)
    return read_documents(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), columns=["doc_id"])
    taken = pieces.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    out = documents.select("row_id", "doc_id", "size", "source_size", "target").join(taken, "row_id", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES, default="allow").select("page_id", "host", "path", "rule", "verdict")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule, rule_host, rule_path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')),
fits AS (
  SELECT s.page_id, r.rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC) AS k
  FROM split s JOIN rules r
    ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON f.page_id = s.page_id
"""

OP7_SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, CAST(len(w) - 2 AS BIGINT)), lambda i: array_to_string(w[i:i + 3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM lists),
counted AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
terms AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM terms a JOIN terms b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN counted p ON p.doc_id = x JOIN counted q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM counted UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT c.doc_id, c.n AS n_shingles, m.component_id FROM counted c JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) m ON m.x = c.doc_id
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_fingerprints": op2_fingerprints,
    "op3_sharding": op3_sharding,
    "op4_suffix_array": op4_suffix_array,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op8_url_filters": op8_url_filters,
    "op9_token_ids": op9_token_ids,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}
ORACLE_SQL = {"op7_ngram_join": OP7_SQL, "op8_url_filters": OP8_SQL}
