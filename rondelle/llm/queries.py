"""The registered queries of this subpackage, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place, shard_names

    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shard_names())


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .warc import captures_of, resolve_revisits

    out = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    header = lambda name: F.coalesce(F.col("headers")[name], F.col("headers")[name.capitalize()]).alias(name)
    return out.select("record_id", "canonical_url", "kind", "at", "refers_to", "outcome", header("date"), header("server"), F.size("headers").cast("bigint").alias("n_headers"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import group_ids

    return group_ids(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_round_trip

    return token_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_tables import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = [op1_fingerprints, op2_simhash_near_dedup, op3_sharding, op4_warc_revisits, op5_exact_dedup, op6_best_fit_packing, op7_token_files, op8_bpe_word_table, op9_token_counts, op10_quality]
    return {f.__name__: f for f in each}


OP5_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


def op3_sql() -> str:
    """The lookup table as a list, and one lookup for each row."""
    from .sharding import SHARDS, SLOTS, lookup_table, shard_names

    slots = lookup_table(shard_names(SHARDS), SLOTS)
    return f"""
SELECT doc_id, slot, 'shard-' || lpad(CAST(shards[slot + 1] AS VARCHAR), 5, '0') AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents),
     (SELECT [{",".join(map(str, slots))}] AS shards)
"""


OP4_SQL = r"""
WITH a AS (SELECT page_id, '"' || sha256(coalesce(html, '')) || '"' AS etag, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
b AS (SELECT page_id, etag, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
             regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g') AS rest FROM a),
c AS (SELECT page_id, etag, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/index[.]html?$', '/'), '/+$', '') AS canonical_url FROM b),
r AS (SELECT 2 * page_id AS record_id, canonical_url, page_id AS "at", 'response' AS kind, etag, page_id FROM c
      UNION ALL SELECT 2 * page_id + 1, canonical_url, page_id + (SELECT max(page_id) + 1 FROM pages), 'revisit', etag, page_id FROM c),
f AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY "at", record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM r),
o AS (SELECT f.*, CASE WHEN f.kind = 'response' THEN 'full' WHEN found IS NULL THEN 'missing' WHEN s.etag = f.etag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM f LEFT JOIN c s ON found = 2 * s.page_id)
SELECT record_id, canonical_url, kind, "at", CASE WHEN outcome = 'resolved' THEN found END AS refers_to, outcome,
       CASE WHEN kind = 'response' THEN 'd' ELSE 'e' END || page_id AS date,
       CASE WHEN kind = 'response' OR outcome = 'resolved' THEN 'one' ELSE 'two' END AS server,
       CAST(CASE WHEN kind = 'response' OR outcome = 'resolved' THEN 3 ELSE 2 END AS BIGINT) AS n_headers
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": op3_sql(), "op4_warc_revisits": OP4_SQL, "op5_exact_dedup": OP5_SQL}
