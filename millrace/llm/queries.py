"""The training-data queries by name, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact, lm, media, mixing, near, quality, suffix, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(media.render(_table(spark, sf_dir, "embeddings")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexities(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_bpe, op3_near_dedup, op4_warc, op5_quality, op6_exact_dedup, op7_url_filter, op8_suffix_dedup, op9_media, op10_lm_scoring)
}


def _weight_sql() -> str:
    cases = " ".join(f"WHEN '{s}' THEN {w!r}::DOUBLE" for s, w in mixing.WEIGHTS.items())
    return f"CASE source {cases} ELSE {mixing.DEFAULT_WEIGHT!r}::DOUBLE END"


ORACLE_SQL: dict[str, str] = {
    "op1_mixing": f"""
        WITH t AS (
          SELECT doc_id, source, text, md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
                 coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0)::BIGINT AS n_tokens
          FROM documents),
        q AS (
          SELECT doc_id, source, n_tokens, h,
                 (sum(n_tokens) OVER (PARTITION BY source ORDER BY h, n_tokens, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT / {_weight_sql()} AS vft
          FROM t),
        r AS (
          SELECT *, (sum(n_tokens) OVER (ORDER BY vft, source NULLS FIRST, h, n_tokens, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running
          FROM q)
        SELECT doc_id, source, n_tokens, vft AS virtual_finish, running AS running_tokens
        FROM r WHERE running <= (SELECT (sum(n_tokens)::BIGINT * {mixing.BUDGET_PERMILLE}) // 1000 FROM t)""",
    "op4_warc": warc.SQL,
    "op7_url_filter": urls.SQL,
    "op6_exact_dedup": """
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_doc_id,
               (count(*) OVER (PARTITION BY text))::BIGINT AS copies,
               doc_id = min(doc_id) OVER (PARTITION BY text) AS keep
        FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT doc_id, doc_id, 1::BIGINT, true FROM documents WHERE text IS NULL""",
}
