"""The registered queries of the corpus operators and, where SQL can express them, their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.content import current_content
from ..session import table
from .credentials import credentials, redacted
from .lookalikes import consistent_forms, same_looking_classes, same_looking_pairs
from .neighbours import search_quality, similar_pairs, similar_vectors
from .packing import pack
from .percentiles import bisect, combine, daily_counts
from .syntax import invalid_files, invalid_rates
from .tokens import decode, encode, token_counts

RECORD_KEYS = ["session_id", "pid", "sequence"]
RECORD_GROUPS = ["tool", "client_name"]
RECORD_VALUES = ["duration_ms", "response_bytes"]


def _record_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_counts(table(spark, sf_dir, "audit_records"), RECORD_KEYS, "timestamp_unix_ms", RECORD_GROUPS, RECORD_VALUES)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisect(_record_days(spark, sf_dir), RECORD_GROUPS, [50, 95, 99])


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable daily results themselves."""
    return combine(_record_days(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), offsets=True)


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that went to ids and back."""
    return decode(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(sizes, table(spark, sf_dir, "container_specs"))


def p7_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, used and total room per spec."""
    specs = table(spark, sf_dir, "container_specs").select("spec_id", "capacity_tokens")
    packed = p7_containers(spark, sf_dir)
    used = packed.groupBy("spec_id", "container_id").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    return (
        used.join(F.broadcast(specs), "spec_id")
        .groupBy("spec_id", "capacity_tokens")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum("items").alias("parts"), F.max("used").alias("fullest"))
        .withColumn("unused_share", 1 - F.col("used") / (F.col("containers") * F.col("capacity_tokens")))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "chunks"))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours themselves, with the path of each."""
    chunks = table(spark, sf_dir, "chunks")
    paths = chunks.groupBy(F.col("chunk_id").alias("other")).agg(F.min("path").alias("path"))
    return similar_vectors(chunks).join(paths, "other").select(F.col("id").alias("chunk_id"), F.col("other").alias("near_chunk_id"), F.col("path").alias("near_path"), F.round("cosine", 6).alias("cosine"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the search goes and the recall that held-out queries reach with it, against brute force over all rows."""
    return search_quality(table(spark, sf_dir, "chunks"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(table(spark, sf_dir, "documents"))


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as classes: one row a document, with the number of its links."""
    return same_looking_classes(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visible text in its consistent form."""
    return consistent_forms(table(spark, sf_dir, "documents"), with_text=True).select("doc_id", "form")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_content(table(spark, sf_dir, "files"), table(spark, sf_dir, "search_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(_current(spark, sf_dir))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per root and language."""
    return invalid_rates(_current(spark, sf_dir))


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, docs = table(spark, sf_dir, "files"), table(spark, sf_dir, "search_docs")
    return credentials(files, docs, _current(spark, sf_dir))


def p5_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential with its place in the line and its score."""
    return _credentials(spark, sf_dir).drop("path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_places(spark, sf_dir).select("file_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current content and every path of a file that is not deleted with its credentials blanked."""
    return redacted(_current(spark, sf_dir), _credentials(spark, sf_dir), table(spark, sf_dir, "files"))


QUERIES = {
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_places": p5_places,
    "p5_redacted": p5_redacted,
    "p2_found": p2_found,
    "p2_neighbours": p2_neighbours,
    "p2_recall": p2_recall,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_forms": p8_forms,
    "p3_percentiles": p3_percentiles,
    "p3_daily": p3_daily,
    "p6_ids": p6_ids,
    "p6_offsets": p6_offsets,
    "p6_decoded": p6_decoded,
    "p7_containers": p7_containers,
    "p7_waste": p7_waste,
}

_ONCE = """
once AS (
  SELECT tool, client_name, day, duration_ms, response_bytes FROM (
    SELECT session_id, pid, sequence, tool, client_name, CAST(floor(timestamp_unix_ms / 86400000) AS BIGINT) AS day,
           max(duration_ms) AS duration_ms, max(response_bytes) AS response_bytes
    FROM audit_records WHERE timestamp_unix_ms IS NOT NULL GROUP BY ALL)),
v AS (
  SELECT tool, client_name, day, 'duration_ms' AS measure, duration_ms AS v FROM once WHERE duration_ms IS NOT NULL
  UNION ALL
  SELECT tool, client_name, day, 'response_bytes', response_bytes FROM once WHERE response_bytes IS NOT NULL)"""

SQL = {
    "p3_daily": f"WITH {_ONCE} SELECT day, tool, client_name, measure, v AS value, count(*) AS n FROM v GROUP BY ALL",
    "p3_percentiles": f"""
WITH {_ONCE},
r AS (SELECT tool, client_name, measure, v, count(*) OVER (PARTITION BY tool, client_name, measure) AS n, row_number() OVER (PARTITION BY tool, client_name, measure ORDER BY v) AS k
      FROM v)
SELECT tool, client_name, measure, percent, n, v AS value, 0::BIGINT AS error_bound FROM r, (VALUES (50.0::DOUBLE), (95.0::DOUBLE), (99.0::DOUBLE)) AS p(percent)
WHERE k = greatest(ceil(n * percent / 100.0), 1)""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
