"""Sources, sinks and the operators of continuous refresh. Event-time windows (``ext_``) are extensions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder
from ..sources.files import scan, scan_tolerant_jsonl
from ..streaming import events as E
from .registry import Registry, Tables

reg = Registry()


def _stored(df: DataFrame, kind: str) -> str:
    """The rows of a given table as text files of a format, in the shared folder."""
    path = f"{work_folder(df.sparkSession)}/scan-{uuid.uuid4().hex}.{kind}"
    if kind in ("csv", "tsv"):
        df.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)
    else:
        df.write.json(path)
    return path


reg.text("scan_parquet", "SELECT p_partkey, p_name, p_retailprice FROM {part}")
reg.text("scan_embedding_table", "SELECT DISTINCT file_id, generation FROM {chunks}")


@reg("scan_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_csv(t: Tables) -> DataFrame:
    return scan(t.spark, _stored(t.customer.select("c_custkey", "c_name", "c_acctbal"), "csv"), "c_custkey long, c_name string, c_acctbal double")


@reg("scan_tsv", "SELECT file_id, name, signature FROM symbols")
def scan_tsv(t: Tables) -> DataFrame:
    return scan(t.spark, _stored(t.symbols.select("file_id", "name", "signature"), "tsv"), "file_id long, name string, signature string")


@reg("scan_jsonl", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_jsonl(t: Tables) -> DataFrame:
    return scan(t.spark, _stored(t.events.select("event_id", "user_id", "event_type", "value", "props"), "jsonl"), "event_id long, user_id long, event_type string, value double, props string")


@reg("scan_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json(t: Tables) -> DataFrame:
    """Whole documents: the nations of a region as one array."""
    path = f"{work_folder(t.spark)}/scan-{uuid.uuid4().hex}.json"
    listed = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    listed.select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return scan(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@reg("scan_audit_jsonl", "SELECT tool, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS ms FROM audit_records GROUP BY tool")
def scan_audit_jsonl(t: Tables) -> DataFrame:
    """A log of JSON lines, read tolerantly."""
    path = _stored(t.audit_records.select("tool", "duration_ms", "status"), "jsonl")
    good, _ = scan_tolerant_jsonl(t.spark, path, "tool string, duration_ms long, status string")
    return good.groupBy("tool").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))


@reg("sink_snapshot", "SELECT generation, count(*) AS n, count(DISTINCT file_id) AS files FROM search_docs GROUP BY generation")
def sink_snapshot(t: Tables) -> DataFrame:
    """Generations as partitions: a reader of one generation reads its folder alone."""
    path = f"{work_folder(t.spark)}/snapshot-{uuid.uuid4().hex}"
    t.search_docs.select("file_id", "path", "generation").repartition("generation").write.partitionBy("generation").parquet(path)
    back = t.spark.read.parquet(path).withColumn("generation", F.col("generation").cast("long"))
    return back.groupBy("generation").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


@reg("sink_audit_log", "SELECT status, count(*) AS n FROM audit_records GROUP BY status")
def sink_audit_log(t: Tables) -> DataFrame:
    path = f"{work_folder(t.spark)}/log-{uuid.uuid4().hex}"
    t.audit_records.select("tool", "status").write.mode("append").json(path)
    return t.spark.read.schema("tool string, status string").json(path).groupBy("status").agg(F.count("*").alias("n"))


def _events(t: Tables) -> DataFrame:
    return E.stream_of(t.spark, t.sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@reg("scan_inbox", "SELECT event_id, event_type FROM events")
def scan_inbox(t: Tables) -> DataFrame:
    """A folder of event files, each read once: the stream's checkpoint keeps the receipts."""
    return E.drained(E.stream_of(t.spark, t.sf_dir, "events").select("event_id", "event_type"), "inbox")


@reg("ev_filter", "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'purchase') AND value > 10")
def ev_filter(t: Tables) -> DataFrame:
    kept = E.stream_of(t.spark, t.sf_dir, "events").where("event_type IN ('click', 'purchase') AND value > 10").select("event_id", "user_id")
    return E.drained(kept, "ev-filter")


@reg(
    "ev_debounce",
    "SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, burst",
)
def ev_debounce(t: Tables) -> DataFrame:
    """Bursts: events of a user without two hours of quiet between them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    starts = t.events.withColumn("fresh", F.when(gap.isNull() | (gap > 7_200_000_000), 1).otherwise(0))
    numbered = starts.withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", F.col("burst").cast("long").alias("burst")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


_QUEUE = "q AS (SELECT user_id AS key, count(*) AS revision, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS priority, min(ts) AS received FROM events GROUP BY user_id)"


def _queue_events(df: DataFrame) -> DataFrame:
    priority = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    return df.select(F.col("user_id").alias("key"), F.col("ts").alias("received"), priority.alias("priority"))


@reg("queue_upsert", f"WITH {_QUEUE} SELECT key, revision, priority, received FROM q")
def queue_upsert(t: Tables) -> DataFrame:
    """The queue as a fold over micro-batches."""
    return E.drained_batches(_queue_events(E.stream_of(t.spark, t.sf_dir, "events")), "queue", E.fold_queue)


@reg("queue_batch", f"WITH {_QUEUE} SELECT key, priority, received FROM q ORDER BY priority DESC, received, key LIMIT 20")
def queue_batch(t: Tables) -> DataFrame:
    """The next batch: the limit is the feature."""
    queue = E.fold_queue(None, _queue_events(t.events))
    return queue.orderBy(F.col("priority").desc(), "received", "key").limit(20).select("key", "priority", "received")


@reg("queue_ack", f"WITH {_QUEUE}, a AS (SELECT user_id AS key, count(*) AS revision FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY user_id) SELECT key, revision FROM q ANTI JOIN a USING (key, revision)")
def queue_ack(t: Tables) -> DataFrame:
    """What is left after acknowledging the revisions seen before a time: a newer event keeps its key."""
    queue = E.fold_queue(None, _queue_events(t.events))
    done = E.fold_queue(None, _queue_events(t.events.where("ts < TIMESTAMP '2024-01-29'"))).select("key", "revision")
    return queue.join(done, ["key", "revision"], "left_anti").select("key", "revision")


@reg("queue_retry", "SELECT user_id AS key, count(*) AS attempts, 1000 * (1::BIGINT << least(count(*), 8)) AS wait_ms FROM events WHERE event_type = 'error' GROUP BY user_id")
def queue_retry(t: Tables) -> DataFrame:
    failed = t.events.where("event_type = 'error'").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("attempts"))
    return failed.withColumn("wait_ms", F.expr("1000L * shiftleft(1L, CAST(least(attempts, 8) AS INT))"))


@reg("receipt_dedup", "SELECT session_id, pid, sequence, min(received_at) AS received_at FROM audit_records GROUP BY ALL")
def receipt_dedup(t: Tables) -> DataFrame:
    return t.audit_records.groupBy("session_id", "pid", "sequence").agg(F.min("received_at").alias("received_at"))


@reg("led_pending", f"WITH {_QUEUE} SELECT priority, count(*) AS pending, min(received) AS oldest FROM q GROUP BY priority")
def led_pending(t: Tables) -> DataFrame:
    return E.fold_queue(None, _queue_events(t.events)).groupBy("priority").agg(F.count("*").alias("pending"), F.min("received").alias("oldest"))


reg.text("led_scans", "SELECT r.id, (SELECT count(*) FROM {files} f WHERE f.root_id = r.id AND f.deleted) AS open_dirs FROM {roots} r")
reg.text("led_phase_advance", "SELECT r.id FROM {roots} r WHERE NOT EXISTS (SELECT 1 FROM {files} f WHERE f.root_id = r.id AND f.deleted)")
reg.text("led_state_kv", "SELECT user_id, max_by(event_type, struct(ts, event_id)) AS state FROM {events} GROUP BY user_id", "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS state FROM events GROUP BY user_id")
reg.text(
    "health_classify",
    "SELECT user_id, CASE WHEN max(ts) > TIMESTAMP '2024-01-30' THEN 'live' WHEN max(ts) > TIMESTAMP '2024-01-28' THEN 'late' ELSE 'gone' END AS health FROM {events} GROUP BY user_id",
)

@reg("ext_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def ext_tumbling(t: Tables) -> DataFrame:
    """Windows that the watermark has closed."""
    out = E.drained(E.tumbling(_events(t), "1 day", "1 hour"), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@reg(
    "ext_sliding",
    "SELECT s.start, event_type, count(*) AS n FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts)]) AS start FROM events) s GROUP BY ALL HAVING start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
)
def ext_sliding(t: Tables) -> DataFrame:
    out = E.drained(E.sliding(_events(t), "2 hours", "1 hour", "1 hour"), "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@reg(
    "ext_session",
    """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def ext_session(t: Tables) -> DataFrame:
    out = E.drained(E.sessions(_events(t), "1 hour", "1 hour"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@reg("ext_dedup_watermark", "SELECT DISTINCT event_id FROM events")
def ext_dedup_watermark(t: Tables) -> DataFrame:
    return E.drained(E.once(_events(t), ["event_id"], "1 hour").select("event_id"), "once")


QUERIES, SQL = reg.queries, reg.sql
