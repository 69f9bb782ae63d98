"""Analytics of the audit log and of retrieval quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import numbered, rank_percentiles
from .registry import Registry, Tables
from .retrieval_queries import _DOCS, _lane_sql, current_docs, lane

reg = Registry()
KEYS = ["session_id", "pid", "sequence"]

_R = "r AS (SELECT DISTINCT session_id, pid, sequence, timestamp_unix_ms, client_name, client_process, tool, arguments, duration_ms, status, error_code, response_bytes, text_content_bytes, result_count, result_count_kind, result_truncated, search_id, parent_search_id FROM audit_records)"


def records(t: Tables) -> DataFrame:
    """Each record once: repeats agree in all but the time of receipt."""
    columns = "session_id pid sequence timestamp_unix_ms client_name client_process tool arguments duration_ms status error_code response_bytes text_content_bytes result_count result_count_kind result_truncated search_id parent_search_id"
    return t.audit_records.select(*columns.split()).distinct()


def _distribution(df: DataFrame, group) -> DataFrame:
    """Counts by partial aggregation, percentiles of durations by rank in ranges: no task holds a group's values."""
    group_name = "_group"
    df = df.withColumn(group_name, group)
    counted = df.groupBy(group_name).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.count_if(F.col("duration_ms") > 1000).alias("over_1s"),
        F.count_if(F.col("response_bytes") > 102400).alias("over_100k"),
        F.countDistinct("session_id").alias("sessions"),
    )
    ranks = rank_percentiles(df, [group_name], "duration_ms", {"p50": 0.5, "p95": 0.95})
    joined = counted.alias("c").join(ranks.alias("r"), F.col(f"c.{group_name}").eqNullSafe(F.col(f"r.{group_name}")), "left")
    return joined.select(F.col(f"c.{group_name}").alias(group_name), "calls", "errors", F.col("p50").cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"), "over_1s", "over_100k", "sessions")


_DIST = "count(*) AS calls, count(*) FILTER (WHERE status <> 'ok') AS errors, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, count(*) FILTER (WHERE duration_ms > 1000) AS over_1s, count(*) FILTER (WHERE response_bytes > 102400) AS over_100k, count(DISTINCT session_id) AS sessions"


def _grouped(name: str, column: str, sql_column: str, make) -> None:
    @reg(name, f"WITH {_R} SELECT {sql_column} AS {column}, {_DIST} FROM r GROUP BY 1")
    def run(t: Tables) -> DataFrame:
        return _distribution(records(t), make()).withColumnRenamed("_group", column)


@reg("audit_distribution", f"WITH {_R} SELECT 'all' AS scope, {_DIST} FROM r")
def audit_distribution(t: Tables) -> DataFrame:
    return _distribution(records(t), F.lit("all")).withColumnRenamed("_group", "scope")


_grouped("audit_by_tool", "tool", "tool", lambda: F.col("tool"))
_grouped("audit_by_client", "client_name", "client_name", lambda: F.col("client_name"))
_grouped("audit_by_process", "client_process", "client_process", lambda: F.col("client_process"))
_grouped("audit_by_day", "day", "CAST(floor(timestamp_unix_ms / 86400000) AS BIGINT)", lambda: F.floor(F.col("timestamp_unix_ms") / 86_400_000).cast("long"))


@reg("audit_busiest", f"WITH {_R}, c AS (SELECT pid, count(*) AS calls FROM r GROUP BY pid) SELECT (SELECT count(*) FROM c) AS pids, arg_max(pid, row(calls, -pid)) AS busiest, max(calls) AS calls FROM c")
def audit_busiest(t: Tables) -> DataFrame:
    c = records(t).groupBy("pid").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("pids"), F.max_by("pid", F.struct("n", -F.col("pid"))).alias("busiest"), F.max("n").alias("calls"))


@reg("audit_linked_inspect", f"WITH {_R} SELECT tool, count(*) AS linked FROM r WHERE parent_search_id IN (SELECT search_id FROM r WHERE search_id IS NOT NULL) GROUP BY tool")
def audit_linked_inspect(t: Tables) -> DataFrame:
    r = records(t)
    found = r.where("search_id IS NOT NULL").select(F.col("search_id").alias("parent_search_id"))
    return r.join(found, "parent_search_id", "left_semi").groupBy("tool").agg(F.count("*").alias("linked"))


@reg(
    "audit_near_simultaneous",
    f"WITH {_R} SELECT pid, count(*) AS n FROM (SELECT pid, timestamp_unix_ms - lag(timestamp_unix_ms) OVER (PARTITION BY pid ORDER BY timestamp_unix_ms, session_id NULLS FIRST, sequence) AS gap FROM r WHERE tool = 'workspace_search') WHERE gap < 500 GROUP BY pid",
)
def audit_near_simultaneous(t: Tables) -> DataFrame:
    w = Window.partitionBy("pid").orderBy("timestamp_unix_ms", F.col("session_id").asc_nulls_first(), "sequence")
    gaps = records(t).where("tool = 'workspace_search'").select("pid", (F.col("timestamp_unix_ms") - F.lag("timestamp_unix_ms").over(w)).alias("gap"))
    return gaps.where("gap < 500").groupBy("pid").agg(F.count("*").alias("n"))


@reg(
    "audit_counts",
    f"WITH {_R} SELECT client_name, count(*) FILTER (WHERE tool = 'workspace_search' AND result_count = 0) AS zero_hit, count(*) FILTER (WHERE result_truncated) AS truncated, CAST(json_extract_string(arguments, '$.limit') AS BIGINT) AS lim, count(*) AS n FROM r GROUP BY ALL",
)
def audit_counts(t: Tables) -> DataFrame:
    lim = F.get_json_object("arguments", "$.limit").cast("long")
    zero = (F.col("tool") == "workspace_search") & (F.col("result_count") == 0)
    return records(t).groupBy("client_name", lim.alias("lim")).agg(F.count_if(zero).alias("zero_hit"), F.count_if("result_truncated").alias("truncated"), F.count("*").alias("n"))


@reg("audit_errors", f"WITH {_R} SELECT session_id, pid, sequence, tool, status, error_code FROM r WHERE status <> 'ok'")
def audit_errors(t: Tables) -> DataFrame:
    return records(t).where("status <> 'ok'").select(*KEYS, "tool", "status", "error_code")


@reg(
    "session_followups",
    f"""WITH {_R}, s AS (SELECT *, count(*) FILTER (WHERE tool = 'workspace_search') OVER (PARTITION BY session_id, pid ORDER BY timestamp_unix_ms, sequence) AS turn FROM r WHERE session_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, pid, turn ORDER BY timestamp_unix_ms, sequence) - 1 AS step FROM s WHERE turn > 0)
SELECT session_id, pid, turn, sequence, tool, step FROM k WHERE step BETWEEN 1 AND 3""",
)
def session_followups(t: Tables) -> DataFrame:
    """The first three calls after each search, up to the next search."""
    w = Window.partitionBy("session_id", "pid").orderBy("timestamp_unix_ms", "sequence")
    turns = records(t).where("session_id IS NOT NULL").withColumn("turn", F.count_if(F.col("tool") == "workspace_search").over(w)).where("turn > 0")
    v = Window.partitionBy("session_id", "pid", "turn").orderBy("timestamp_unix_ms", "sequence")
    return turns.withColumn("step", (F.row_number().over(v) - 1).cast("long")).where("step BETWEEN 1 AND 3").select("session_id", "pid", "turn", "sequence", "tool", "step")


@reg(
    "task_packets",
    f"""WITH {_R}, s AS (SELECT *, count(*) FILTER (WHERE tool = 'workspace_search') OVER (PARTITION BY session_id, pid ORDER BY timestamp_unix_ms, sequence) AS turn FROM r WHERE session_id IS NOT NULL)
SELECT session_id, pid, turn, count(*) AS calls, count(*) FILTER (WHERE tool = 'workspace_inspect') AS inspections, round((max(timestamp_unix_ms) - min(timestamp_unix_ms)) / 1000.0, 3) AS wall_seconds FROM s WHERE turn > 0 GROUP BY ALL""",
)
def task_packets(t: Tables) -> DataFrame:
    """Gap and island: a search opens a task that lasts to the next."""
    w = Window.partitionBy("session_id", "pid").orderBy("timestamp_unix_ms", "sequence")
    turns = records(t).where("session_id IS NOT NULL").withColumn("turn", F.count_if(F.col("tool") == "workspace_search").over(w)).where("turn > 0")
    return turns.groupBy("session_id", "pid", "turn").agg(
        F.count("*").alias("calls"), F.count_if(F.col("tool") == "workspace_inspect").alias("inspections"), F.round((F.max("timestamp_unix_ms") - F.min("timestamp_unix_ms")) / 1000.0, 3).alias("wall_seconds")
    )


@reg("task_metrics", f"WITH {_R} SELECT session_id, count(*) AS calls, count(*) FILTER (WHERE tool = 'workspace_search') AS searches, count(*) FILTER (WHERE tool = 'workspace_search') - count(DISTINCT arguments) FILTER (WHERE tool = 'workspace_search') AS repeated FROM r WHERE session_id IS NOT NULL GROUP BY session_id")
def task_metrics(t: Tables) -> DataFrame:
    search = F.col("tool") == "workspace_search"
    asked = F.when(search, F.col("arguments"))
    return records(t).where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if(search).alias("searches"), (F.count_if(search) - F.countDistinct(asked)).alias("repeated"))


@reg(
    "adoption_breakdown",
    f"""WITH {_R}, s AS (SELECT session_id, client_name, bool_or(tool = 'workspace_search') AS searched, bool_or(tool = 'workspace_inspect') AS inspected FROM r WHERE session_id IS NOT NULL GROUP BY ALL)
SELECT client_name, count(*) AS sessions, count(*) FILTER (WHERE searched) AS searched, count(*) FILTER (WHERE inspected) AS inspected, round(count(*) FILTER (WHERE inspected) * 1.0 / nullif(count(*) FILTER (WHERE searched), 0), 6) AS rate FROM s GROUP BY GROUPING SETS ((client_name), ())""",
)
def adoption_breakdown(t: Tables) -> DataFrame:
    """How far sessions got, overall and by client (the null client and the total are both null rows)."""
    s = records(t).where("session_id IS NOT NULL").groupBy("session_id", "client_name").agg(F.bool_or(F.col("tool") == "workspace_search").alias("s"), F.bool_or(F.col("tool") == "workspace_inspect").alias("i"))
    measures = [F.count("*").alias("sessions"), F.count_if("s").alias("searched"), F.count_if("i").alias("inspected"), F.round(F.count_if("i") / F.nullif(F.count_if("s"), F.lit(0)), 6).alias("rate")]
    return s.groupingSets([[F.col("client_name")], []], F.col("client_name")).agg(*measures)


@reg("audit_record_metrics", "SELECT tool, result_count_kind, count(*) AS n, CAST(sum(result_count) AS BIGINT) AS results, CAST(sum(len(top_hits)) AS BIGINT) AS hits, round(max(list_max(list_transform(top_hits, lambda h: h.score))), 6) AS best FROM audit_records GROUP BY ALL")
def audit_record_metrics(t: Tables) -> DataFrame:
    hits = F.when(F.col("top_hits").isNotNull(), F.size("top_hits"))
    return t.audit_records.groupBy("tool", "result_count_kind").agg(
        F.count("*").alias("n"), F.sum("result_count").alias("results"), F.sum(hits).alias("hits"), F.round(F.max(F.array_max(F.transform("top_hits", lambda h: h["score"]))), 6).alias("best")
    )


@reg("replay_call_dedupe", f"WITH {_R} SELECT arguments, min(timestamp_unix_ms) AS first_ms, count(*) AS n FROM r WHERE tool = 'workspace_search' GROUP BY arguments")
def replay_call_dedupe(t: Tables) -> DataFrame:
    return records(t).where("tool = 'workspace_search'").groupBy("arguments").agg(F.min("timestamp_unix_ms").alias("first_ms"), F.count("*").alias("n"))


@reg("replay_delivery_metrics", f"WITH {_R} SELECT tool, count(*) FILTER (WHERE text_content_bytes > 0) AS delivered, CAST(sum(response_bytes) AS BIGINT) AS bytes, round(avg(text_content_bytes * 1.0 / nullif(response_bytes, 0)), 6) AS share FROM r GROUP BY tool")
def replay_delivery_metrics(t: Tables) -> DataFrame:
    share = F.col("text_content_bytes") / F.nullif("response_bytes", F.lit(0))
    return records(t).groupBy("tool").agg(F.count_if(F.col("text_content_bytes") > 0).alias("delivered"), F.sum("response_bytes").alias("bytes"), F.round(F.avg(share), 6).alias("share"))


@reg("latency_window", f"WITH {_R} SELECT tool, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, max(duration_ms) AS top FROM (SELECT tool, duration_ms, row_number() OVER (PARTITION BY tool ORDER BY timestamp_unix_ms DESC, session_id NULLS FIRST, pid, sequence) AS k FROM r WHERE duration_ms IS NOT NULL) WHERE k <= 512 GROUP BY tool")
def latency_window(t: Tables) -> DataFrame:
    """Over the last 512 calls of each tool: the window is the feature."""
    w = Window.partitionBy("tool").orderBy(F.col("timestamp_unix_ms").desc(), F.col("session_id").asc_nulls_first(), "pid", "sequence")
    last = records(t).where("duration_ms IS NOT NULL").select("tool", "duration_ms", F.row_number().over(w).alias("k")).where("k <= 512")
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration_ms)").cast("long")
    return last.groupBy("tool").agg(F.count("*").alias("n"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max("duration_ms").alias("top"))


@reg("pctl_ceil_n1", "SELECT event_type, v[CAST(ceil((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def pctl_ceil_n1(t: Tables) -> DataFrame:
    """The element at the ceiling of (n - 1) q; a group of any size is numbered in ranges."""
    e = numbered(t.events.where("value IS NOT NULL").select("event_type", "value"), ["event_type"], ["value"])
    return e.where(F.col("place") == F.ceil((F.col("size") - 1) * 0.95) + 1).select("event_type", F.col("value").alias("p95"))


@reg("pctl_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def pctl_nearest_rank(t: Tables) -> DataFrame:
    e = numbered(t.events.where("value IS NOT NULL").select("event_type", "value"), ["event_type"], ["value"])
    return e.where(F.col("place") == F.greatest(F.ceil(F.col("size") * 0.95), F.lit(1))).select("event_type", F.col("value").alias("p95"))


# retrieval quality: a query is made of a file's name and symbols; the files of its name are relevant
_GOLD = "gold AS (SELECT q.file_id AS query_id, d.file_id FROM (SELECT * FROM docs WHERE file_id % 50 = 0) q JOIN docs d USING (name))"


def _gold(docs: DataFrame) -> DataFrame:
    return docs.where("file_id % 50 = 0").select(F.col("file_id").alias("query_id"), "name").join(docs.select("file_id", "name"), "name").select("query_id", "file_id")


def _quality(name: str, lane_name: str) -> None:
    @reg(
        name,
        f"""WITH {_DOCS}, {_lane_sql(lane_name)}, {_GOLD}, h AS (SELECT g.query_id, g.file_id, l.rank FROM gold g LEFT JOIN {lane_name}_lane l ON l.query_id = g.query_id AND l.file_id = g.file_id AND l.rank <= 10)
SELECT query_id, round(count(rank) * 1.0 / count(*), 6) AS recall, round(coalesce(1.0 / min(rank), 0), 6) AS mrr,
 round(coalesce(sum(CASE WHEN rank IS NOT NULL THEN 1.0 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1.0 / log2(i + 1))), 6) AS ndcg FROM h GROUP BY query_id""",
    )
    def run(t: Tables) -> DataFrame:
        docs = current_docs(t)
        hits = lane(t, lane_name, docs).where("rank <= 10").select("query_id", "file_id", "rank")
        joined = _gold(docs).join(hits, ["query_id", "file_id"], "left")
        ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.count("*"), F.lit(10).cast("long"))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
        gain = F.coalesce(F.sum(1.0 / F.log2(F.col("rank") + 1)), F.lit(0.0))
        return joined.groupBy("query_id").agg(F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"), F.round(gain / ideal, 6).alias("ndcg"))


_quality("recall_mrr_ndcg", "path")
_quality("recall_mrr_ndcg_content", "content")


@reg(
    "exp_topk_overlap",
    f"WITH {_DOCS}, {_lane_sql('path')}, {_lane_sql('content')} SELECT p.query_id, round(count(c.file_id) * 1.0 / count(*), 6) AS overlap FROM path_lane p LEFT JOIN content_lane c ON c.query_id = p.query_id AND c.file_id = p.file_id AND c.rank <= 10 WHERE p.rank <= 10 GROUP BY p.query_id",
)
def exp_topk_overlap(t: Tables) -> DataFrame:
    docs = current_docs(t)
    a = lane(t, "path", docs).where("rank <= 10").select("query_id", "file_id")
    b = lane(t, "content", docs).where("rank <= 10").select("query_id", "file_id", F.lit(1).alias("both"))
    return a.join(b, ["query_id", "file_id"], "left").groupBy("query_id").agg(F.round(F.count("both") / F.count("*"), 6).alias("overlap"))


@reg("stale_rate", "SELECT f.root_id, round(avg(CASE WHEN s.generation IS DISTINCT FROM f.generation THEN 1.0 ELSE 0.0 END), 6) AS stale FROM (SELECT DISTINCT file_id, generation FROM search_docs) s JOIN (SELECT DISTINCT id, root_id, generation FROM files) f ON f.id = s.file_id GROUP BY f.root_id")
def stale_rate(t: Tables) -> DataFrame:
    f = t.files.select(F.col("id").alias("file_id"), "root_id", F.col("generation").alias("now")).distinct()
    s = t.search_docs.select("file_id", "generation").distinct().join(f, "file_id")
    return s.groupBy("root_id").agg(F.round(F.avg(F.when(F.col("generation") != F.col("now"), 1.0).otherwise(0.0)), 6).alias("stale"))


@reg("category_metrics", f"WITH {_R} SELECT tool, client_name, round(avg(duration_ms), 4) AS mean_ms, quantile_disc(duration_ms, 0.95) AS p95 FROM r GROUP BY ALL")
def category_metrics(t: Tables) -> DataFrame:
    return records(t).groupBy("tool", "client_name").agg(F.round(F.avg("duration_ms"), 4).alias("mean_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("long").alias("p95"))


# paired comparison: two clients are the arms, a tool on a day is the task
_ARMS = f"{_R}, a AS (SELECT CASE client_name WHEN 'codex' THEN 'a' ELSE 'b' END AS arm, tool || '@' || CAST(floor(timestamp_unix_ms / 86400000) AS BIGINT) AS task, count(*) AS calls, CAST(sum(duration_ms) AS BIGINT) AS ms FROM r WHERE client_name IN ('codex', 'cursor') GROUP BY ALL), p AS (SELECT x.task, x.ms AS a_ms, y.ms AS b_ms, x.calls AS a_calls, y.calls AS b_calls FROM a x JOIN a y USING (task) WHERE x.arm = 'a' AND y.arm = 'b')"


def _pairs(t: Tables) -> DataFrame:
    r = records(t).where(F.col("client_name").isin("codex", "cursor"))
    task = F.concat_ws("@", "tool", F.floor(F.col("timestamp_unix_ms") / 86_400_000).cast("long"))
    arm = F.when(F.col("client_name") == "codex", "a").otherwise("b")
    sums = r.groupBy(task.alias("task"), arm.alias("arm")).agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("ms"))
    wide = sums.groupBy("task").pivot("arm", ["a", "b"]).agg(F.max("calls").alias("calls"), F.max("ms").alias("ms"))
    return wide.where("a_calls IS NOT NULL AND b_calls IS NOT NULL")


@reg("ab_pairing", f"WITH {_ARMS} SELECT task, a_ms, b_ms, a_calls, b_calls FROM p")
def ab_pairing(t: Tables) -> DataFrame:
    return _pairs(t).select("task", "a_ms", "b_ms", "a_calls", "b_calls")


@reg("ab_delta_stats", f"WITH {_ARMS} SELECT count(*) AS pairs, count(*) FILTER (WHERE b_ms < a_ms) AS wins, count(*) FILTER (WHERE b_ms > a_ms) AS losses, round(1 - sum(b_ms) * 1.0 / nullif(sum(a_ms), 0), 6) AS reduction, quantile_cont(a_ms - b_ms, 0.5) AS median_delta FROM p")
def ab_delta_stats(t: Tables) -> DataFrame:
    return _pairs(t).agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("b_ms") < F.col("a_ms")).alias("wins"),
        F.count_if(F.col("b_ms") > F.col("a_ms")).alias("losses"),
        F.round(1 - F.try_divide(F.sum("b_ms"), F.sum("a_ms")), 6).alias("reduction"),
        F.percentile(F.col("a_ms") - F.col("b_ms"), 0.5).alias("median_delta"),
    )


@reg("ab_arm_aggregate", f"WITH {_ARMS} SELECT arm, count(*) AS tasks, CAST(sum(calls) AS BIGINT) AS calls, round(avg(ms), 4) AS mean_ms, quantile_cont(ms, 0.5) AS median_ms FROM a GROUP BY arm")
def ab_arm_aggregate(t: Tables) -> DataFrame:
    r = records(t).where(F.col("client_name").isin("codex", "cursor"))
    task = F.concat_ws("@", "tool", F.floor(F.col("timestamp_unix_ms") / 86_400_000).cast("long"))
    sums = r.groupBy(task.alias("task"), F.when(F.col("client_name") == "codex", "a").otherwise("b").alias("arm")).agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("ms"))
    return sums.groupBy("arm").agg(F.count("*").alias("tasks"), F.sum("calls").alias("calls"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.percentile("ms", 0.5).alias("median_ms"))


@reg("ab_bootstrap_ci")
def ab_bootstrap_ci(t: Tables) -> DataFrame:
    """Seeded resamples of the paired differences, by Poisson weights: each partition of pairs adds its weighted sums to every resample."""
    pairs = _pairs(t).select((F.col("a_ms") - F.col("b_ms")).cast("double").alias("d"), F.xxhash64("task").alias("seed"))
    resamples = 1_000

    def sums(batches):
        total, weight = np.zeros(resamples), np.zeros(resamples)
        for pdf in batches:
            for d, seed in zip(pdf["d"], pdf["seed"], strict=True):
                w = np.random.default_rng(int(seed) & 0x7FFFFFFF).poisson(1.0, resamples)
                total += w * d
                weight += w
        yield pd.DataFrame({"resample": np.arange(resamples), "total": total, "weight": weight})

    means = pairs.mapInPandas(sums, "resample long, total double, weight double").groupBy("resample").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


QUERIES, SQL = reg.queries, reg.sql
