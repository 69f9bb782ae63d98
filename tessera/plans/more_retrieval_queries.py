"""Filters, merges, budgets and evaluation around the retrieval lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..operators.joins import ancestors, longest_prefix_owner
from ..operators.ranges import rank_percentiles
from .registry import Registry, Tables
from .retrieval_queries import _DOCS, _LEX, _VECTOR, _fused_sql, _lane, _lane_sql, asked, current_docs, lane, lanes, semantic, stored_docs
from .telemetry_queries import _GOLD, _R, _gold, records

reg = Registry()

_NOTES = "docs AS (SELECT doc_id AS file_id, concat_ws(' ', regexp_extract(path, '[^/]*$'), text) AS content FROM documents WHERE text IS NOT NULL AND {0}), queries AS (SELECT doc_id AS query_id, regexp_extract(path, '[^/]*$') AS query FROM documents WHERE path IS NOT NULL AND doc_id % 50 = 0)"


def _notes(t: Tables, where: str) -> tuple[DataFrame, DataFrame]:
    docs = t.documents.where("text IS NOT NULL").where(where).select(F.col("doc_id").alias("file_id"), F.concat_ws(" ", X.base_name(F.col("path")), "text").alias("content"))
    queries = t.documents.where("path IS NOT NULL AND doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), X.base_name(F.col("path")).alias("query"))
    return docs, queries


def _note_lane(name: str, where: str) -> None:
    @reg(name, f"WITH {_NOTES.format(where)}, {_lane('content', 'content')} SELECT query_id, file_id, score, rank FROM content_lane")
    def run(t: Tables) -> DataFrame:
        docs, queries = _notes(t, where)
        return R.bm25_lane(docs, queries, F.col("content"), 100).select("query_id", "file_id", "score", F.col("rank").cast("long").alias("rank"))


_note_lane("lane_agent", "kind = 'agent_skill'")
_note_lane("lane_memory", "kind = 'agent_memory'")
_note_lane("base_lane_exclusion", "kind NOT IN ('agent_skill', 'agent_memory')")
_note_lane("lex_lane", "true")


@reg("visibility_filter", f"WITH {_DOCS}, {_lane('content', 'content', where="kind <> 'tabular' AND NOT (path = '/ws/ledger-forge' OR starts_with(path, '/ws/ledger-forge/'))")} SELECT query_id, file_id, score FROM content_lane")
def visibility_filter(t: Tables) -> DataFrame:
    """Kinds and subtrees that a shard hides are out before ranking."""
    docs = current_docs(t)
    hidden = F.array_contains(ancestors(F.col("path")), "/ws/ledger-forge") | (F.col("kind") == "tabular")
    return R.bm25_lane(docs.where(~hidden), asked(docs), F.col("content"), 100).select("query_id", "file_id", "score")


@reg(
    "path_coverage_boost",
    f"WITH {_DOCS}, {_lane_sql('path')} SELECT query_id, file_id, round(score + {R.COVERAGE_WEIGHT} * CASE WHEN len({_LEX.format('q.query')}) = 0 THEN 0 ELSE len(list_intersect({_LEX.format('q.query')}, {_LEX.format('d.path')})) * 1.0 / len({_LEX.format('q.query')}) END, 6) AS score FROM path_lane JOIN queries q USING (query_id) JOIN docs d USING (file_id)",
)
def path_coverage_boost(t: Tables) -> DataFrame:
    docs = current_docs(t)
    hits = lane(t, "path", docs).join(asked(docs), "query_id").join(docs.select("file_id", "path"), "file_id")
    return hits.select("query_id", "file_id", F.round(F.col("score") + R.COVERAGE_WEIGHT * X.token_coverage(F.col("query"), F.col("path")), 6).alias("score"))


@reg("kind_filter_post", f"WITH {_DOCS}, {_lane_sql('content')} SELECT query_id, file_id, score FROM content_lane JOIN docs USING (file_id) WHERE kind IN ('source', 'text')")
def kind_filter_post(t: Tables) -> DataFrame:
    docs = current_docs(t)
    kept = docs.where(F.col("kind").isin("source", "text")).select("file_id")
    return lane(t, "content", docs).join(kept, "file_id", "left_semi").select("query_id", "file_id", "score")


@reg("scope_filter_post", f"WITH {_DOCS}, {_lane_sql('content')} SELECT query_id, file_id, score FROM content_lane JOIN docs d USING (file_id) WHERE EXISTS (SELECT 1 FROM roots r WHERE r.id % 2 = 0 AND starts_with(d.path, r.path || '/'))")
def scope_filter_post(t: Tables) -> DataFrame:
    docs = current_docs(t)
    scopes = t.roots.where("id % 2 = 0").select(F.col("path").alias("scope"))
    inside = docs.select("file_id", F.explode(ancestors(F.col("path"))).alias("scope")).join(scopes, "scope", "left_semi").select("file_id")
    return lane(t, "content", docs).join(inside, "file_id", "left_semi").select("query_id", "file_id", "score")


@reg("recency_decay", "SELECT doc_id, round(0.005 / (1 + greatest(epoch(TIMESTAMP '2026-06-01') - epoch(ingested_at), 0) / 86400.0 / 30), 9) AS boost FROM documents WHERE kind = 'agent_memory' AND ingested_at IS NOT NULL")
def recency_decay(t: Tables) -> DataFrame:
    """Decay by age against a given time, not the clock."""
    days = F.greatest(F.lit(1_780_272_000) - F.unix_micros(F.col("ingested_at").cast("timestamp")) / 1e6, F.lit(0)) / 86400.0
    return t.documents.where("kind = 'agent_memory' AND ingested_at IS NOT NULL").select("doc_id", F.round(0.005 / (1 + days / 30), 9).alias("boost"))


_MEMORY_LANE = _lane("memory", "content").replace("FROM docs", "FROM notes")


@reg(
    "memory_merge",
    f"""WITH {_DOCS}, {_lane_sql('path')}, notes AS (SELECT doc_id AS file_id, concat_ws(' ', regexp_extract(path, '[^/]*$'), text) AS content FROM documents WHERE kind = 'agent_memory' AND text IS NOT NULL), {_MEMORY_LANE},
m AS (SELECT query_id, 'file' AS source, file_id, round({R.WEIGHTS['path']} / ({R.RRF_K} + rank), 9) AS score FROM path_lane UNION ALL SELECT query_id, 'note', file_id, round({R.WEIGHTS['memory']} / ({R.RRF_K} + rank) * 0.1, 9) FROM memory_lane)
SELECT query_id, source, file_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, file_id) AS rank FROM m""",
)
def memory_merge(t: Tables) -> DataFrame:
    """Hits among files and among notes as one list; where notes are only some of the kinds they count a tenth."""
    docs = stored_docs(t)
    notes = t.documents.where("kind = 'agent_memory' AND text IS NOT NULL").select(F.col("doc_id").alias("file_id"), F.concat_ws(" ", X.base_name(F.col("path")), "text").alias("content"))
    queries = asked(docs)
    of_notes = R.lane_ranks(R.posting_index(notes, {"memory": F.col("content")}), queries.withColumn("lane", F.lit("memory")), 100)
    part = lambda name, weight: F.round(R.WEIGHTS[name] / (R.RRF_K + F.col("rank")) * weight, 9).alias("score")
    both = lanes(("path",), docs).select("query_id", F.lit("file").alias("source"), "file_id", part("path", 1.0)).unionByName(of_notes.select("query_id", F.lit("note").alias("source"), "file_id", part("memory", 0.1)))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "source", "file_id")
    return both.withColumn("rank", F.row_number().over(order).cast("long"))


@reg("memory_scope", "SELECT d.doc_id, max(r.path) AS owner FROM documents d LEFT JOIN roots r ON starts_with(d.path, r.path || '/') WHERE d.kind = 'agent_memory' AND d.path IS NOT NULL GROUP BY d.doc_id")
def memory_scope(t: Tables) -> DataFrame:
    notes = t.documents.where("kind = 'agent_memory' AND path IS NOT NULL").select("doc_id", "path")
    return longest_prefix_owner(notes, t.roots.select(F.col("path").alias("root"))).select("doc_id", F.col("root").alias("owner"))


@reg("local_remote_partition", "SELECT DISTINCT f.id, EXISTS (SELECT 1 FROM roots r WHERE r.last_completed_generation IS NOT NULL AND starts_with(f.absolute_path, r.path || '/')) AS watchable FROM files f")
def local_remote_partition(t: Tables) -> DataFrame:
    owned = longest_prefix_owner(t.files.select("id", F.col("absolute_path").alias("path")).distinct(), t.roots.where("last_completed_generation IS NOT NULL").select(F.col("path").alias("root")))
    return owned.select("id", F.col("root").isNotNull().alias("watchable")).distinct()


@reg(
    "snippet",
    rf"""WITH {_DOCS}, {_lane_sql('content')}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM docs),
h AS (SELECT query_id, file_id, n, line, len(list_intersect({_LEX.format('line')}, {_LEX.format('q.query')})) AS hits FROM content_lane JOIN queries q USING (query_id) JOIN l USING (file_id) WHERE rank <= 5)
SELECT query_id, file_id, arg_max(line, row(hits, -n)) AS snippet FROM h GROUP BY ALL""",
)
def snippet(t: Tables) -> DataFrame:
    """Of each of the first hits the line with most words of the query, the first of equals."""
    docs = current_docs(t)
    queries = asked(docs)
    hits = lane(t, "content", docs).where("rank <= 5").join(queries, "query_id").join(docs.select("file_id", "content"), "file_id")
    lines = hits.select("query_id", "file_id", X.lexical_tokens(F.col("query")).alias("q"), F.posexplode(F.split("content", "\n")).alias("n", "line"))
    score = F.size(F.array_intersect(X.lexical_tokens(F.col("line")), "q"))
    return lines.groupBy("query_id", "file_id").agg(F.max_by("line", F.struct(score, -F.col("n"))).alias("snippet"))


@reg("limit_compaction", "SELECT lim, least(lim, 20) AS served, count(*) AS n FROM (SELECT CAST(json_extract_string(arguments, '$.limit') AS BIGINT) AS lim FROM audit_records WHERE tool = 'workspace_search') WHERE lim BETWEEN 1 AND 50 GROUP BY ALL")
def limit_compaction(t: Tables) -> DataFrame:
    lim = F.get_json_object("arguments", "$.limit").cast("long").alias("lim")
    return t.audit_records.where("tool = 'workspace_search'").select(lim).where("lim BETWEEN 1 AND 50").groupBy("lim", F.least(F.col("lim"), F.lit(20)).alias("served")).agg(F.count("*").alias("n"))


#: Columns of a schema that are shown, characters of a name and of a type, and of all together.
_COLUMNS, _NAME, _TYPE, _SCHEMA = 500, 256, 512, 16_384


@reg(
    "schema_truncate",
    f"SELECT file_id, name, type FROM (SELECT file_id, name, type, row_number() OVER w AS k, sum(length(name) + length(type)) OVER w AS used FROM (SELECT DISTINCT file_id, left(name, {_NAME}) AS name, left(coalesce(signature, ''), {_TYPE}) AS type FROM symbols) WINDOW w AS (PARTITION BY file_id ORDER BY name, type ROWS UNBOUNDED PRECEDING)) WHERE used <= {_SCHEMA} AND k <= {_COLUMNS}",
)
def schema_truncate(t: Tables) -> DataFrame:
    """Names with their types in order until their running length or number passes its bound."""
    order = Window.partitionBy("file_id").orderBy("name", "type")
    rows = t.symbols.select("file_id", F.substring("name", 1, _NAME).alias("name"), F.substring(F.coalesce("signature", F.lit("")), 1, _TYPE).alias("type")).distinct()
    used = F.sum(F.length("name") + F.length("type")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).withColumn("k", F.row_number().over(order)).where((F.col("used") <= _SCHEMA) & (F.col("k") <= _COLUMNS)).select("file_id", "name", "type")


def _quality(hits: DataFrame, docs: DataFrame) -> DataFrame:
    return _gold(docs).join(hits.where("rank <= 10").select("query_id", "file_id", "rank"), ["query_id", "file_id"], "left")


for _name, _measure, _sql in (
    ("recall_at_10", lambda: F.count("rank") / F.count("*"), "count(rank) * 1.0 / count(*)"),
    ("mrr", lambda: F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), "coalesce(1.0 / min(rank), 0)"),
):

    def _measured(name: str, measure, sql: str) -> None:
        @reg(name, f"WITH {_DOCS}, {_lane_sql('path')}, {_GOLD} SELECT g.query_id, round({sql}, 6) AS value FROM gold g LEFT JOIN path_lane l ON l.query_id = g.query_id AND l.file_id = g.file_id AND l.rank <= 10 GROUP BY g.query_id")
        def run(t: Tables) -> DataFrame:
            docs = current_docs(t)
            return _quality(lane(t, "path", docs), docs).groupBy("query_id").agg(F.round(measure(), 6).alias("value"))

    _measured(_name, _measure, _sql)


@reg("vector_rank_eval", f"WITH {_DOCS}, {_VECTOR}, {_GOLD} SELECT g.query_id, count(l.rank) AS found, min(l.rank) AS first_rank FROM gold g LEFT JOIN semantic_lane l ON l.query_id = g.query_id AND l.file_id = g.file_id AND l.rank <= 10 GROUP BY g.query_id")
def vector_rank_eval(t: Tables) -> DataFrame:
    return _quality(semantic(t), current_docs(t)).groupBy("query_id").agg(F.count("rank").alias("found"), F.min("rank").cast("long").alias("first_rank"))


@reg("rrf_two_list", f"WITH {_DOCS}, {_lane_sql('path')}, {_lane_sql('content')}, {_fused_sql(('path', 'content'))} SELECT query_id, file_id, score FROM fused")
def rrf_two_list(t: Tables) -> DataFrame:
    return R.fuse(lanes(("path", "content"), stored_docs(t))).select("query_id", "file_id", "score")


@reg(
    "exp_hybrid_eval",
    f"WITH {_DOCS}, {_lane_sql('path')}, {_VECTOR}, {_fused_sql(('path', 'semantic'))}, {_GOLD}, r AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM fused) SELECT g.query_id, round(count(r.rank) * 1.0 / count(*), 6) AS recall FROM gold g LEFT JOIN r ON r.query_id = g.query_id AND r.file_id = g.file_id AND r.rank <= 10 GROUP BY g.query_id",
)
def exp_hybrid_eval(t: Tables) -> DataFrame:
    docs = current_docs(t)
    fused = R.best(R.fuse(lanes(("path",), docs), semantic(t).withColumn("lane", F.lit("semantic"))), 10)
    return _quality(fused, docs).groupBy("query_id").agg(F.round(F.count("rank") / F.count("*"), 6).alias("recall"))


@reg("cosine_summary", "SELECT a.label, round(min(c), 5) AS low, round(quantile_cont(c, 0.5), 5) AS p50, round(avg(c), 5) AS mean, round(quantile_cont(c, 0.95), 5) AS p95 FROM (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a GROUP BY a.label")
def cosine_summary(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", "label", X.unit_vector(F.col("embedding")).alias("u"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), X.unit_vector(F.col("embedding")).alias("v"))
    c = a.join(b, "vec_id").select("label", X.dot(F.col("u"), F.col("v")).alias("c"))
    return c.groupBy("label").agg(F.round(F.min("c"), 5).alias("low"), F.round(F.percentile("c", 0.5), 5).alias("p50"), F.round(F.avg("c"), 5).alias("mean"), F.round(F.percentile("c", 0.95), 5).alias("p95"))


@reg("leakage_check", "SELECT d.doc_id FROM documents d SEMI JOIN (SELECT path FROM search_docs WHERE contains(path, '/tests/') OR contains(path, '/examples/')) e ON d.path = e.path")
def leakage_check(t: Tables) -> DataFrame:
    held = t.search_docs.where(F.col("path").contains("/tests/") | F.col("path").contains("/examples/")).select("path").distinct()
    return t.documents.join(held, "path", "left_semi").select("doc_id")


@reg("hard_negative_select", "SELECT path FROM (SELECT DISTINCT absolute_path AS path, contains(name, 'token') AS required FROM files) ORDER BY required DESC, sha256(path), path LIMIT 200")
def hard_negative_select(t: Tables) -> DataFrame:
    """The required files first, then others in the order of their digests: the limit is the feature."""
    files = t.files.select(F.col("absolute_path").alias("path"), F.col("name").contains("token").alias("required")).distinct()
    return files.orderBy(F.col("required").desc(), F.sha2("path", 256), "path").limit(200).select("path")


@reg("path_suffix_match", "SELECT DISTINCT id FROM files WHERE absolute_path = relative_path OR ends_with(absolute_path, '/' || relative_path)")
def path_suffix_match(t: Tables) -> DataFrame:
    fit = (F.col("absolute_path") == F.col("relative_path")) | F.endswith("absolute_path", F.concat(F.lit("/"), "relative_path"))
    return t.files.where(fit).select("id").distinct()


@reg(
    "followup_flags",
    f"""WITH {_R}, hits AS (SELECT DISTINCT a.search_id, f.absolute_path AS path FROM (SELECT search_id, unnest(top_hits).file_id AS file_id FROM audit_records WHERE search_id IS NOT NULL) a JOIN files f ON f.id = a.file_id)
SELECT r.session_id, r.pid, r.sequence, EXISTS (SELECT 1 FROM hits h WHERE h.search_id = r.parent_search_id AND h.path = json_extract_string(r.arguments, '$.path')) AS returned FROM r WHERE r.parent_search_id IS NOT NULL""",
)
def followup_flags(t: Tables) -> DataFrame:
    """Whether the file of a follow-up was among the hits of its search."""
    paths = t.files.select(F.col("id").alias("file_id"), F.col("absolute_path").alias("path")).distinct()
    hits = t.audit_records.where("search_id IS NOT NULL").select(F.col("search_id").alias("parent_search_id"), F.explode("top_hits.file_id").alias("file_id")).distinct().join(paths, "file_id").select("parent_search_id", "path").distinct()
    follow = records(t).where("parent_search_id IS NOT NULL").withColumn("path", F.get_json_object("arguments", "$.path"))
    return follow.join(hits.withColumn("hit", F.lit(True)), ["parent_search_id", "path"], "left").select("session_id", "pid", "sequence", F.coalesce("hit", F.lit(False)).alias("returned"))


@reg("ab_scope_violations", f"WITH {_R} SELECT DISTINCT client_name, json_extract_string(arguments, '$.path') AS path FROM r WHERE json_extract_string(arguments, '$.path') IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roots WHERE starts_with(json_extract_string(r.arguments, '$.path'), roots.path || '/'))")
def ab_scope_violations(t: Tables) -> DataFrame:
    """Paths asked for that lie under no root: an anti join on the ancestors of a path."""
    asked_for = records(t).select("client_name", F.get_json_object("arguments", "$.path").alias("path")).where("path IS NOT NULL").distinct()
    inside = asked_for.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(t.roots.select(F.col("path").alias("root")), "root", "left_semi").select("path")
    return asked_for.join(inside, "path", "left_anti").select("client_name", "path")


@reg("ab_tool_metrics", f"WITH {_R} SELECT client_name, count(*) FILTER (WHERE tool = 'workspace_search') AS searches, count(*) FILTER (WHERE tool = 'workspace_inspect') AS inspections, count(*) FILTER (WHERE tool = 'workspace_query' AND regexp_matches(lower(json_extract_string(arguments, '$.sql')), 'group by')) AS grouped FROM r GROUP BY client_name")
def ab_tool_metrics(t: Tables) -> DataFrame:
    grouped = (F.col("tool") == "workspace_query") & F.lower(F.get_json_object("arguments", "$.sql")).rlike("group by")
    return records(t).groupBy("client_name").agg(F.count_if(F.col("tool") == "workspace_search").alias("searches"), F.count_if(F.col("tool") == "workspace_inspect").alias("inspections"), F.count_if(grouped).alias("grouped"))


@reg("stress_level", f"WITH {_R} SELECT client_process, count(*) AS calls, round(avg(duration_ms), 3) AS mean, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99, max(duration_ms) AS top, count(*) FILTER (WHERE status <> 'ok') AS failures FROM r GROUP BY client_process")
def stress_level(t: Tables) -> DataFrame:
    r = records(t)
    counted = r.groupBy("client_process").agg(F.count("*").alias("calls"), F.round(F.avg("duration_ms"), 3).alias("mean"), F.max("duration_ms").alias("top"), F.count_if(F.col("status") != "ok").alias("failures"))
    ranks = rank_percentiles(r, ["client_process"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return counted.alias("c").join(ranks.alias("r"), F.col("c.client_process").eqNullSafe(F.col("r.client_process")), "left").select("c.client_process", "calls", "mean", "p50", "p95", "p99", "top", "failures")


@reg("sidecar_metrics", f"WITH {_R}, d AS (SELECT CAST(floor(timestamp_unix_ms / 86400000) AS BIGINT) AS day, tool, count(*) AS calls, CAST(sum(response_bytes) AS BIGINT) AS bytes FROM r GROUP BY ALL) SELECT day, tool, CAST(sum(calls) OVER w AS BIGINT) AS calls, CAST(sum(bytes) OVER w AS BIGINT) AS bytes FROM d WINDOW w AS (PARTITION BY tool ORDER BY day)")
def sidecar_metrics(t: Tables) -> DataFrame:
    """Running counters by day."""
    d = records(t).groupBy(F.floor(F.col("timestamp_unix_ms") / 86_400_000).cast("long").alias("day"), "tool").agg(F.count("*").alias("calls"), F.sum("response_bytes").alias("bytes"))
    w = Window.partitionBy("tool").orderBy("day")
    return d.select("day", "tool", F.sum("calls").over(w).alias("calls"), F.sum("bytes").over(w).alias("bytes"))


reg.text(
    "exp_path_kind",
    "SELECT kind, CASE WHEN lower(extension) IN ('py', 'pyi', 'rs', 'go', 'js', 'java', 'c', 'sh') THEN 'code' WHEN lower(extension) = 'sql' THEN 'sql' WHEN lower(extension) IN ('json', 'jsonl', 'csv') THEN 'structured' ELSE 'text' END AS path_kind, count(DISTINCT id) AS n FROM {files} GROUP BY 1, 2",
)
reg.text("deletion_pass", "SELECT DISTINCT s.file_id FROM {search_docs} s WHERE NOT EXISTS (SELECT 1 FROM {files} f WHERE f.id = s.file_id AND NOT f.deleted)")
reg.text("memory_refresh_retire", "SELECT d.source, count(*) AS notes FROM {documents} d WHERE d.kind = 'agent_memory' AND NOT EXISTS (SELECT 1 FROM {roots} r WHERE r.path = concat('/ws/', d.source)) GROUP BY d.source")
reg.text("led_next_directory", "SELECT root_id, min(relative_path) AS next FROM {files} WHERE NOT content_indexed AND NOT deleted GROUP BY root_id")
reg.text("cat_project_upsert", "SELECT coalesce(r.path, d.path) AS path, r.id, d.n FROM {roots} r FULL JOIN (SELECT concat('/ws/', source) AS path, count(*) AS n FROM {documents} GROUP BY 1) d ON r.path = d.path")


@reg("value_to_json")
def value_to_json(t: Tables) -> DataFrame:
    """Rows as JSON: non-finite numbers become null, decimals and dates text, lists and structs themselves."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)).alias(c)
    return t.lineitem.select(F.to_json(F.struct("l_orderkey", "l_linenumber", finite("l_quantity"), finite("l_extendedprice"), "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate"))).alias("row"))


QUERIES, SQL = reg.queries, reg.sql
