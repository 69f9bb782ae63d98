"""Boosts, copies, diversity, budgets and diagnoses over ranked hits; commits, notifications and publication of the catalog."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ranking as K
from ..operators import retrieval as R
from ..operators.joins import longest_prefix_owner
from ..session import work_folder, written
from ..sources.files import bounded_sql, scan
from .more_retrieval_queries import _NOTES, _notes
from .registry import Registry, Tables
from .retrieval_queries import _ANCHORS, _BOOSTED, _DOCS, _TERMS, _fused_sql, _lane, _lane_sql, asked, lanes, stored_docs
from .scalar_queries import _NORM, MEMORY_LAYER
from .telemetry_queries import _R, records

reg = Registry()

#: The time that ages are counted to, in seconds (2026-06-01).
NOW = 1_780_272_000
_OWNER = "(SELECT r.path FROM roots r WHERE {0} = r.path OR starts_with({0}, r.path || '/') ORDER BY length(r.path) DESC LIMIT 1)"
_STEM = r"regexp_replace(regexp_extract(d.path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_ENTRY = r"\A---\r?\nname: ([^\r\n]*)"
_ABOUT = r"\A---\r?\n(?:name: [^\n]*\n)?description: ([^\r\n]*)"
_STEPS = "CASE layer " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.LAYERS.items()) + " END"
_HAS = "(strlen({0}) >= 4 AND contains(' ' || q || ' ', ' ' || {0} || ' '))"


@reg(
    "memory_boosts",
    rf"""WITH {_NOTES.format("kind = 'agent_memory'")}, {_lane('content', 'content')},
h AS (SELECT l.query_id, l.file_id, qu.query, {_NORM.format('qu.query')} AS q, {_NORM.format(_STEM)} AS file, {_NORM.format(f"regexp_extract(d.text, '{_ENTRY}', 1)")} AS entry,
  {_NORM.format(f"regexp_extract(d.text, '{_ABOUT}', 1)")} AS about, {MEMORY_LAYER[1]} AS layer, {_OWNER.format('d.path')} IS NOT NULL AS owned, greatest({NOW} - epoch(d.ingested_at), 0) / 86400.0 AS age
  FROM content_lane l JOIN queries qu USING (query_id) JOIN (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM documents) d ON d.doc_id = l.file_id WHERE l.rank <= 20 AND d.path IS NOT NULL AND d.ingested_at IS NOT NULL),
w AS (SELECT *, list_distinct(list_filter(string_split(q, ' '), lambda x: x <> '')) AS words FROM h),
s AS (SELECT *, len(list_intersect(words, list_distinct(list_filter(string_split(about, ' '), lambda x: x <> '')))) AS shared, coalesce({_HAS.format('file')}, false) AS by_file, coalesce({_HAS.format('entry')}, false) AS by_entry FROM w)
SELECT query_id, file_id, layer, owned, round(CASE WHEN owned THEN {K.PROJECT_NOTE} ELSE {K.GLOBAL_NOTE} END + {_STEPS} * {K.LAYER_STEP} + {K.RECENT} / (1 + age / 30) + CASE WHEN by_file THEN {K.FILE_NAMED} ELSE 0 END + CASE WHEN by_entry THEN {K.ENTRY_NAMED} ELSE 0 END
 + CASE WHEN shared >= 2 OR shared = 1 AND len(words) = 1 THEN {K.DESCRIBED} * shared / len(words) ELSE 0 END
 - CASE WHEN layer = 'project_summary' AND NOT by_file AND NOT by_entry AND (len(list_filter(string_split(q, ' '), lambda x: strlen(x) >= 16 OR regexp_matches(x, '\p{{N}}'))) > 0 OR regexp_matches(query, '[\p{{L}}\p{{N}}][-_/.][\p{{L}}\p{{N}}]')) THEN {K.SUMMARY_PENALTY} ELSE 0 END, 9) AS boost FROM s""",
)
def memory_boosts(t: Tables) -> DataFrame:
    docs, queries = _notes(t, "kind = 'agent_memory'")
    hits = R.bm25_lane(docs, queries, F.col("content"), 20).select("query_id", "file_id")
    owned = longest_prefix_owner(t.documents.where("path IS NOT NULL").select("path").distinct(), t.roots.select(F.col("path").alias("root")))
    age = F.greatest(F.lit(NOW) - F.unix_micros(F.col("ingested_at").cast("timestamp")) / 1e6, F.lit(0.0)) / 86400.0
    notes = t.documents.where("kind = 'agent_memory' AND path IS NOT NULL AND ingested_at IS NOT NULL").select(
        F.col("doc_id").alias("file_id"), "path", X.memory_layer(F.col("path")).alias("layer"), F.regexp_extract("text", _ENTRY, 1).alias("entry"), F.regexp_extract("text", _ABOUT, 1).alias("about"), age.alias("age")
    )
    rows = hits.join(queries, "query_id").join(notes, "file_id").join(owned, "path", "left")
    boost = K.memory_boost(F.col("query"), X.base_name(F.col("path")), F.col("entry"), F.col("about"), F.col("layer"), F.col("root").isNotNull(), F.col("age"))
    return rows.select("query_id", "file_id", "layer", F.col("root").isNotNull().alias("owned"), F.round(boost, 9).alias("boost"))


_NAMED_HITS = f"{_DOCS}, {_lane_sql('path')}, {_fused_sql(('path',))}, {_TERMS}, {_ANCHORS}, {_BOOSTED}"


def _named_hits(t: Tables, docs: DataFrame) -> DataFrame:
    """Hits of the path lane with what a query names exactly; the kind of each file."""
    queries = asked(docs)
    hits = R.boosted(R.fuse(lanes(("path",), docs)), queries, docs, t.symbols, R.exact_path_lane(docs, queries))
    return hits.join(docs.select("file_id", "kind"), "file_id")


@reg(
    "source_scope_boost",
    f"""WITH {_NAMED_HITS}, s AS (SELECT b.query_id, b.file_id, d.kind, b.lanes, b.score, b.path = c.scope OR starts_with(b.path, c.scope || '/') AS inside FROM boosted b JOIN docs d USING (file_id)
 LEFT JOIN (SELECT file_id AS query_id, {_OWNER.format('docs.path')} AS scope FROM docs WHERE file_id % 50 = 0) c ON c.query_id = b.query_id)
SELECT query_id, file_id, coalesce(inside, false) AS in_scope, round(score + CASE WHEN inside AND kind = 'source' AND (contains(lanes, 'exact_symbol') OR contains(lanes, 'exact_path')) THEN {K.OWN_CHECKOUT} ELSE 0 END, 6) AS score FROM s""",
)
def source_scope_boost(t: Tables) -> DataFrame:
    """The asker of a query is its own file; registered roots stand for checkouts."""
    docs = stored_docs(t)
    contexts = docs.where("file_id % 50 = 0").select(F.col("file_id").alias("query_id"), F.col("path").alias("context"))
    return K.own_checkout_boost(_named_hits(t, docs), contexts, t.roots.select(F.col("path").alias("root"))).select("query_id", "file_id", "in_scope", "score")


@reg(
    "collapse_alternatives",
    f"""WITH {_NAMED_HITS}, i AS (SELECT query_id, file_id, path, content_hash, score, regexp_extract(path, '[^/]*$') AS n FROM boosted WHERE contains(lanes, 'exact_symbol') OR contains(lanes, 'exact_path')),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY score DESC, path) AS spot FROM i),
k AS (SELECT *, content_hash IS NULL OR row_number() OVER (PARTITION BY query_id, n, content_hash ORDER BY spot) = 1 AS kept FROM o),
m AS (SELECT *, sum(kept::INT) OVER (PARTITION BY query_id, n ORDER BY spot) - 1 AS nth FROM k),
p AS (SELECT a.query_id, a.file_id, b.path || ' ' || CASE WHEN a.content_hash = b.content_hash THEN 'identical_content' WHEN a.content_hash IS NOT NULL AND b.content_hash IS NOT NULL THEN 'different_content' ELSE 'content_unverified' END AS link,
  row_number() OVER (PARTITION BY a.query_id, a.file_id ORDER BY b.spot) AS k FROM m a JOIN m b ON a.query_id = b.query_id AND a.n = b.n AND a.kept
  AND (b.spot < a.spot AND b.kept AND b.nth < least(3, a.nth) OR b.spot > a.spot AND (coalesce(a.content_hash = b.content_hash, false) OR b.kept AND a.nth < 3)))
SELECT m.query_id, m.file_id, coalesce(string_agg(p.link, '|' ORDER BY p.k), '') AS alternatives FROM m LEFT JOIN p ON p.query_id = m.query_id AND p.file_id = m.file_id AND p.k <= {K.COPIES} WHERE m.kept GROUP BY ALL""",
)
def collapse_alternatives(t: Tables) -> DataFrame:
    hits = _named_hits(t, stored_docs(t)).withColumn("identified", F.col("lanes").contains("exact_symbol") | F.col("lanes").contains("exact_path")).where("identified")
    said = F.array_join(F.transform("alternatives", lambda x: F.concat_ws(" ", x["path"], x["relationship"])), "|")
    return K.collapse_identified(hits).select("query_id", "file_id", said.alias("alternatives"))


@reg(
    "mmr_progressive",
    f"""WITH {_DOCS}, {_lane_sql('path')}, {_fused_sql(('path',))}, h AS (SELECT query_id, file_id, score, path, row_number() OVER (PARTITION BY query_id, regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) - 1 AS k,
 greatest(0.1 * max(score) FILTER (WHERE score < {K.BOOSTED_FROM}) OVER (PARTITION BY query_id), {K.DIRECTORY}) AS step FROM fused JOIN docs USING (file_id) WHERE kind IN ('tabular', 'semi_structured'))
SELECT query_id, file_id, round(score - step * k, 9) AS score FROM h""",
)
def mmr_progressive(t: Tables) -> DataFrame:
    """Data files only here, where the greedy choice is a formula; the operator takes mixed directories too."""
    docs = stored_docs(t)
    kept = docs.where(F.col("kind").isin("tabular", "semi_structured")).select("file_id", "path", "kind")
    return K.diversify_progressively(R.fuse(lanes(("path",), docs)).join(kept, "file_id"), 1 << 20).select("query_id", "file_id", "score")


_BUDGET = 4_000


@reg(
    "preview_budget",
    rf"""WITH RECURSIVE {_DOCS}, {_lane_sql('content')},
h AS (SELECT l.query_id, l.rank, l.file_id, left(d.content, 1600) AS preview, coalesce(list_min(list_filter(list_transform(list_filter(string_split_regex(q.query, '[^\p{{L}}\p{{N}}_]+'), lambda w: strlen(w) > 2), lambda w: instr(left(d.content, 1600), w)), lambda p: p > 0)) - 1, 0) AS match,
  count(*) OVER (PARTITION BY l.query_id) AS n FROM content_lane l JOIN docs d USING (file_id) JOIN queries q USING (query_id) WHERE l.rank <= 20),
r AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS file_id, {_BUDGET}::BIGINT AS rest, 0::BIGINT AS start, 0::BIGINT AS chars FROM (SELECT DISTINCT query_id FROM h)
 UNION ALL SELECT query_id, rank, file_id, rest - chars, start, chars FROM (SELECT *, least(allowed, length(preview) - start) AS chars FROM (
  SELECT *, CASE WHEN length(preview) > allowed THEN greatest(match - allowed // 3, 0) ELSE 0 END AS start FROM (
   SELECT h.query_id, h.rank, h.file_id, h.preview, h.match, r.rest, least(greatest(r.rest - (h.n - h.rank) * least({K.PREVIEW_FLOOR}, {_BUDGET} // h.n), 0), {K.PREVIEW_MOST}) AS allowed FROM r JOIN h ON h.query_id = r.query_id AND h.rank = r.rank + 1))))
SELECT r.query_id, r.rank, r.file_id, substring(h.preview, r.start + 1, r.chars) AS preview, r.chars < length(h.preview) AS cut FROM r JOIN h ON h.query_id = r.query_id AND h.rank = r.rank""",
)
def preview_budget(t: Tables) -> DataFrame:
    docs = stored_docs(t)
    hits = lanes(("content",), docs).where("rank <= 20").select("query_id", F.col("rank").cast("long").alias("rank"), "file_id")
    rows = hits.join(asked(docs), "query_id").join(docs.select("file_id", F.substring("content", 1, 1600).alias("preview")), "file_id")
    return K.budgeted_previews(rows, _BUDGET)


_IGNORED = "(?:^|/)vendor/"
_ASKED_FOR = """a AS (SELECT DISTINCT 'anchor' AS what, json_extract_string(arguments, '$.path') AS path FROM audit_records WHERE json_extract_string(arguments, '$.path') IS NOT NULL
 UNION SELECT 'anchor', absolute_path FROM files UNION SELECT 'context', path FROM documents WHERE path IS NOT NULL UNION SELECT 'root', '/ws/' || source FROM documents WHERE source IS NOT NULL UNION SELECT 'root', '/ws')"""


@reg(
    "miss_diagnostics",
    rf"""WITH {_ASKED_FOR}, present AS (SELECT DISTINCT path FROM search_docs UNION SELECT absolute_path FROM files WHERE NOT deleted), live AS (SELECT DISTINCT absolute_path AS path FROM files WHERE NOT deleted AND content_indexed),
o AS (SELECT what, path, {_OWNER.format('a.path')} AS root FROM a),
parts AS (SELECT path, unnest(list_transform(range(2, len(string_split(path, '/')) + 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS part FROM present),
above AS (SELECT DISTINCT unnest(list_transform(range(2, len(string_split(path, '/')) + 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS part FROM roots),
m AS (SELECT o.*, path IN (SELECT part FROM parts) AS there, path IN (SELECT part FROM above) AS above, path IN (SELECT path FROM live) AS indexed, path IN (SELECT path FROM present) AS file, substring(path, length(root) + 2) AS rest FROM o),
r AS (SELECT what, path, CASE WHEN what = 'context' AND NOT there THEN 'context_unavailable' WHEN what = 'root' AND NOT there AND NOT above THEN 'root_unavailable' WHEN what = 'root' AND root IS NULL AND NOT above THEN 'root_outside_indexed_roots'
 WHEN what <> 'anchor' THEN NULL WHEN list_contains(string_split(path, '/'), '..') THEN 'unresolved_path' WHEN root IS NULL THEN CASE WHEN starts_with(path, '/') THEN 'outside_indexed_roots' ELSE 'not_returned' END
 WHEN lower(regexp_extract(path, '[^/]*$')) = '.env' OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\.(pem|key)$') OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'credential|access_token|secret_key')
  OR list_has_any(string_split(rest, '/'), [{", ".join(f"'{c}'" for c in X.EXCLUDED_COMPONENTS)}]) THEN 'excluded_by_policy'
 WHEN indexed THEN 'indexed_not_returned' WHEN regexp_matches(rest, '{_IGNORED}') THEN 'ignored' WHEN file THEN 'present_not_indexed' ELSE 'not_returned' END AS reason FROM m)
SELECT what, path, reason FROM r WHERE reason IS NOT NULL""",
)
def miss_diagnostics(t: Tables) -> DataFrame:
    """Everything asked for by path, told apart by what the catalog knows of it."""
    named = t.audit_records.select(F.get_json_object("arguments", "$.path").alias("path")).where("path IS NOT NULL").union(t.files.select("absolute_path"))
    asked_for = named.select(F.lit("anchor").alias("what"), "path")
    asked_for = asked_for.unionByName(t.documents.where("path IS NOT NULL").select(F.lit("context").alias("what"), "path"))
    sources = t.documents.where("source IS NOT NULL").select(F.lit("root").alias("what"), F.concat(F.lit("/ws/"), "source").alias("path"))
    asked_for = asked_for.unionByName(sources).unionByName(sources.select("what", F.lit("/ws").alias("path"))).distinct().withColumn("request_id", F.col("path"))
    live = t.files.where("NOT deleted")
    present = t.search_docs.select("path").union(live.select("absolute_path")).distinct()
    found = K.diagnose(asked_for, t.roots.select("path"), live.where("content_indexed").select(F.col("absolute_path").alias("path")), present, ignored=_IGNORED)
    return found.select("what", "path", "reason")


@reg("dedup_agent", "SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY kind, sha256(text) ORDER BY doc_id) AS k FROM documents WHERE kind IN ('agent_skill', 'agent_memory')) WHERE k = 1 OR text IS NULL")
def dedup_agent(t: Tables) -> DataFrame:
    """The first of each role and content; a null content is never a copy."""
    d = t.documents.where(F.col("kind").isin("agent_skill", "agent_memory")).select("doc_id", "kind", F.sha2("text", 256).alias("h"))
    return d.where("h IS NOT NULL").groupBy("kind", "h").agg(F.min("doc_id").alias("doc_id")).select("doc_id").union(d.where("h IS NULL").select("doc_id"))


@reg(
    "adoption_funnel",
    f"""WITH {_R}, s AS (SELECT session_id, bool_or(tool = 'workspace_search') AS searched, CASE WHEN bool_or(tool = 'workspace_search') THEN bool_or(result_count > 0) FILTER (WHERE tool = 'workspace_search') END AS found, bool_or(tool = 'workspace_inspect') AS inspected,
 CASE WHEN bool_or(tool <> 'workspace_search') THEN bool_or(parent_search_id IS NOT NULL) END AS adopted FROM r WHERE session_id IS NOT NULL GROUP BY session_id),
u AS (SELECT 'search' AS stage, searched AS v FROM s UNION ALL SELECT 'found', found FROM s WHERE searched UNION ALL SELECT 'inspect', inspected FROM s WHERE searched AND found UNION ALL SELECT 'adopted', adopted FROM s WHERE searched AND found)
SELECT stage, count(*) AS denominator, count(*) FILTER (WHERE v) AS reached, count(*) FILTER (WHERE NOT v) AS not_reached, count(*) FILTER (WHERE v IS NULL) AS unknown, round(count(*) FILTER (WHERE v) * 1.0 / nullif(count(*), 0), 6) AS rate FROM u GROUP BY stage""",
)
def adoption_funnel(t: Tables) -> DataFrame:
    """How many sessions reach each stage among those that reached the one before; inspecting does not gate what follows."""
    search = F.col("tool") == "workspace_search"
    s = records(t).where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.bool_or(search).alias("searched"),
        F.bool_or(F.when(search, F.col("result_count") > 0)).alias("found"),
        F.bool_or(F.col("tool") == "workspace_inspect").alias("inspected"),
        F.bool_or(F.when(~search, F.lit(True))).alias("other"),
        F.bool_or(F.col("parent_search_id").isNotNull()).alias("linked"),
    )
    gate = F.coalesce(F.col("searched") & F.col("found"), F.lit(False))
    stages = [("search", F.lit(True), F.col("searched")), ("found", F.col("searched"), F.col("found")), ("inspect", gate, F.col("inspected")), ("adopted", gate, F.when(F.col("other"), F.col("linked")))]
    rows = s.select(F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), ok.alias("ok"), v.alias("v")) for n, ok, v in stages))).alias("x")).where("x.ok").select("x.stage", "x.v")
    return rows.groupBy("stage").agg(
        F.count("*").alias("denominator"), F.count_if("v").alias("reached"), F.count_if(~F.col("v")).alias("not_reached"), F.count_if(F.col("v").isNull()).alias("unknown"), F.round(F.count_if("v") / F.count("*"), 6).alias("rate")
    )


@reg(
    "notify_apply",
    rf"""WITH n AS (SELECT json_extract_string(arguments, '$.path') AS path, min(timestamp_unix_ms) AS first_ms FROM audit_records WHERE json_extract_string(arguments, '$.path') IS NOT NULL GROUP BY 1), o AS (SELECT *, {_OWNER.format('n.path')} AS root FROM n)
SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY first_ms, path) AS place, CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\.(pem|key)$|credential|access_token|secret_key|^\.env$') THEN 'failed'
 WHEN path IN (SELECT absolute_path FROM files WHERE NOT deleted) THEN 'read' ELSE 'delete' END AS action FROM o WHERE root IS NOT NULL""",
)
def notify_apply(t: Tables) -> DataFrame:
    """Explicit paths by the longest root that owns them, each once in the order first given: read, delete or refuse."""
    from pyspark.sql import Window

    given = t.audit_records.select(F.get_json_object("arguments", "$.path").alias("path"), "timestamp_unix_ms").where("path IS NOT NULL").groupBy("path").agg(F.min("timestamp_unix_ms").alias("at"))
    owned = longest_prefix_owner(given, t.roots.select(F.col("path").alias("root"))).where("root IS NOT NULL")
    live = t.files.where("NOT deleted").select(F.col("absolute_path").alias("path")).distinct().withColumn("live", F.lit(True))
    action = F.when(X.is_sensitive_name(F.col("path")), "failed").when(F.col("live"), "read").otherwise("delete")
    place = F.row_number().over(Window.partitionBy("root").orderBy("at", "path")).cast("long")
    return owned.join(live, "path", "left").select("root", "path", place.alias("place"), action.alias("action"))


@reg(
    "generation_commit",
    "SELECT r.id, coalesce(g.last, r.last_completed_generation) AS last_completed_generation, coalesce(g.n, 0) AS completed, CASE WHEN r.last_completed_generation IS NULL THEN 'interrupted' ELSE 'completed' END AS before FROM roots r LEFT JOIN (SELECT root_id, max(generation) AS last, count(DISTINCT id) AS n FROM files WHERE NOT deleted GROUP BY root_id) g ON g.root_id = r.id",
)
def generation_commit(t: Tables) -> DataFrame:
    """The roots after the commit of the newest generation of each; a generation still open before counts as interrupted."""
    newest = t.files.where("NOT deleted").groupBy(F.col("root_id").alias("id")).agg(F.max("generation").alias("last"), F.countDistinct("id").alias("n"))
    before = F.when(F.col("last_completed_generation").isNull(), "interrupted").otherwise("completed")
    return t.roots.join(newest, "id", "left").select("id", F.coalesce("last", "last_completed_generation").alias("last_completed_generation"), F.coalesce("n", F.lit(0)).alias("completed"), before.alias("before"))


#: Documents and bytes of a batch at most, bytes of a document that count at most, and those that any document has.
BATCH_DOCUMENTS, BATCH_BYTES, DOCUMENT_BYTES, DOCUMENT_ROOM = 32, 8 << 20, 65_536, 256


def packed_batches(docs: DataFrame) -> DataFrame:
    """(file_id, batch): documents in order of id packed into batches of bounded count and bytes.

    ``docs`` has (file_id, bytes). A batch begins when the next document would not fit; sorted
    ranges of documents are packed independently, so only the last batch of a range may be short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = 0, 0, None
        for rows in batches:
            names = []
            for file_id, more in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                if first is None or held >= BATCH_DOCUMENTS or size + more > BATCH_BYTES:
                    held, size, first = 0, 0, file_id
                held, size = held + 1, size + more
                names.append(first)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.int64())], names=["file_id", "batch"])

    return docs.select(F.col("file_id").cast("long").alias("file_id"), F.col("bytes").cast("long").alias("bytes")).repartitionByRange("file_id").sortWithinPartitions("file_id").mapInArrow(run, "file_id long, batch long")


@reg("batch_pack")
def batch_pack(t: Tables) -> DataFrame:
    size = F.least(F.octet_length("content") + F.coalesce(F.octet_length("symbols"), F.lit(0)) + F.coalesce(F.octet_length("schema_text"), F.lit(0)), F.lit(DOCUMENT_BYTES)) + F.octet_length("path") + DOCUMENT_ROOM
    return packed_batches(stored_docs(t).where("content IS NOT NULL").select("file_id", size.alias("bytes")))


@reg("snapshot_publish", "SELECT count(*) AS n, count(DISTINCT generation) AS generations, 0::BIGINT AS missing, 0::BIGINT AS changed FROM search_docs")
def snapshot_publish(t: Tables) -> DataFrame:
    """Publish the texts as a snapshot (data, then a manifest of sizes and digests, then the pointer) and verify it as a reader does."""
    base = f"{work_folder(t.spark)}/published-{uuid.uuid4().hex}"
    listed = lambda: t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{base}/data").select("path", "length", F.sha2("content", 256).alias("digest"))
    t.search_docs.select("file_id", "path", "generation").write.option("maxRecordsPerFile", 200_000).parquet(f"{base}/data")
    listed().write.parquet(f"{base}/manifest")
    t.spark.createDataFrame([(f"{base}/manifest",)], "current string").write.json(f"{base}/pointer")
    known = t.spark.read.parquet(t.spark.read.schema("current string").json(f"{base}/pointer").first()["current"])
    both = known.alias("k").join(listed().alias("l"), F.col("k.path") == F.col("l.path"), "left")
    wrong = both.agg(F.count_if(F.col("l.path").isNull()).alias("missing"), F.count_if((F.col("k.digest") != F.col("l.digest")) | (F.col("k.length") != F.col("l.length"))).alias("changed"))
    return t.spark.read.parquet(f"{base}/data").agg(F.count("*").alias("n"), F.countDistinct("generation").alias("generations")).join(wrong)


@reg("sql_row_cap", "SELECT o_orderkey, o_totalprice, true AS truncated FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sql_row_cap(t: Tables) -> DataFrame:
    """The bounded lane itself: the limit is the feature."""
    got = bounded_sql(t.spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey", {"orders": f"{t.sf_dir}/orders.parquet"}, [t.sf_dir], max_rows=100)
    return t.spark.createDataFrame([(*row, got.truncated) for row in got.rows], "o_orderkey long, o_totalprice double, truncated boolean")


@reg(
    "sql_byte_cap",
    "SELECT o_orderkey, o_orderstatus FROM (SELECT *, sum(length('[' || o_orderkey || ', \"' || o_orderstatus || '\"]')) OVER (ORDER BY o_orderkey) AS used FROM orders) WHERE used <= 2000",
)
def sql_byte_cap(t: Tables) -> DataFrame:
    got = bounded_sql(t.spark, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey", {"orders": f"{t.sf_dir}/orders.parquet"}, [t.sf_dir], max_rows=10_000, max_bytes=2_000)
    return t.spark.createDataFrame(got.rows, "o_orderkey long, o_orderstatus string")


@reg("register_view", "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def register_view(t: Tables) -> DataFrame:
    """Inputs as views of a session of their own; one without a name is called by its place."""
    own = t.spark.newSession()
    for i, (name, alias) in enumerate((("supplier", "s_in"), ("nation", None))):
        scan(own, f"{t.sf_dir}/{name}.parquet").createOrReplaceTempView(alias or f"data_{i}")
    return own.sql("SELECT s.s_suppkey, n.n_name FROM s_in s JOIN data_1 n ON s.s_nationkey = n.n_nationkey")


#: Ignore rules of the walk, as patterns of relative paths.
_WALK_IGNORES = [r"(?:^|/)vendor/", r"\.lock$", r"(?:^|/)build/"]


@reg(
    "scan_files_walk",
    "SELECT DISTINCT absolute_path AS path, size_bytes AS size FROM files WHERE NOT list_has_any(string_split(relative_path, '/'), [{}]) AND NOT regexp_matches(relative_path, '{}')".format(", ".join(f"'{c}'" for c in X.EXCLUDED_COMPONENTS), "|".join(_WALK_IGNORES)),
)
def scan_files_walk(t: Tables) -> DataFrame:
    """What a walk over the listed files keeps: no excluded component anywhere in a path, no ignored one."""
    kept = t.files.where(~X.is_excluded(F.col("relative_path")) & ~F.col("relative_path").rlike("|".join(_WALK_IGNORES)))
    return kept.select(F.col("absolute_path").alias("path"), F.col("size_bytes").alias("size")).distinct()


@reg("vector_index", "SELECT kind, count(DISTINCT chunk_id) AS n, CASE WHEN count(DISTINCT chunk_id) < 256 THEN 'flat' ELSE 'partitioned' END AS layout, CASE WHEN count(DISTINCT chunk_id) < 256 THEN 1 ELSE least(greatest(CAST(floor(sqrt(count(DISTINCT chunk_id))) AS BIGINT), 16), 256) END AS parts FROM chunks WHERE len(vector) = 96 GROUP BY kind")
def vector_index(t: Tables) -> DataFrame:
    """How the vectors of a kind are laid out: flat if few, else in partitions, all of which a search reads."""
    n = F.countDistinct("chunk_id")
    counted = t.chunks.where(F.size("vector") == 96).groupBy("kind").agg(n.alias("n"))
    few = F.col("n") < 256
    parts = F.when(few, 1).otherwise(F.least(F.greatest(F.floor(F.sqrt("n")), F.lit(16)), F.lit(256))).cast("long")
    return counted.select("kind", "n", F.when(few, "flat").otherwise("partitioned").alias("layout"), parts.alias("parts"))


reg.text("cat_mark_path_deleted", "SELECT s.file_id, count(*) AS marked FROM {search_docs} s WHERE EXISTS (SELECT 1 FROM {files} f WHERE f.id = s.file_id AND f.deleted) GROUP BY s.file_id")
reg.text("cat_project_deactivate", "SELECT r.id, r.path FROM {roots} r WHERE NOT EXISTS (SELECT 1 FROM {files} f WHERE f.root_id = r.id AND NOT f.deleted)")
reg.text("memory_max_generation", "SELECT source, count(*) AS notes, max(generation) AS last FROM {documents} WHERE kind = 'agent_memory' GROUP BY source")
reg.text("led_ready_count", "SELECT root_id, count(*) AS ready, min(mtime_ns) AS oldest FROM {files} WHERE NOT content_indexed AND NOT deleted GROUP BY root_id")

QUERIES, SQL = reg.queries, reg.sql
