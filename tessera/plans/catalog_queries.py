"""Catalog operators: change classes between listings, upserts, deletions, status, keyset pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.catalog import classify_changes, latest, upsert
from .registry import Registry, Tables

reg = Registry()

# two listings of each publish_dir: its last published generation and the one before
_LISTINGS = """g AS (SELECT publish_dir, generation, row_number() OVER (PARTITION BY publish_dir ORDER BY generation DESC) AS k FROM (SELECT DISTINCT publish_dir, generation FROM snapshot_manifests WHERE files IS NOT NULL)),
e AS (SELECT m.publish_dir, g.k, f.path AS path, max(f.size_bytes) AS size, min(lower(f.blake3)) AS hash FROM (SELECT publish_dir, generation, unnest(files) AS f FROM snapshot_manifests) m JOIN g USING (publish_dir, generation) WHERE k <= 2 GROUP BY ALL),
old AS (SELECT publish_dir, path, size, hash FROM e WHERE k = 2), new AS (SELECT publish_dir, path, size, hash FROM e WHERE k = 1),
c AS (SELECT publish_dir, path, CASE WHEN old.publish_dir IS NULL THEN 'added' WHEN new.publish_dir IS NULL THEN 'deleted' WHEN old.hash IS NOT DISTINCT FROM new.hash AND old.size IS NOT DISTINCT FROM new.size THEN 'unchanged_meta'
 WHEN old.hash IS NOT DISTINCT FROM new.hash THEN 'unchanged_hash' ELSE 'modified' END AS state, old.size AS old_size, new.size AS new_size FROM old FULL JOIN new USING (publish_dir, path))"""


def listings(t: Tables) -> tuple[DataFrame, DataFrame]:
    m = t.snapshot_manifests.where("files IS NOT NULL")
    w = Window.partitionBy("publish_dir").orderBy(F.col("generation").desc())
    numbered = m.select("publish_dir", "generation").distinct().withColumn("k", F.row_number().over(w)).where("k <= 2")
    entries = m.select("publish_dir", "generation", F.explode("files").alias("f")).join(numbered, ["publish_dir", "generation"])
    once = entries.groupBy("publish_dir", "k", F.col("f.path").alias("path")).agg(F.max("f.size_bytes").alias("size"), F.min(F.lower("f.blake3")).alias("hash"))
    return once.where("k = 2").drop("k"), once.where("k = 1").drop("k")


def changes(t: Tables) -> DataFrame:
    old, new = listings(t)
    return classify_changes(old, new, ["publish_dir", "path"])


@reg("change_classes", f"WITH {_LISTINGS} SELECT publish_dir, path, state FROM c")
def change_classes(t: Tables) -> DataFrame:
    return changes(t).select("publish_dir", "path", "state")


for _id, _state in (("change_unchanged_meta", "unchanged_meta"), ("change_unchanged_hash", "unchanged_hash"), ("change_deleted", "deleted")):

    def _one(id_: str, state: str) -> None:
        @reg(id_, f"WITH {_LISTINGS} SELECT publish_dir, path, old_size, new_size FROM c WHERE state = '{state}'")
        def run(t: Tables) -> DataFrame:
            return changes(t).where(F.col("state") == state).select("publish_dir", "path", "old_size", "new_size")

    _one(_id, _state)


@reg("index_report", f"WITH {_LISTINGS} SELECT publish_dir, count(*) AS discovered, count(*) FILTER (WHERE state IN ('added', 'modified')) AS indexed, count(*) FILTER (WHERE starts_with(state, 'unchanged')) AS unchanged, count(*) FILTER (WHERE state = 'deleted') AS deleted FROM c GROUP BY publish_dir")
def index_report(t: Tables) -> DataFrame:
    return changes(t).groupBy("publish_dir").agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("state").isin("added", "modified")).alias("indexed"),
        F.count_if(F.col("state").startswith("unchanged")).alias("unchanged"),
        F.count_if(F.col("state") == "deleted").alias("deleted"),
    )


@reg("change_replay_incomplete", "SELECT DISTINCT f.id FROM files f JOIN roots r ON r.id = f.root_id WHERE NOT f.deleted AND (r.last_completed_generation IS NULL OR f.generation > r.last_completed_generation)")
def change_replay_incomplete(t: Tables) -> DataFrame:
    """Files of a generation that was never completed: they are never taken as unchanged."""
    roots = t.roots.select(F.col("id").alias("root_id"), "last_completed_generation")
    done = F.coalesce(F.col("generation") <= F.col("last_completed_generation"), F.lit(False))
    return t.files.where("NOT deleted").join(roots, "root_id").where(~done).select("id").distinct()


@reg("change_failed_retained", "SELECT DISTINCT id FROM files WHERE NOT deleted AND contains(extraction_status, 'failed')")
def change_failed_retained(t: Tables) -> DataFrame:
    return t.files.where(~F.col("deleted") & F.col("extraction_status").contains("failed")).select("id").distinct()


@reg("upsert_file", f"WITH {_LISTINGS} SELECT publish_dir, path, size, hash FROM new UNION ALL SELECT publish_dir, path, size, hash FROM old ANTI JOIN new USING (publish_dir, path)")
def upsert_file(t: Tables) -> DataFrame:
    old, new = listings(t)
    return upsert(old, new, ["publish_dir", "path"]).select("publish_dir", "path", "size", "hash")


@reg("replace_children", "SELECT DISTINCT s.file_id, s.name, s.kind, s.line_start FROM symbols s JOIN (SELECT DISTINCT id FROM files WHERE NOT deleted) f ON f.id = s.file_id")
def replace_children(t: Tables) -> DataFrame:
    live = t.files.where("NOT deleted").select(F.col("id").alias("file_id"))
    return t.symbols.join(live, "file_id", "left_semi").select("file_id", "name", "kind", "line_start").distinct()


@reg("sink_upsert_doc", "SELECT file_id, max(generation) AS generation, count(DISTINCT generation) AS versions FROM search_docs GROUP BY file_id")
def sink_upsert_doc(t: Tables) -> DataFrame:
    """Delete by id and append: what is left of all versions is the last."""
    versions = t.search_docs.groupBy("file_id").agg(F.countDistinct("generation").alias("versions"))
    return latest(t.search_docs.select("file_id", "generation", "indexed_at"), ["file_id"], ["generation", "indexed_at"]).select("file_id", "generation").join(versions, "file_id")


@reg("sink_upsert_vectors", "SELECT DISTINCT c.chunk_id, c.file_id, c.generation FROM chunks c JOIN (SELECT file_id, max(generation) AS generation FROM chunks GROUP BY file_id) m USING (file_id, generation)")
def sink_upsert_vectors(t: Tables) -> DataFrame:
    last = t.chunks.groupBy("file_id").agg(F.max("generation").alias("generation"))
    return t.chunks.join(last, ["file_id", "generation"], "left_semi").select("chunk_id", "file_id", "generation").distinct()


@reg("prune_history", "SELECT publish_dir, generation FROM (SELECT publish_dir, generation, row_number() OVER (PARTITION BY publish_dir ORDER BY generation DESC) AS k FROM (SELECT DISTINCT publish_dir, generation FROM snapshot_manifests WHERE files IS NOT NULL)) WHERE k > 3")
def prune_history(t: Tables) -> DataFrame:
    """Generations that may be dropped when the last three are kept."""
    w = Window.partitionBy("publish_dir").orderBy(F.col("generation").desc())
    kept = t.snapshot_manifests.where("files IS NOT NULL").select("publish_dir", "generation").distinct()
    return kept.withColumn("k", F.row_number().over(w)).where("k > 3").drop("k")


@reg("snapshot_verify", "SELECT publish_dir, generation, count(*) AS deliveries, count(DISTINCT len(files)) AS sizes FROM snapshot_manifests WHERE files IS NOT NULL GROUP BY ALL")
def snapshot_verify(t: Tables) -> DataFrame:
    return t.snapshot_manifests.where("files IS NOT NULL").groupBy("publish_dir", "generation").agg(F.count("*").alias("deliveries"), F.countDistinct(F.size("files")).alias("sizes"))


@reg(
    "status_counts",
    """SELECT root_id, count(*) AS files, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE contains(extraction_status, 'failed')) AS failed, CAST(sum(coalesce(n, 0)) AS BIGINT) AS symbols
FROM (SELECT DISTINCT id, root_id, deleted, extraction_status FROM files) f LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY file_id) s ON s.file_id = f.id GROUP BY root_id""",
)
def status_counts(t: Tables) -> DataFrame:
    n = t.symbols.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    f = t.files.select("id", "root_id", "deleted", "extraction_status").distinct().join(n, "id", "left")
    return f.groupBy("root_id").agg(F.count("*").alias("files"), F.count_if("deleted").alias("deleted"), F.count_if(F.col("extraction_status").contains("failed")).alias("failed"), F.sum(F.coalesce("n", F.lit(0))).alias("symbols"))


@reg("federated_status", "SELECT shard, sum(files)::BIGINT AS files, arg_min(generation, row(generation, root_id)) AS stalest FROM (SELECT r.id % 4 AS shard, r.id AS root_id, r.last_completed_generation AS generation, count(DISTINCT f.id) AS files FROM roots r LEFT JOIN files f ON f.root_id = r.id GROUP BY ALL) WHERE generation IS NOT NULL GROUP BY shard")
def federated_status(t: Tables) -> DataFrame:
    n = t.files.groupBy(F.col("root_id").alias("id")).agg(F.countDistinct("id").alias("files"))
    r = t.roots.where("last_completed_generation IS NOT NULL").join(n, "id", "left")
    return r.groupBy((F.col("id") % 4).alias("shard")).agg(F.sum(F.coalesce("files", F.lit(0))).alias("files"), F.min_by("last_completed_generation", F.struct("last_completed_generation", "id")).alias("stalest"))


@reg("semantic_eligible", "SELECT DISTINCT id FROM files WHERE NOT deleted AND size_bytes > 0 AND kind IN ('source', 'text', 'semi_structured', 'tabular') AND (content_indexed OR EXISTS (SELECT 1 FROM chunks WHERE chunks.file_id = files.id))")
def semantic_eligible(t: Tables) -> DataFrame:
    has = t.chunks.select(F.col("file_id").alias("id")).distinct().withColumn("has", F.lit(True))
    f = t.files.where(~F.col("deleted") & (F.col("size_bytes") > 0) & F.col("kind").isin("source", "text", "semi_structured", "tabular"))
    return f.join(has, "id", "left").where(F.col("content_indexed") | F.col("has")).select("id").distinct()


@reg("semantic_coverage", "SELECT file_id, generation, 'missing' AS side FROM (SELECT file_id, generation FROM search_docs EXCEPT SELECT file_id, generation FROM chunks) UNION ALL SELECT file_id, generation, 'surplus' FROM (SELECT file_id, generation FROM chunks EXCEPT SELECT file_id, generation FROM search_docs)")
def semantic_coverage(t: Tables) -> DataFrame:
    want, have = t.search_docs.select("file_id", "generation").distinct(), t.chunks.select("file_id", "generation").distinct()
    return want.subtract(have).withColumn("side", F.lit("missing")).unionByName(have.subtract(want).withColumn("side", F.lit("surplus")))


@reg("memory_staleness", "SELECT f.root_id, count(*) AS docs, count(*) FILTER (WHERE s.generation < f.generation) AS stale, max(f.generation - s.generation) AS max_lag FROM (SELECT DISTINCT file_id, generation FROM search_docs) s JOIN (SELECT DISTINCT id, root_id, generation FROM files WHERE NOT deleted) f ON f.id = s.file_id GROUP BY f.root_id")
def memory_staleness(t: Tables) -> DataFrame:
    f = t.files.where("NOT deleted").select(F.col("id").alias("file_id"), "root_id", F.col("generation").alias("now")).distinct()
    s = t.search_docs.select("file_id", "generation").distinct().join(f, "file_id")
    return s.groupBy("root_id").agg(F.count("*").alias("docs"), F.count_if(F.col("generation") < F.col("now")).alias("stale"), F.max(F.col("now") - F.col("generation")).alias("max_lag"))


@reg("file_page", "SELECT DISTINCT id, absolute_path FROM files WHERE id > 250 ORDER BY id LIMIT 100")
def file_page(t: Tables) -> DataFrame:
    """A keyset page: the limit is the feature."""
    return t.files.where("id > 250").select("id", "absolute_path").distinct().orderBy("id").limit(100)


@reg("agent_scope_depth", "SELECT doc_id, regexp_replace(path, '/[^/]*$', '') AS scope, len(string_split(path, '/')) - 2 AS depth FROM documents WHERE kind IN ('agent_skill', 'agent_memory') AND path IS NOT NULL")
def agent_scope_depth(t: Tables) -> DataFrame:
    d = t.documents.where(F.col("kind").isin("agent_skill", "agent_memory") & F.col("path").isNotNull())
    return d.select("doc_id", F.regexp_replace("path", "/[^/]*$", "").alias("scope"), (F.size(F.split("path", "/")) - 2).cast("long").alias("depth"))


@reg("cat_publisher_roots", "SELECT path, length(path) AS n FROM roots WHERE NOT EXISTS (SELECT 1 FROM documents WHERE kind = 'agent_memory' AND '/ws/' || source = roots.path)")
def cat_publisher_roots(t: Tables) -> DataFrame:
    memory = t.documents.where("kind = 'agent_memory'").select(F.concat(F.lit("/ws/"), "source").alias("path")).distinct()
    return t.roots.join(memory, "path", "left_anti").select("path", F.length("path").cast("long").alias("n"))


reg.text("cat_roots_ordered", "SELECT path, CAST(row_number() OVER (ORDER BY length(path) DESC, path) AS BIGINT) AS k FROM {roots}")
reg.text("cat_latest_generation", "SELECT max(last_completed_generation) AS latest, count(*) FILTER (WHERE last_completed_generation IS NULL) AS never FROM {roots}")
reg.text("cat_incomplete_exists", "SELECT root_id, bool_or(NOT content_indexed AND kind = 'source') AS incomplete FROM {files} WHERE NOT deleted GROUP BY root_id")
reg.text("cat_project_backfill", "SELECT source, max(CASE WHEN kind = 'agent_memory' THEN 1 ELSE 0 END) AS raw, count(*) AS n FROM {documents} GROUP BY source")
reg.text("cat_failures", "SELECT root_id, extraction_status, count(DISTINCT id) AS n FROM {files} WHERE contains(extraction_status, 'failed') OR contains(extraction_status, 'errors') GROUP BY root_id, extraction_status")
reg.text("cat_existing_file", "SELECT DISTINCT f.id, f.absolute_path FROM {files} f JOIN (SELECT DISTINCT path FROM {search_docs}) s ON s.path = f.absolute_path WHERE NOT f.deleted")
reg.text("cat_mark_seen", "SELECT DISTINCT f.id, coalesce(s.generation, f.generation) AS generation, s.generation IS NULL AS missing FROM {files} f LEFT JOIN (SELECT file_id, max(generation) AS generation FROM {search_docs} GROUP BY file_id) s ON s.file_id = f.id")
reg.text("cat_symbols_for", "SELECT file_id, name, line_start, line_end, count(*) OVER (PARTITION BY file_id) AS n FROM (SELECT DISTINCT file_id, name, line_start, line_end FROM {symbols}) t")
reg.text("cat_memory_states", "SELECT source, count(*) AS n, max(generation) AS generation FROM {documents} WHERE kind = 'agent_memory' GROUP BY source")
reg.text("scan_completed", "SELECT source, coalesce(max(generation), 0) AS generation FROM {documents} GROUP BY source")
reg.text("replacement_paths", "SELECT absolute_path AS path FROM {files} WHERE deleted UNION SELECT path FROM {search_docs}")


@reg(
    "log_dedupe",
    "SELECT line, min(doc_id) AS first_doc, count(*) AS n FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[0-9]+', '#', 'g') AS line FROM documents WHERE path LIKE '%.log') t GROUP BY line",
)
def log_dedupe(t: Tables) -> DataFrame:
    """Lines of logs that differ in numbers only, once, with the first document that has them."""
    lines = t.documents.where("path LIKE '%.log'").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(F.regexp_replace("line", "[0-9]+", "#").alias("line")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


_PROFILED = {
    "files": "id root_id absolute_path relative_path name extension kind experiment size_bytes mtime_ns content_hash generation content_indexed extraction_status deleted".split(),
    "symbols": "file_id name kind language line_start line_end signature".split(),
}


@reg("dataset_profile", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(any_value(typeof({c}))) END AS type, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM {t}" for t, cs in _PROFILED.items() for c in cs))
def dataset_profile(t: Tables) -> DataFrame:
    """Type, nulls and distinct values of every column: a column and value is a row, so one shuffle does for all columns."""
    parts = []
    for name, columns in _PROFILED.items():
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns))
        counted = getattr(t, name).select(F.explode(cells).alias("x")).groupBy("x.column_name", "x.v").agg(F.count("*").alias("n"))
        nulls = F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0))
        kinds = F.create_map(*(F.lit(x) for pair in getattr(t, name).dtypes if pair[0] in columns for x in pair))
        parts.append(counted.groupBy("column_name").agg(nulls.alias("nulls"), F.count("v").alias("distinct_values")).withColumn("table_name", F.lit(name)).withColumn("type", F.element_at(kinds, F.col("column_name"))))
    return parts[0].unionByName(parts[1]).select("table_name", "column_name", "type", "nulls", "distinct_values")


@reg(
    "exp_corpus_manifest",
    "SELECT root_id, count(*) AS n, count(DISTINCT absolute_path) AS paths, bit_xor(('0x' || left(m, 15))::BIGINT) AS digest, sum(('0x' || substring(m, 16, 8))::BIGINT)::BIGINT AS total FROM (SELECT *, sha256(id || ':' || absolute_path || ':' || coalesce(content_hash, '')) AS m FROM (SELECT DISTINCT id, root_id, absolute_path, content_hash FROM files)) GROUP BY root_id",
)
def exp_corpus_manifest(t: Tables) -> DataFrame:
    """Files and a digest of each root that no order enters: digests of the rows add up in every task before they meet."""
    f = t.files.select("id", "root_id", "absolute_path", "content_hash").distinct()
    mark = F.sha2(F.concat_ws(":", "id", "absolute_path", F.coalesce("content_hash", F.lit(""))), 256)
    number = lambda at, n: F.conv(F.substring("m", at, n), 16, 10).cast("long")
    return f.withColumn("m", mark).groupBy("root_id").agg(F.count("*").alias("n"), F.countDistinct("absolute_path").alias("paths"), F.bit_xor(number(1, 15)).alias("digest"), F.sum(number(16, 8)).alias("total"))


@reg("exp_versioned_mutations", "SELECT v.v AS version, count(*) AS files FROM (SELECT DISTINCT generation AS v FROM search_docs) v JOIN (SELECT file_id, min(generation) AS born FROM search_docs GROUP BY file_id) s ON s.born <= v.v GROUP BY v.v")
def exp_versioned_mutations(t: Tables) -> DataFrame:
    """Time travel: how many files each version of the store holds, as a running sum instead of a range join."""
    born = t.search_docs.groupBy("file_id").agg(F.min("generation").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    versions = t.search_docs.select(F.col("generation").alias("v")).distinct().join(born, "v", "left")
    return versions.select(F.col("v").alias("version"), F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("files"))


QUERIES, SQL = reg.queries, reg.sql
