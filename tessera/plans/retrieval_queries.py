"""Hybrid retrieval over the current texts. The queries are the texts whose file id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..operators.joins import ancestors, longest_prefix_owner
from ..session import written
from .registry import Registry, Tables

reg = Registry()
DEPTH, LIMIT, DIMS = 100, 10, 96


def current_docs(t: Tables) -> DataFrame:
    """The indexed text of each file that is not deleted, with its catalog row: the join that keeps only fresh generations."""
    files = t.files.where("NOT deleted").select(F.col("id").alias("file_id"), "generation", "root_id", "content_hash", "size_bytes").distinct()
    docs = t.search_docs.select("file_id", "path", "name", "experiment", "kind", "content", "symbols", "schema_text", "generation", "indexed_at")
    joined = docs.join(files, ["file_id", "generation"])
    w = Window.partitionBy("file_id").orderBy(F.col("indexed_at").desc(), "path")
    return joined.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "indexed_at")


def stored_docs(t: Tables) -> DataFrame:
    """The same, written once: each lane then reads only its own columns instead of joining all texts anew."""
    return written(current_docs(t), "current-docs")


def asked(docs: DataFrame) -> DataFrame:
    return docs.where("file_id % 50 = 0").select(F.col("file_id").alias("query_id"), F.concat_ws(" ", "symbols", "name").alias("query"))


_DOCS = """docs AS (SELECT * EXCLUDE (k, indexed_at) FROM (SELECT s.file_id, s.path, s.name, s.experiment, s.kind, s.content, s.symbols, s.schema_text, s.generation, f.root_id, f.content_hash, f.size_bytes, s.indexed_at,
  row_number() OVER (PARTITION BY s.file_id ORDER BY s.indexed_at DESC, s.path) AS k FROM search_docs s
  JOIN (SELECT DISTINCT id, generation, root_id, content_hash, size_bytes FROM files WHERE NOT deleted) f ON f.id = s.file_id AND f.generation = s.generation) WHERE k = 1),
queries AS (SELECT file_id AS query_id, concat_ws(' ', symbols, name) AS query FROM docs WHERE file_id % 50 = 0)"""
_TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND strlen(x) < 40)"
_LEX = "list_distinct(regexp_extract_all(lower({0}), '([a-z]+|[0-9]+)', 1))"


def _lane(name: str, text: str, where: str = "true", query: str = "query", asked_where: str = "true") -> str:
    """CTEs of one BM25 lane, ending in ``<name>_lane(query_id, file_id, score, rank)``."""
    return f"""{name}_t AS (SELECT file_id, toks FROM (SELECT file_id, {_TOKENS.format(text)} AS toks FROM docs WHERE {where}) WHERE len(toks) > 0),
{name}_s AS (SELECT count(*) AS n_docs, avg(len(toks)) AS mean FROM {name}_t),
{name}_q AS (SELECT query_id, unnest(list_distinct({_TOKENS.format(query)})) AS tok FROM queries WHERE {asked_where}),
{name}_p AS (SELECT file_id, len, tok, count(*) AS tf FROM (SELECT file_id, len(toks) AS len, unnest(toks) AS tok FROM {name}_t) WHERE tok IN (SELECT tok FROM {name}_q) GROUP BY ALL),
{name}_w AS (SELECT tok, mean, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT tok, count(*) AS df FROM {name}_p GROUP BY tok), {name}_s),
{name}_x AS (SELECT query_id, file_id, round(sum(idf * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * len / mean))), 6) AS score FROM {name}_q JOIN {name}_w USING (tok) JOIN {name}_p USING (tok) GROUP BY ALL),
{name}_lane AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM {name}_x) WHERE rank <= {DEPTH})"""


_EXPANDED = "concat_ws(' ', query, {})".format(", ".join("CASE WHEN list_has_any({}, [{}]) THEN '{}' END".format(_LEX.format("query"), ", ".join(f"'{w}'" for w in words), more) for words, more in X.SQL_EXPANSIONS))
_SQLISH = "list_has_any({}, [{}])".format(_LEX.format("query"), ", ".join(f"'{w}'" for w in X.SQL_WORDS))
_TEXTS = {
    "path": "concat_ws(' ', path, name, experiment)",
    "content": "content",
    "symbol": "symbols",
    "schema": "schema_text",
}


def lanes(names: tuple[str, ...], docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(lane, query_id, file_id, score, rank) of the lanes named: one index and one ranking for all."""
    read = {n: (F.endswith("name", F.lit(".sql")), F.concat_ws(" ", "path", "name", "content", "schema_text")) if n == "sql" else F.expr(_TEXTS[n]) for n in names}
    queries = asked(docs)
    wanted = F.array(*map(F.lit, names))
    if "sql" in names:
        wanted = F.when(X.is_sql_query(F.col("query")), wanted).otherwise(F.array_remove(wanted, "sql"))
    rows = queries.select("query_id", "query", F.explode(wanted).alias("lane"))
    return R.lane_ranks(R.posting_index(docs, read), rows.withColumn("query", F.when(F.col("lane") == "sql", X.expand_sql_query(F.col("query"))).otherwise(F.col("query"))), depth)


def lane(t: Tables, name: str, docs: DataFrame | None = None) -> DataFrame:
    return lanes((name,), current_docs(t) if docs is None else docs).drop("lane")


def _lane_sql(name: str) -> str:
    if name == "sql":
        return _lane("sql", "concat_ws(' ', path, name, content, schema_text)", "ends_with(name, '.sql')", _EXPANDED, _SQLISH)
    return _lane(name, _TEXTS[name])


def _register_lane(name: str) -> None:
    @reg(f"lane_{name}", f"WITH {_DOCS}, {_lane_sql(name)} SELECT query_id, file_id, score, rank FROM {name}_lane")
    def run(t: Tables) -> DataFrame:
        return lane(t, name).select("query_id", "file_id", "score", F.col("rank").cast("long").alias("rank"))


for _name in ("path", "content", "symbol", "schema", "sql"):
    _register_lane(_name)

_ANCHORS = r"""anchors AS (SELECT query_id, unnest(list_filter(list_transform(string_split_regex(query, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[`"''(),;]+|[`"''(),;]+$', '', 'g'), '^\./', '')),
 lambda w: NOT contains(w, ':') AND NOT contains(w, '//') AND strlen(w) <= 512 AND regexp_matches(w, '^(?:.*/)?[^/]+\.[A-Za-z]{1,12}$'))[1:4]) AS anchor FROM queries),
exact AS (SELECT DISTINCT query_id, file_id FROM anchors JOIN docs ON path = anchor OR ends_with(path, '/' || anchor))"""


@reg("exact_path_lane", f"WITH {_DOCS}, {_ANCHORS} SELECT query_id, file_id FROM exact")
def exact_path_lane(t: Tables) -> DataFrame:
    docs = current_docs(t)
    return R.exact_path_lane(docs, asked(docs))


_VECTOR = f"""usable AS (SELECT file_id, chunk_id, vector::DOUBLE[] AS v FROM chunks WHERE len(vector) = {DIMS} AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
vq AS (SELECT file_id AS query_id, arg_min(v, chunk_id) AS q FROM usable WHERE file_id % 50 = 0 GROUP BY file_id),
semantic_x AS (SELECT query_id, file_id, max(round(list_cosine_similarity(q, v), 6)) AS score FROM vq, usable GROUP BY ALL),
semantic_lane AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM semantic_x) WHERE rank <= 50)"""


def semantic(t: Tables) -> DataFrame:
    own = t.chunks.where("file_id % 50 = 0").where((F.size("vector") == DIMS) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0))
    queries = own.groupBy(F.col("file_id").alias("query_id")).agg(F.min_by("vector", "chunk_id").alias("vector"))
    return R.vector_lane(t.chunks, queries, 50, DIMS)


@reg("vector_lane", f"WITH {_VECTOR} SELECT query_id, file_id, score, rank FROM semantic_lane")
def vector_lane(t: Tables) -> DataFrame:
    return semantic(t).select("query_id", "file_id", "score", F.col("rank").cast("long").alias("rank"))


_LANES = ("path", "content", "symbol", "schema", "sql")


def _fused_sql(names: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, file_id, '{n}' AS lane, {R.WEIGHTS[n]}::DOUBLE / ({R.RRF_K} + rank) AS part FROM {n}_lane" for n in names)
    return f"fused AS (SELECT query_id, file_id, round(sum(part), 9) AS score, array_to_string(list_sort(list_distinct(list(lane))), ',') AS lanes FROM ({rows}) GROUP BY ALL)"


_ALL_LANES = ", ".join(_lane_sql(n) for n in _LANES)


@reg("rrf_fuse", f"WITH {_DOCS}, {_ALL_LANES}, {_fused_sql(_LANES)} SELECT * FROM fused")
def rrf_fuse(t: Tables) -> DataFrame:
    return R.fuse(lanes(_LANES, stored_docs(t)))


@reg("semantic_merge", f"WITH {_DOCS}, {_lane_sql('content')}, {_VECTOR}, {_fused_sql(('content', 'semantic'))} SELECT * FROM fused")
def semantic_merge(t: Tables) -> DataFrame:
    return R.fuse(lanes(("content",), stored_docs(t)), semantic(t).withColumn("lane", F.lit("semantic")))


_TERMS = r"""terms AS (SELECT query_id, unnest(list_distinct(list_transform(list_filter(ws, lambda w: length(w) >= 2 AND (len(ws) = 1 OR contains(w, '_') OR contains(w, '::') OR regexp_matches(w, '^..*[A-Z]') OR regexp_matches(w, '\d'))), lambda w: lower(w)))) AS term
 FROM (SELECT query_id, list_filter(list_transform(string_split_regex(trim(query), '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{L}\p{N}_:.]+|[^\p{L}\p{N}_:.]+$', '', 'g'), '(\(\))+$', '')), lambda w: w <> '') AS ws FROM queries)),
named AS (SELECT query_id, file_id, arg_min(s.name, row(s.line_start, s.name)) AS symbol, min(s.line_start) AS line FROM terms JOIN (SELECT DISTINCT file_id, name, line_start FROM symbols WHERE kind NOT IN ('call', 'import')) s ON lower(s.name) = term GROUP BY ALL)"""


@reg("exact_symbol_join", f"WITH {_DOCS}, {_TERMS} SELECT query_id, file_id, symbol, line FROM named")
def exact_symbol_join(t: Tables) -> DataFrame:
    return R.symbol_hits(t.symbols, asked(current_docs(t)))


_BOOSTED = f"""boosted AS (SELECT query_id, file_id, d.path, d.name, d.content_hash,
 round(coalesce(score, 0) + {R.COVERAGE_WEIGHT} * CASE WHEN len({_LEX.format('q.query')}) = 0 THEN 0 ELSE len(list_intersect({_LEX.format('q.query')}, {_LEX.format('d.path')})) * 1.0 / len({_LEX.format('q.query')}) END
  + CASE WHEN exact THEN {R.EXACT_PATH_BOOST} ELSE 0 END + CASE WHEN symbol IS NOT NULL THEN {R.EXACT_SYMBOL_BOOST} ELSE 0 END, 6) AS score,
 concat_ws(',', CASE WHEN exact THEN 'exact_path' END, CASE WHEN symbol IS NOT NULL THEN 'exact_symbol' END, lanes) AS lanes
 FROM fused FULL JOIN (SELECT query_id, file_id, symbol FROM named) n USING (query_id, file_id) FULL JOIN (SELECT query_id, file_id, true AS exact FROM exact) e USING (query_id, file_id) JOIN queries q USING (query_id) JOIN docs d USING (file_id))"""
_COPIES = """copies AS (SELECT * EXCLUDE (place, n), CASE WHEN content_hash IS NULL THEN 1 ELSE n END AS copies FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name, content_hash ORDER BY score DESC, path) AS place,
 count(*) OVER (PARTITION BY query_id, name, content_hash) AS n FROM boosted) WHERE place = 1 OR content_hash IS NULL)"""
_SPREAD = f"""spread AS (SELECT * EXCLUDE (score, d), round(score - CASE WHEN d > 1 THEN {R.DIRECTORY_PENALTY} ELSE 0 END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) AS d FROM copies)),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM spread) WHERE rank <= {LIMIT})"""
_HYBRID = f"{_DOCS}, {_ALL_LANES}, {_VECTOR}, {_fused_sql((*_LANES, 'semantic'))}, {_TERMS}, {_ANCHORS}, {_BOOSTED}, {_COPIES}, {_SPREAD}"


def candidates(t: Tables, docs: DataFrame) -> DataFrame:
    queries = asked(docs)
    fused = R.fuse(lanes(_LANES, docs), semantic(t).withColumn("lane", F.lit("semantic")))
    return R.boosted(fused, queries, docs, t.symbols, R.exact_path_lane(docs, queries))


def ranked(t: Tables, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    return R.diversify(R.collapse_copies(candidates(t, docs)), limit)


@reg("hybrid_search", f"WITH {_HYBRID} SELECT query_id, rank, f.file_id, f.path, score, lanes, copies, left(d.content, 160) AS preview FROM final f JOIN docs d USING (file_id)")
def hybrid_search(t: Tables) -> DataFrame:
    """The flagship: all lanes, fusion, boosts, copies, diversity and previews, of all queries in one plan."""
    docs = stored_docs(t)
    previews = docs.select("file_id", F.substring("content", 1, 160).alias("preview"))
    return ranked(t, docs).join(previews, "file_id").select("query_id", F.col("rank").cast("long").alias("rank"), "file_id", "path", "score", "lanes", F.col("copies").cast("long").alias("copies"), "preview")


@reg("collapse_copies", f"WITH {_HYBRID} SELECT query_id, file_id, score, copies FROM copies")
def collapse_copies(t: Tables) -> DataFrame:
    return R.collapse_copies(candidates(t, stored_docs(t))).select("query_id", "file_id", "score", F.col("copies").cast("long").alias("copies"))


@reg("mmr_directory", f"WITH {_HYBRID} SELECT query_id, file_id, score, rank FROM final")
def mmr_directory(t: Tables) -> DataFrame:
    return ranked(t, stored_docs(t)).select("query_id", "file_id", "score", F.col("rank").cast("long").alias("rank"))


@reg("topk_candidates", f"WITH {_DOCS}, {_lane_sql('content')} SELECT query_id, file_id, score FROM content_lane WHERE rank <= {LIMIT}")
def topk_candidates(t: Tables) -> DataFrame:
    return R.best(lane(t, "content").drop("rank"), LIMIT).select("query_id", "file_id", "score")


@reg(
    "lane_kind_filter",
    f"WITH {_DOCS}, {_lane('content', 'content', where="kind NOT IN ('text', 'tabular')")} SELECT query_id, file_id, score FROM content_lane",
)
def lane_kind_filter(t: Tables) -> DataFrame:
    """Kinds are filtered before ranking, so the depth is of files that may be shown."""
    docs = current_docs(t)
    return R.bm25_lane(docs.where(~F.col("kind").isin("text", "tabular")), asked(docs), F.col("content"), DEPTH).select("query_id", "file_id", "score")


@reg("scope_filter_pre", f"WITH {_DOCS}, {_lane('content', 'content', where="path = '/ws/ledger-forge' OR starts_with(path, '/ws/ledger-forge/')")} SELECT query_id, file_id, score FROM content_lane")
def scope_filter_pre(t: Tables) -> DataFrame:
    """A path scope, on component boundaries, applied before ranking."""
    docs = current_docs(t)
    inside = (F.col("path") == "/ws/ledger-forge") | F.col("path").startswith("/ws/ledger-forge/")
    return R.bm25_lane(docs.where(inside), asked(docs), F.col("content"), DEPTH).select("query_id", "file_id", "score")


@reg("catalog_freshness_join", f"WITH {_DOCS} SELECT d.file_id, d.generation, d.generation <= r.last_completed_generation AS completed FROM docs d JOIN roots r ON r.id = d.root_id")
def catalog_freshness_join(t: Tables) -> DataFrame:
    done = t.roots.select(F.col("id").alias("root_id"), "last_completed_generation")
    return current_docs(t).join(done, "root_id").select("file_id", "generation", (F.col("generation") <= F.col("last_completed_generation")).alias("completed"))


@reg(
    "metadata_left_joins",
    f"WITH {_DOCS} SELECT d.file_id, coalesce(s.n, 0) AS symbols, coalesce(c.n, 0) AS chunks FROM docs d LEFT JOIN (SELECT file_id, count(DISTINCT name) AS n FROM symbols GROUP BY file_id) s USING (file_id) LEFT JOIN (SELECT file_id, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY file_id) c USING (file_id)",
)
def metadata_left_joins(t: Tables) -> DataFrame:
    s = t.symbols.groupBy("file_id").agg(F.countDistinct("name").alias("s"))
    c = t.chunks.groupBy("file_id").agg(F.countDistinct("chunk_id").alias("c"))
    joined = current_docs(t).select("file_id").join(s, "file_id", "left").join(c, "file_id", "left")
    return joined.select("file_id", F.coalesce("s", F.lit(0)).alias("symbols"), F.coalesce("c", F.lit(0)).alias("chunks"))


@reg("root_admission", "SELECT DISTINCT d.source, EXISTS (SELECT 1 FROM roots r WHERE r.path = '/ws/' || d.source OR starts_with('/ws/' || d.source, r.path || '/') OR starts_with(r.path, '/ws/' || d.source || '/')) AS admitted FROM documents d WHERE d.source IS NOT NULL")
def root_admission(t: Tables) -> DataFrame:
    """Whether a requested folder is a registered root, below one or above one."""
    wanted = t.documents.where("source IS NOT NULL").select("source").distinct().withColumn("path", F.concat(F.lit("/ws/"), "source"))
    roots = t.roots.select(F.col("path").alias("root"))
    below = wanted.select("source", F.explode(ancestors(F.col("path"))).alias("root")).join(roots, "root").select("source")
    above = roots.select(F.explode(ancestors(F.col("root"))).alias("path")).join(wanted, "path").select("source")
    ok = below.union(above).distinct().withColumn("admitted", F.lit(True))
    return wanted.join(ok, "source", "left").select("source", F.coalesce("admitted", F.lit(False)).alias("admitted"))


@reg("longest_prefix_owner", "SELECT DISTINCT f.absolute_path AS path, (SELECT r.path FROM roots r WHERE f.absolute_path = r.path OR starts_with(f.absolute_path, r.path || '/') ORDER BY length(r.path) DESC LIMIT 1) AS root FROM files f")
def longest_prefix(t: Tables) -> DataFrame:
    return longest_prefix_owner(t.files.select(F.col("absolute_path").alias("path")).distinct(), t.roots.select(F.col("path").alias("root")))


@reg("path_prefix_filter", "SELECT DISTINCT id FROM files WHERE starts_with(absolute_path, '/ws/quartz') OR starts_with(relative_path, 'src')")
def path_prefix_filter(t: Tables) -> DataFrame:
    return t.files.where(F.col("absolute_path").startswith("/ws/quartz") | F.col("relative_path").startswith("src")).select("id").distinct()


@reg(
    "instruction_scope",
    f"""WITH s AS (SELECT regexp_extract(path, '^/[^/]+/[^/]+') AS scope, count(*) AS n FROM documents WHERE kind = 'agent_skill' AND path IS NOT NULL GROUP BY 1)
SELECT f.id, CAST(sum(s.n) AS BIGINT) AS skills, max(len(string_split(scope, '/')) - 1) AS depth, round({R.INSTRUCTION}::DOUBLE + {R.INSTRUCTION_DEPTH}::DOUBLE * max(len(string_split(scope, '/')) - 1), 6) AS boost FROM (SELECT DISTINCT id, absolute_path FROM files) f JOIN s ON starts_with(f.absolute_path, s.scope || '/') GROUP BY f.id""",
)
def instruction_scope(t: Tables) -> DataFrame:
    """How many skills apply to a file, from how deep a scope, and what the deepest adds to a score: counted per
    scope, then an equi join on the ancestors of a path."""
    skills = t.documents.where("kind = 'agent_skill' AND path IS NOT NULL").groupBy(F.regexp_extract("path", "^/[^/]+/[^/]+", 0).alias("scope")).agg(F.count("*").alias("n"))
    files = t.files.select("id", "absolute_path").distinct().select("id", F.explode(ancestors(F.regexp_replace("absolute_path", "/[^/]*$", ""))).alias("scope"))
    found = files.join(skills, "scope").groupBy("id").agg(F.sum("n").alias("skills"), F.max(F.size(F.split("scope", "/")) - 1).cast("long").alias("depth"))
    return found.withColumn("boost", F.round(R.INSTRUCTION + R.INSTRUCTION_DEPTH * F.col("depth"), 6))


@reg("dedup_memory", "SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents WHERE kind = 'agent_memory') WHERE k = 1 OR text IS NULL")
def dedup_memory(t: Tables) -> DataFrame:
    """Best of each content; a null content is never a duplicate. Grouped by digest, so texts are not shuffled."""
    d = t.documents.where("kind = 'agent_memory'").select("doc_id", F.sha2("text", 256).alias("h"))
    kept = d.where("h IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return kept.union(d.where("h IS NULL").select("doc_id"))


#: Shards of the corpus, and hits that each gives.
_SHARDS, _SHARD_HITS = 4, 200
_SHARED_LANES = ("path", "content")
_SHARD_SQL = ", ".join(_lane(f"{n}{k}", _TEXTS[n], where=f"root_id % {_SHARDS} = {k}") for n in _SHARED_LANES for k in range(_SHARDS))
_SHARD_ROWS = " UNION ALL ".join(f"SELECT {k} AS shard, '{n}' AS lane, {R.WEIGHTS[n]}::DOUBLE AS weight, query_id, file_id, score, rank FROM {n}{k}_lane" for n in _SHARED_LANES for k in range(_SHARDS))


@reg(
    "federated_search",
    f"""WITH {_DOCS}, {_SHARD_SQL}, hit AS ({_SHARD_ROWS}),
own AS (SELECT shard, query_id, file_id, round(sum(weight / ({R.RRF_K} + rank)), 9) AS score FROM hit GROUP BY ALL),
given AS (SELECT query_id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY shard, query_id ORDER BY score DESC, file_id) AS k FROM own) WHERE k <= {_SHARD_HITS}),
again AS (SELECT query_id, file_id, weight / ({R.RRF_K} + row_number() OVER (PARTITION BY lane, query_id ORDER BY score DESC, file_id)) AS part FROM hit JOIN given USING (query_id, file_id))
SELECT query_id, file_id, round(sum(part), 9) AS score FROM again GROUP BY ALL""",
)
def federated_search(t: Tables) -> DataFrame:
    """Each shard ranks by its own statistics and gives its best hits with their scores by lane; every lane is
    then ranked anew over the union, so that a shard's local ranks do not count. A lane of a shard is a lane."""
    docs = stored_docs(t).withColumn("shard", (F.col("root_id") % _SHARDS).cast("string"))
    read = {f"{n}/{k}": (F.col("shard") == str(k), F.expr(_TEXTS[n])) for n in _SHARED_LANES for k in range(_SHARDS)}
    queries = asked(docs).select("query_id", "query", F.explode(F.array(*map(F.lit, read))).alias("lane"))
    hits = R.lane_ranks(R.posting_index(docs, read), queries, DEPTH)
    parted = written(hits.select(F.split("lane", "/")[0].alias("lane"), F.split("lane", "/")[1].alias("shard"), "query_id", "file_id", "score", "rank"), "shard-hits")
    weight = F.element_at(F.create_map(*(F.lit(x) for n in _SHARED_LANES for x in (n, R.WEIGHTS[n]))), F.col("lane"))
    own = parted.groupBy("shard", "query_id", "file_id").agg(F.round(F.sum(weight / (R.RRF_K + F.col("rank"))), 9).alias("score"))
    first = Window.partitionBy("shard", "query_id").orderBy(F.col("score").desc(), "file_id")
    given = own.withColumn("k", F.row_number().over(first)).where(F.col("k") <= _SHARD_HITS).select("query_id", "file_id")
    again = Window.partitionBy("lane", "query_id").orderBy(F.col("score").desc(), "file_id")
    ranked_again = parted.join(given, ["query_id", "file_id"]).withColumn("part", weight / (R.RRF_K + F.row_number().over(again)))
    return ranked_again.groupBy("query_id", "file_id").agg(F.round(F.sum("part"), 9).alias("score"))


@reg("unmatched_filenames", f"WITH {_DOCS} SELECT DISTINCT name AS anchor FROM files WHERE regexp_matches(name, '^.+[.][A-Za-z]{{1,12}}$') AND name NOT IN (SELECT name FROM docs)")
def unmatched_filenames(t: Tables) -> DataFrame:
    """File names of the catalog, taken as anchors, that no indexed text has."""
    anchors = t.files.select(F.explode(X.filename_anchors(F.col("name"))).alias("anchor")).distinct()
    return anchors.join(current_docs(t).select(F.col("name").alias("anchor")), "anchor", "left_anti")


@reg(
    "inspect_file",
    f"""WITH {_DOCS} SELECT d.file_id, d.path, d.kind, array_to_string(list_sort(coalesce(s.names, [])), ',') AS symbol_names, left(d.content, 400) AS excerpt FROM docs d
LEFT JOIN (SELECT file_id, list(DISTINCT name) AS names FROM symbols GROUP BY file_id) s USING (file_id)""",
)
def inspect_file(t: Tables) -> DataFrame:
    names = t.symbols.groupBy("file_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return current_docs(t).join(names, "file_id", "left").select("file_id", "path", "kind", F.coalesce(F.array_join("names", ","), F.lit("")).alias("symbol_names"), F.substring("content", 1, 400).alias("excerpt"))


@reg(
    "symbol_outline",
    "SELECT file_id, name, line_start, CAST(k AS BIGINT) AS k FROM (SELECT file_id, name, line_start, row_number() OVER (PARTITION BY file_id ORDER BY is_ref, line_start, name) AS k FROM (SELECT DISTINCT file_id, name, line_start, kind IN ('call', 'import') AS is_ref FROM symbols)) WHERE k <= 24",
)
def symbol_outline(t: Tables) -> DataFrame:
    """The first 24 symbols of a file, definitions before what only refers to one."""
    w = Window.partitionBy("file_id").orderBy("is_ref", "line_start", "name")
    rows = t.symbols.select("file_id", "name", "line_start", F.col("kind").isin("call", "import").alias("is_ref")).distinct()
    return rows.withColumn("k", F.row_number().over(w).cast("long")).where("k <= 24").select("file_id", "name", "line_start", "k")


@reg(
    "inspect_symbol_focus",
    "SELECT file_id, lower(name) AS term, arg_min(line_start, row(kind IN ('call', 'import'), line_start)) AS line, greatest(arg_min(line_start, row(kind IN ('call', 'import'), line_start)) - 2, 1) AS window_start FROM symbols WHERE line_start IS NOT NULL GROUP BY ALL",
)
def inspect_symbol_focus(t: Tables) -> DataFrame:
    """Where a file defines a name, whatever its case; where it is only called or imported, the first such line."""
    first = F.min(F.struct(F.col("kind").isin("call", "import").alias("is_ref"), F.col("line_start").alias("line")))["line"]
    return t.symbols.where("line_start IS NOT NULL").groupBy("file_id", F.lower("name").alias("term")).agg(first.alias("line")).withColumn("window_start", F.greatest(F.col("line") - 2, F.lit(1)))


QUERIES, SQL = reg.queries, reg.sql
