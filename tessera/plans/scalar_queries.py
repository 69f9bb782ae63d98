"""Per-row derivations of names, paths, texts and vectors, and the function families of the SQL lane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.content import current_content
from ..operators import extract as E
from ..operators.extract import agent_metadata, chunk_lines, json_key_paths, redact_json, sql_sections, symbols_of
from .registry import Registry, Tables

reg = Registry()

CURRENT = """(SELECT f.id AS file_id, min(f.root_id) AS root_id, min(lower(f.extension)) AS extension, min(f.kind) AS kind, min(f.relative_path) AS relative_path, arg_max(s.content, s.indexed_at) AS content
 FROM files f JOIN search_docs s ON s.file_id = f.id AND s.generation = f.generation WHERE NOT f.deleted AND s.content IS NOT NULL GROUP BY f.id, f.generation)"""

_KINDS = "CASE name WHEN 'AGENTS.md' THEN 'agent_instructions' WHEN 'SKILL.md' THEN 'agent_skill' ELSE CASE " + " ".join(
    "WHEN ext IN ({}) THEN '{}'".format(", ".join(f"'{e}'" for e in words), kind) for kind, words in X.KIND_EXTENSIONS.items()
) + " ELSE 'unknown' END END"
_EXT = "nullif(lower(regexp_extract(name, '^.+\\.([^.]*)$', 1)), '')"


@reg("classify_kind", f"SELECT DISTINCT id, {_KINDS} AS kind FROM (SELECT id, name, {_EXT} AS ext FROM files)")
def classify_kind(t: Tables) -> DataFrame:
    return t.files.select("id", X.classify_kind(F.col("name")).alias("kind")).distinct()


@reg("path_extension", f"SELECT {_EXT} AS ext, count(DISTINCT id) AS n FROM files GROUP BY ALL")
def path_extension(t: Tables) -> DataFrame:
    return t.files.groupBy(X.path_extension(F.col("name")).alias("ext")).agg(F.countDistinct("id").alias("n"))


@reg("experiment_name", "SELECT DISTINCT id, CASE WHEN contains(relative_path, '/') THEN string_split(relative_path, '/')[1] END AS experiment FROM files")
def experiment_name(t: Tables) -> DataFrame:
    return t.files.select("id", X.experiment_name(F.col("relative_path")).alias("experiment")).distinct()


@reg(
    "combined_status",
    """SELECT DISTINCT id, concat_ws(',', CASE WHEN content_indexed THEN 'indexed' ELSE 'metadata_only' END, CASE kind WHEN 'source' THEN 'source' ELSE 'not_source' END,
 CASE WHEN kind = 'tabular' THEN 'profiled' END) AS status FROM files""",
)
def combined_status(t: Tables) -> DataFrame:
    parts = F.concat_ws(
        ",", F.when(F.col("content_indexed"), "indexed").otherwise("metadata_only"), F.when(F.col("kind") == "source", "source").otherwise("not_source"), F.when(F.col("kind") == "tabular", "profiled")
    )
    return t.files.select("id", parts.alias("status")).distinct()


_EXCLUDED = ", ".join(f"'{c}'" for c in X.EXCLUDED_COMPONENTS)


@reg("filter_default_excluded", f"SELECT DISTINCT path, NOT list_has_any(string_split(path, '/'), [{_EXCLUDED}]) AS kept FROM (SELECT replace(absolute_path, '/cache/', '/.cache/') AS path FROM files)")
def filter_default_excluded(t: Tables) -> DataFrame:
    paths = t.files.select(F.replace("absolute_path", F.lit("/cache/"), F.lit("/.cache/")).alias("path")).distinct()
    return paths.select("path", (~X.is_excluded(F.col("path"))).alias("kept"))


@reg("filter_sensitive_name", "SELECT DISTINCT id FROM files WHERE lower(name) = '.env' OR regexp_matches(lower(name), '\\.(pem|key)$') OR regexp_matches(lower(name), 'credential|access_token|secret_key')")
def filter_sensitive_name(t: Tables) -> DataFrame:
    return t.files.where(X.is_sensitive_name(F.col("name"))).select("id").distinct()


@reg(
    "extract_text_bounded",
    """SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) > 20000 THEN 'metadata_only_oversized' WHEN contains(text, chr(0)) THEN 'metadata_only_binary' ELSE 'indexed' END AS status,
 sha256(text) AS content_hash, left(text, 200) AS preview FROM documents""",
)
def extract_text_bounded(t: Tables) -> DataFrame:
    text = F.col("text")
    status = F.when(text.isNull(), "missing").when(F.octet_length(text) > 20000, "metadata_only_oversized").when(text.contains("\0"), "metadata_only_binary").otherwise("indexed")
    return t.documents.select("doc_id", status.alias("status"), F.sha2(text, 256).alias("content_hash"), F.substring(text, 1, 200).alias("preview"))


@reg("extract_policy", "SELECT DISTINCT id, kind NOT IN ('binary', 'unknown') AS readable FROM files")
def extract_policy(t: Tables) -> DataFrame:
    return t.files.select("id", (~F.col("kind").isin("binary", "unknown")).alias("readable")).distinct()


_LEX = "list_distinct(regexp_extract_all(lower({0}), '([a-z]+|[0-9]+)', 1))"
_TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) < 40)"


@reg("lexical_tokens", f"SELECT DISTINCT id, array_to_string(list_sort({_LEX.format('relative_path')}), ' ') AS tokens FROM files")
def lexical_tokens(t: Tables) -> DataFrame:
    return t.files.select("id", F.array_join(F.array_sort(X.lexical_tokens(F.col("relative_path"))), " ").alias("tokens")).distinct()


@reg("text_tokens", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token")
def text_tokens(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(X.text_tokens(F.col("text"))).alias("token"))
    # counted per document first: what is shuffled is pairs, not occurrences
    return words.groupBy("token", "doc_id").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


_QUERY = "json_extract_string(arguments, '$.query')"
_SEARCHES = f"(SELECT DISTINCT {_QUERY} AS query FROM audit_records WHERE tool = 'workspace_search' AND {_QUERY} IS NOT NULL)"


def searches(t: Tables) -> DataFrame:
    query = F.get_json_object("arguments", "$.query")
    return t.audit_records.where("tool = 'workspace_search'").select(query.alias("query")).where("query IS NOT NULL").distinct()


@reg("path_token_coverage", f"SELECT DISTINCT id, round(len(list_intersect({_LEX.format('name')}, {_LEX.format('relative_path')})) * 1.0 / greatest(len({_LEX.format('name')}), 1), 6) AS coverage FROM files")
def path_token_coverage(t: Tables) -> DataFrame:
    return t.files.select("id", F.round(X.token_coverage(F.col("name"), F.col("relative_path")), 6).alias("coverage")).distinct()


@reg(
    "filename_anchors",
    r"""SELECT DISTINCT query, array_to_string(list_filter(list_transform(string_split_regex(query, '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[`"''(),;]+|[`"''(),;]+$', '', 'g'), '^\./', '')),
 lambda w: NOT contains(w, ':') AND NOT contains(w, '//') AND strlen(w) <= 512 AND regexp_matches(w, '^(?:.*/)?[^/]+\.[A-Za-z]{1,12}$'))[1:4], '|') AS anchors
FROM (SELECT 'open `' || relative_path || '` and ' || name AS query FROM files UNION ALL SELECT content FROM search_docs WHERE content IS NOT NULL)""",
)
def filename_anchors(t: Tables) -> DataFrame:
    asked = t.files.select(F.concat(F.lit("open `"), "relative_path", F.lit("` and "), "name").alias("query"))
    asked = asked.unionByName(t.search_docs.where("content IS NOT NULL").select(F.col("content").alias("query"))).distinct()
    return asked.select("query", F.array_join(X.filename_anchors(F.col("query")), "|").alias("anchors"))


_SQLW = ", ".join(f"'{w}'" for w in X.SQL_WORDS)


@reg("is_sql_query", f"SELECT query, list_has_any({_LEX.format('query')}, [{_SQLW}]) AS sql FROM {_SEARCHES}")
def is_sql_query(t: Tables) -> DataFrame:
    return searches(t).select("query", X.is_sql_query(F.col("query")).alias("sql"))


_EXPAND = ", ".join("CASE WHEN list_has_any({}, [{}]) THEN '{}' END".format(_LEX.format("query"), ", ".join(f"'{w}'" for w in words), more) for words, more in X.SQL_EXPANSIONS)


@reg("expand_sql_query", f"SELECT query, concat_ws(' ', query, {_EXPAND}) AS expanded FROM {_SEARCHES}")
def expand_sql_query(t: Tables) -> DataFrame:
    return searches(t).select("query", X.expand_sql_query(F.col("query")).alias("expanded"))


@reg(
    "query_symbol_terms",
    rf"""WITH w AS (SELECT query, list_filter(list_transform(string_split_regex(trim(query), '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}_:.]+|[^\p{{L}}\p{{N}}_:.]+$', '', 'g'), '(\(\))+$', '')), lambda w: w <> '') AS ws
 FROM (SELECT query FROM {_SEARCHES} UNION SELECT signature FROM symbols WHERE signature IS NOT NULL))
SELECT query, array_to_string(list_sort(list_distinct(list_transform(list_filter(ws, lambda w: length(w) >= 2 AND (len(ws) = 1 OR contains(w, '_') OR contains(w, '::') OR regexp_matches(w, '^..*[A-Z]') OR regexp_matches(w, '\d'))), lambda w: lower(w)))), ' ') AS terms FROM w""",
)
def query_symbol_terms(t: Tables) -> DataFrame:
    asked = searches(t).union(t.symbols.where("signature IS NOT NULL").select("signature")).distinct()
    return asked.select("query", F.array_join(F.array_sort(X.query_symbol_terms(F.col("query"))), " ").alias("terms"))


_NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@reg("normalized_match_text", f"SELECT query, {_NORM.format('query')} AS norm FROM {_SEARCHES}")
def normalized_match_text(t: Tables) -> DataFrame:
    return searches(t).select("query", X.normalized_match_text(F.col("query")).alias("norm"))


@reg(
    "contains_entity",
    f"""SELECT s.file_id, s.name FROM (SELECT DISTINCT file_id, name FROM symbols) s JOIN {CURRENT} c ON c.file_id = s.file_id
 WHERE contains(' ' || {_NORM.format('c.content')} || ' ', ' ' || {_NORM.format('s.name')} || ' ')""",
)
def contains_entity(t: Tables) -> DataFrame:
    now = current_content(t.files, t.search_docs).select("file_id", X.normalized_match_text(F.col("content")).alias("norm"))
    names = t.symbols.select("file_id", "name").distinct()
    return names.join(now, "file_id").where(X.contains_entity(F.col("norm"), X.normalized_match_text(F.col("name")))).select("file_id", "name")


@reg(
    "is_specific_query",
    rf"SELECT query, len(list_filter(string_split({_NORM.format('query')}, ' '), lambda w: strlen(w) >= 16 OR regexp_matches(w, '\p{{N}}'))) > 0 OR regexp_matches(query, '[\p{{L}}\p{{N}}][-_/.][\p{{L}}\p{{N}}]') AS spec FROM {_SEARCHES}",
)
def is_specific_query(t: Tables) -> DataFrame:
    return searches(t).select("query", X.is_specific_query(F.col("query")).alias("spec"))


@reg("secret_detect", "SELECT file_id FROM {} WHERE regexp_matches(content, '{}')".format(CURRENT, "|".join(X.SECRET_SHAPES)))
def secret_detect(t: Tables) -> DataFrame:
    return current_content(t.files, t.search_docs).where(X.has_secret(F.col("content"))).select("file_id")


@reg(
    "redact_text",
    r"""SELECT file_id, CASE WHEN length(r) <= 2048 THEN r ELSE left(r, 2048) || '[TRUNCATED]' END AS redacted FROM (SELECT file_id, replace(regexp_replace(regexp_replace(regexp_replace(content,
 '(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]{8,}', '\1[REDACTED]', 'g'),
 '(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|token|secret|password|authorization)\b(\s*(?:=|:)\s*)(?:"[^"]*"|''[^'']*''|[^\s,;]+)', '\1\2[REDACTED]', 'g'),
 '\bsk-[A-Za-z0-9_-]{8,}\b', '[REDACTED]', 'g'), '[REDACTED] [REDACTED]', '[REDACTED]') AS r FROM """
    + CURRENT
    + ")",
)
def redact_text(t: Tables) -> DataFrame:
    return current_content(t.files, t.search_docs).select("file_id", X.redact_text(F.col("content")).alias("redacted"))


@reg("redact_value")
def redact_value(t: Tables) -> DataFrame:
    return redact_json(t.audit_records.select("session_id", "pid", "sequence", "arguments").distinct(), "arguments")


@reg(
    "normalize_client",
    """SELECT client_name, CASE WHEN known[1] IS NOT NULL THEN MAP {{{0}}}[known[1]] WHEN slug <> '' THEN slug END AS client FROM (
 SELECT client_name, list_filter(string_split_regex(lower(client_name), '[^a-z0-9]+'), lambda w: list_contains([{1}], w)) AS known,
 regexp_replace(left(regexp_replace(left(regexp_replace(lower(trim(client_name)), '[^a-z0-9]+', '-', 'g'), 81), '^-', ''), 80), '-+$', '') AS slug
 FROM (SELECT DISTINCT client_name FROM audit_records WHERE client_name IS NOT NULL))""".format(", ".join(f"'{a}': '{b}'" for a, b in X.CLIENT_NAMES.items()), ", ".join(f"'{a}'" for a in X.CLIENT_NAMES)),
)
def normalize_client(t: Tables) -> DataFrame:
    return t.audit_records.where("client_name IS NOT NULL").select("client_name").distinct().select("client_name", X.normalize_client(F.col("client_name")).alias("client"))


@reg("agent_frontmatter")
def agent_frontmatter(t: Tables) -> DataFrame:
    """Front matter, headings and local links of the agents' documents."""
    return agent_metadata(t.documents.where(F.col("kind").isin("agent_skill", "agent_memory") & F.col("text").isNotNull()), "doc_id", "path", "text")


@reg("md_headings", r"""SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^#{1,6} +([^\n]*?) *\r?$', 1)) AS heading FROM documents WHERE kind = 'agent_skill' AND text IS NOT NULL""")
def md_headings(t: Tables) -> DataFrame:
    headings = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6} +([^\n]*?) *\r?$"), F.lit(1))
    return t.documents.where("kind = 'agent_skill' AND text IS NOT NULL").select("doc_id", F.explode(headings).alias("heading"))


@reg(
    "md_links",
    r"""SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\[[^\]]*\]\(([^)\s]+)\)', 1), lambda x: trim(string_split(x, '#')[1])),
 lambda x: x <> '' AND NOT starts_with(x, '/') AND NOT contains(x, '://') AND NOT starts_with(x, 'mailto:')))) AS link FROM documents WHERE text IS NOT NULL""",
)
def md_links(t: Tables) -> DataFrame:
    """Local targets of the links of a text, each once, without the part behind ``#``."""
    targets = F.transform(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)), lambda x: F.trim(F.split(x, "#")[0]))
    local = F.filter(targets, lambda x: (x != "") & ~x.startswith("/") & ~x.contains("://") & ~x.startswith("mailto:"))
    return t.documents.where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(local)).alias("link"))


_LINES = r"string_split_regex(regexp_replace(content, '(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]')"
_ROWS = f"SELECT file_id, extension, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM {CURRENT} WHERE content <> ''"


def _declared(lang: str, kind: str, pattern: str) -> str:
    names = f"regexp_extract_all(line, '{pattern}', 1)"
    if kind == "call":
        names = f"list_filter(list_distinct({names}), lambda x: x NOT IN ({', '.join(repr(w) for w in E.NO_CALLS)}))"
    return f"SELECT file_id, n, indent, line, '{kind}' AS kind, unnest({names}) AS name FROM l WHERE NOT comment AND lang = '{lang}'" + (" AND NOT declares" if kind == "call" else "")


@reg(
    "extract_symbols",
    rf"""WITH l AS (SELECT file_id, CASE extension WHEN 'pyi' THEN 'py' ELSE extension END AS lang, line, n, length(regexp_extract(line, '^\s*')) AS indent,
  regexp_matches(line, '^\s*(?://|\*|/\*)') OR extension IN ('py', 'pyi') AND regexp_matches(line, '^\s*#') AS comment,
  regexp_matches(line, '^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern)\s+)*(?:fn|func)\s') AS declares
 FROM ({_ROWS}) WHERE extension IN ('py', 'pyi', 'rs', 'go') AND trim(line) <> ''),
d AS ({" UNION ALL ".join(_declared(lang, kind, pattern) for lang, known in E.DECLARATIONS.items() for kind, pattern in known)}),
e AS (SELECT d.file_id, d.n, d.name, d.kind, d.line, d.indent, (SELECT min(l.n) FROM l WHERE l.file_id = d.file_id AND l.n > d.n AND l.indent <= d.indent) AS stop FROM d)
SELECT file_id, left(name, 160) AS name, kind, CAST(n AS INTEGER) AS line_start,
 CAST(CASE WHEN kind IN ('import', 'call') THEN n WHEN EXISTS (SELECT 1 FROM l WHERE l.file_id = e.file_id AND l.n = e.stop AND l.indent = e.indent AND regexp_matches(l.line, '^\s*[}})\]]')) THEN stop
  ELSE (SELECT max(l.n) FROM l WHERE l.file_id = e.file_id AND l.n < coalesce(e.stop, 2147483647)) END AS INTEGER) AS line_end,
 left(trim(regexp_replace(line, '\s+', ' ', 'g')), 240) AS signature FROM e""",
)
def extract_symbols(t: Tables) -> DataFrame:
    return symbols_of(current_content(t.files, t.search_docs))


@reg("chunk_text")
def chunk_text(t: Tables) -> DataFrame:
    return chunk_lines(current_content(t.files, t.search_docs).select("file_id", "content"))


_QUOTED = E.QUOTED.replace("'", "''")


@reg(
    "chunk_sql_sections",
    rf"""WITH r AS (SELECT file_id, n, line, lower(line) AS low, regexp_replace(line, '{_QUOTED}', '', 'g') AS bare FROM ({_ROWS}) WHERE extension = 'sql'),
s AS (SELECT *, sum(length(bare) - length(replace(bare, '(', '')) - length(bare) + length(replace(bare, ')', ''))) OVER (PARTITION BY file_id ORDER BY n) AS total FROM r),
d AS (SELECT *, total - least(min(total) OVER (PARTITION BY file_id ORDER BY n), 0) AS depth FROM s),
o AS (SELECT *, coalesce(lag(depth) OVER w, 0) = 0 AND regexp_matches(low, '{E.SECTION_START}') AND NOT coalesce(trim(lag(low) OVER w) = 'with', false) AS opens, regexp_matches(low, '^\s*select') AS sel,
  regexp_matches(low, '^\s*(?:insert|create) ') AS writes FROM d WINDOW w AS (PARTITION BY file_id ORDER BY n)),
g AS (SELECT *, sum(CASE WHEN opens AND NOT sel THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n) AS grp FROM o),
f AS (SELECT *, opens AND (NOT sel OR NOT coalesce(bool_or(writes) OVER (PARTITION BY file_id, grp ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS first FROM g),
p AS (SELECT file_id, n, line, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n) AS sec FROM f),
b AS (SELECT file_id, sec, trim(string_agg(line, chr(10) ORDER BY n), E' \t\n\r') AS body FROM p GROUP BY ALL)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY sec) - 1 AS part, body FROM b WHERE body <> ''""",
)
def chunk_sql_sections(t: Tables) -> DataFrame:
    return sql_sections(current_content(t.files, t.search_docs).where("extension = 'sql'").select("file_id", "content")).withColumn("part", F.col("part").cast("long"))


# What a script's words say about it, and how many of each kind are listed.
_SAYS = [
    (r"left semi join|right semi join", "semi-join filtering through a target relation"),
    (r"row_number.* over | over .*row_number", "windowed row ranking"),
    (r"partition by", "partitioned window computation"),
    (r"group by", "grouped aggregation"),
    (r"insert overwrite", "materialized output"),
]
_LISTED = 16
_CTE, _RELATION = r"(?im)^\s*(?:with\s+)?([a-z_][a-z0-9_$]*)\s+as\s*\(", r"(?i)\b(?:from|join|into|update|table|view)\s+([`a-z_][`a-z0-9_.$/-]*)"
_IDENTIFIER, _FALLING, _OFF = r"\b[a-z][a-z0-9]*_[a-z0-9_]+\b", r"(?i)\border\s+by\s+([a-z_][a-z0-9_.]*)\s+desc\b", r"(?i)\b(?:[a-z_][a-z0-9_.]*\.)?is_([a-z0-9_]+)\s*=\s*0\b"


@reg(
    "sql_structure_summary",
    rf"""WITH c AS (SELECT file_id, content, regexp_replace(lower(content), '\s+', ' ', 'g') AS flat FROM {CURRENT} WHERE extension = 'sql'),
i AS (SELECT file_id, array_to_string(list(id ORDER BY n DESC, first)[1:{_LISTED}], ', ') AS ids FROM (SELECT file_id, id, count(*) AS n, min(k) AS first FROM (
  SELECT file_id, unnest(x) AS id, generate_subscripts(x, 1) AS k FROM (SELECT file_id, regexp_extract_all(lower(content), '{_IDENTIFIER}') AS x FROM c)) GROUP BY ALL) GROUP BY file_id),
f AS (SELECT *, regexp_extract_all(content, '{_FALLING}', 1) AS falling, regexp_extract_all(content, '{_OFF}', 1) AS off, regexp_extract_all(content, '{_CTE}', 1) AS ctes, regexp_extract_all(content, '{_RELATION}', 1) AS rel FROM c)
SELECT f.file_id, array_to_string(list_concat([{", ".join(f"CASE WHEN regexp_matches(flat, '{p}') THEN '{said}' END" for p, said in _SAYS)}],
  list_concat(list_transform(list_sort(list_distinct(falling)), lambda x: 'descending ranking by ' || replace(CASE regexp_extract(x, '[^.]*$') WHEN 'cost' THEN 'cost/spend' ELSE regexp_extract(x, '[^.]*$') END, '_', ' ')),
   list_transform(list_sort(list_distinct(off)), lambda x: 'non-' || replace(x, '_', ' ') || ' rows'))), '; ') AS features,
 array_to_string(list_sort(list_distinct(ctes))[1:{_LISTED}], ', ') AS ctes,
 array_to_string(list_sort(list_distinct(list_filter(rel, lambda x: lower(replace(x, '`', '')) NOT IN ('on', 'select'))))[1:{_LISTED}], ', ') AS relations, coalesce(i.ids, '') AS identifiers
FROM f LEFT JOIN i ON i.file_id = f.file_id""",
)
def sql_structure_summary(t: Tables) -> DataFrame:
    """What a script does, its named queries, its relations and its 16 most frequent identifiers (ties by first place)."""
    scripts = current_content(t.files, t.search_docs).where("extension = 'sql'").select("file_id", "content")
    every = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(1))))
    flat = F.regexp_replace(F.lower("content"), r"\s+", " ")
    last = lambda x: F.regexp_extract(x, "[^.]*$", 0)
    falling = F.transform(every(_FALLING), lambda x: F.concat(F.lit("descending ranking by "), F.replace(F.when(last(x) == "cost", "cost/spend").otherwise(last(x)), F.lit("_"), F.lit(" "))))
    off = F.transform(every(_OFF), lambda x: F.concat(F.lit("non-"), F.replace(x, F.lit("_"), F.lit(" ")), F.lit(" rows")))
    features = F.array_join(F.concat(F.array(*(F.when(flat.rlike(p), said) for p, said in _SAYS)), falling, off), "; ")
    relations = F.filter(every(_RELATION), lambda x: ~F.lower(F.replace(x, F.lit("`"), F.lit(""))).isin("on", "select"))
    named = scripts.select("file_id", F.posexplode(F.regexp_extract_all(F.lower("content"), F.lit(_IDENTIFIER), F.lit(0))).alias("k", "id")).groupBy("file_id", "id").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "id"))), 1, _LISTED)
    ids = named.groupBy("file_id").agg(F.array_join(top["id"], ", ").alias("identifiers"))
    listed = scripts.select("file_id", features.alias("features"), F.array_join(F.slice(every(_CTE), 1, _LISTED), ", ").alias("ctes"), F.array_join(F.slice(relations, 1, _LISTED), ", ").alias("relations"))
    return listed.join(ids, "file_id", "left").withColumn("identifiers", F.coalesce("identifiers", F.lit("")))


#: Chunks that are kept of a file, and of a script.
_CHUNKS, _SCRIPT_CHUNKS = 4, 8


def _spread(count, most):
    """Up to ``most`` places among ``count``, evenly spread with the first and the last; one place is the last."""
    places = F.transform(F.sequence(F.lit(0), most - 1), lambda k: F.bround(k * (count - 1) / (most - 1)).cast("int"))
    return F.when(count <= most, F.sequence(F.lit(0), count - 1)).when(most == 1, F.array(count - 1)).otherwise(F.array_distinct(places))


@reg(
    "representative_chunks",
    f"""WITH c AS (SELECT file_id, chunk_id, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n,
 CASE WHEN bool_or(ends_with(path, '.sql')) OVER (PARTITION BY file_id) THEN {_SCRIPT_CHUNKS} ELSE {_CHUNKS} END AS most FROM (SELECT file_id, chunk_id, min(path) AS path FROM chunks GROUP BY ALL))
SELECT file_id, chunk_id FROM c WHERE n <= most OR list_contains(list_transform(range(most), lambda k: round_even(k * (n - 1) / (most - 1), 0)::BIGINT), i)""",
)
def representative_chunks(t: Tables) -> DataFrame:
    """Of each file's chunks four, of a script's eight, spread evenly over their order."""
    of_file = t.chunks.groupBy("file_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("all"), F.when(F.bool_or(F.endswith("path", F.lit(".sql"))), _SCRIPT_CHUNKS).otherwise(_CHUNKS).alias("most"))
    picked = of_file.select("file_id", "all", F.explode(_spread(F.size("all"), F.col("most"))).alias("i"))
    return picked.select("file_id", F.get("all", F.col("i")).alias("chunk_id"))


@reg("balanced_groups", "SELECT id, CAST(ntile(7) OVER (PARTITION BY root_id ORDER BY id) AS BIGINT) AS grp FROM (SELECT DISTINCT id, root_id FROM files)")
def balanced_groups(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.files.select("id", "root_id").distinct().select("id", F.ntile(7).over(Window.partitionBy("root_id").orderBy("id")).cast("long").alias("grp"))


#: Tokens of a window.
_WINDOW = 480


@reg(
    "token_window_chunks",
    rf"""WITH t AS (SELECT doc_id, CASE WHEN ends_with(lower(path), '.sql') THEN {_SCRIPT_CHUNKS} ELSE {_CHUNKS} END AS most,
  regexp_extract_all('Path: ' || coalesce(path, '') || chr(10) || 'File type: ' || kind || chr(10) || text, '\s*\S+') AS tokens FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, most, tokens, CAST(ceil(len(tokens) / {_WINDOW}.0) AS BIGINT) AS n FROM t),
p AS (SELECT doc_id, tokens, unnest(list_sort(list_distinct(CASE WHEN n <= most THEN range(n) ELSE list_transform(range(most), lambda k: round_even(k * (n - 1) / (most - 1), 0)::BIGINT) END))) AS i FROM w),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS part, array_to_string(tokens[i * {_WINDOW} + 1 : i * {_WINDOW} + {_WINDOW}], '') AS body FROM p)
SELECT doc_id, part, left(sha256(doc_id || '|' || part || '|' || body), 32) AS chunk_id, body FROM b""",
)
def token_window_chunks(t: Tables) -> DataFrame:
    """Windows of 480 tokens over a header and the text; of a document's windows four, of a script's eight."""
    header = F.concat(F.lit("Path: "), F.coalesce("path", F.lit("")), F.lit("\nFile type: "), "kind", F.lit("\n"))
    most = F.when(F.endswith(F.lower("path"), F.lit(".sql")), _SCRIPT_CHUNKS).otherwise(_CHUNKS)
    cut = t.documents.where("text IS NOT NULL").select("doc_id", most.alias("most"), F.regexp_extract_all(F.concat(header, "text"), F.lit(r"\s*\S+"), F.lit(0)).alias("tokens"))
    windows = cut.select("doc_id", "tokens", F.posexplode(_spread(F.ceil(F.size("tokens") / _WINDOW).cast("int"), F.col("most"))).alias("part", "i"))
    body = windows.select("doc_id", F.col("part").cast("long").alias("part"), F.array_join(F.slice("tokens", F.col("i") * _WINDOW + 1, _WINDOW), "").alias("body"))
    return body.select("doc_id", "part", F.substring(F.sha2(F.concat_ws("|", "doc_id", "part", "body"), 256), 1, 32).alias("chunk_id"), "body")


_WHOLE = "concat_ws(chr(10), content, 'Symbols: ' || nullif(symbols, ''), 'Schema: ' || nullif(schema_text, ''))"


@reg(
    "semantic_text",
    f"""SELECT file_id, generation, CASE WHEN strlen(text) <= 65536 THEN text ELSE left(text, CAST(list_max(list_filter(range(16384, 65537), lambda n: strlen(left(text, n)) <= 65536)) AS BIGINT)) END AS text
FROM (SELECT file_id, generation, {_WHOLE} AS text FROM (SELECT DISTINCT * FROM search_docs))""",
)
def semantic_text(t: Tables) -> DataFrame:
    whole = F.concat_ws("\n", "content", F.concat(F.lit("Symbols: "), F.nullif("symbols", F.lit(""))), F.concat(F.lit("Schema: "), F.nullif("schema_text", F.lit(""))))
    return t.search_docs.distinct().select("file_id", "generation", X.cut_bytes(whole, 65536).alias("text"))


@reg("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))), 6) AS s FROM embeddings")
def l2_normalize(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(F.aggregate(X.unit_vector(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@reg("json_key_paths")
def json_paths(t: Tables) -> DataFrame:
    return json_key_paths(current_content(t.files, t.search_docs).where("extension = 'json'").select("file_id", "content"))


@reg(
    "excerpt_lines",
    rf"""SELECT file_id, array_to_string(list_transform(range(1, least(len(l), 8) + 1), lambda i: i || ': ' || l[i] || chr(10)), '') AS excerpt, len(l) > 8 AS truncated
FROM (SELECT file_id, string_split_regex(content, '\r?\n') AS l FROM {CURRENT})""",
)
def excerpt_lines(t: Tables) -> DataFrame:
    now = current_content(t.files, t.search_docs)
    return now.select("file_id", F.array_join(X.numbered_lines(F.col("content"), 1, 8), "").alias("excerpt"), (F.size(F.split("content", "\r?\n")) > 8).alias("truncated"))


@reg(
    "centered_excerpt",
    f"""SELECT s.file_id, s.name, substring(c.content, CAST(floor(greatest(least(greatest(instr(c.content, s.name), 1) - 60.0, length(c.content) - 119), 1)) AS BIGINT), 120) AS excerpt
FROM (SELECT DISTINCT file_id, name FROM symbols) s JOIN {CURRENT} c ON c.file_id = s.file_id""",
)
def centered_excerpt(t: Tables) -> DataFrame:
    now = current_content(t.files, t.search_docs).select("file_id", "content")
    return t.symbols.select("file_id", "name").distinct().join(now, "file_id").select("file_id", "name", X.centered_excerpt(F.col("content"), F.col("name"), 120).alias("excerpt"))


@reg(
    "symbol_preview",
    rf"""SELECT s.file_id, s.name, s.line_start, left(array_to_string(string_split_regex(c.content, '\r?\n')[greatest(s.line_start - 2, 1) : s.line_end + 8], chr(10)), 1000) AS preview
FROM (SELECT DISTINCT file_id, name, line_start, line_end FROM symbols WHERE line_start >= 1 AND line_end >= line_start) s JOIN {CURRENT} c ON c.file_id = s.file_id""",
)
def symbol_preview(t: Tables) -> DataFrame:
    now = current_content(t.files, t.search_docs).select("file_id", F.split("content", "\r?\n").alias("lines"))
    s = t.symbols.where("line_start >= 1 AND line_end >= line_start").select("file_id", "name", "line_start", "line_end").distinct().join(now, "file_id")
    first = F.greatest(F.col("line_start") - 2, F.lit(1))
    return s.select("file_id", "name", "line_start", F.substring(F.array_join(F.slice("lines", first, F.col("line_end") + 9 - first), "\n"), 1, 1000).alias("preview"))


@reg("fingerprint", "SELECT DISTINCT id, sha256(concat_ws('|', absolute_path, size_bytes, mtime_ns, coalesce(content_hash, '-'))) AS mark FROM files")
def fingerprint(t: Tables) -> DataFrame:
    return t.files.select("id", F.sha2(F.concat_ws("|", "absolute_path", "size_bytes", "mtime_ns", F.coalesce("content_hash", F.lit("-"))), 256).alias("mark")).distinct()


MEMORY_LAYER = (
    X.memory_layer,
    """CASE WHEN name = 'user_profile.md' THEN 'user_profile' WHEN name IN ('project_memory.md', 'MEMORY.md', 'memory_summary.md') THEN 'project_summary' WHEN name = 'topics.md' THEN 'topic_summary'
 WHEN starts_with(name, 'session_memory_') OR contains(path, '/rollout_summaries/') THEN 'session_summary' WHEN name LIKE '%.jsonl' THEN 'raw_history' ELSE 'memory_note' END""",
)


@reg("memory_layer", f"SELECT doc_id, {MEMORY_LAYER[1]} AS layer FROM (SELECT doc_id, path, regexp_extract(path, '[^/]*$') AS name FROM documents WHERE kind = 'agent_memory' AND path IS NOT NULL)")
def memory_layer(t: Tables) -> DataFrame:
    return t.documents.where("kind = 'agent_memory' AND path IS NOT NULL").select("doc_id", X.memory_layer(F.col("path")).alias("layer"))


@reg(
    "memory_session_id",
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(path, '/session(?:_memory_|-)([^/]*)\.[^./]*$', 1), ''), nullif(regexp_extract(text, '(?m)^thread_id: ([^\r\n]*)', 1), ''), nullif(regexp_extract(text, '(?m)^\[session_id: (.*?) \| ', 1), ''),
 nullif(regexp_extract(text, '"session_meta", "payload": \{"id": "([^"]*)"', 1), '')) AS session_id FROM documents WHERE kind = 'agent_memory' AND text IS NOT NULL""",
)
def memory_session_id(t: Tables) -> DataFrame:
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    found = F.coalesce(
        pick("path", r"/session(?:_memory_|-)([^/]*)\.[^./]*$"), pick("text", r"(?m)^thread_id: ([^\r\n]*)"), pick("text", r"(?m)^\[session_id: (.*?) \| "), pick("text", r'"session_meta", "payload": \{"id": "([^"]*)"')
    )
    return t.documents.where("kind = 'agent_memory' AND text IS NOT NULL").select("doc_id", found.alias("session_id"))


@reg(
    "memory_normalize",
    r"""SELECT doc_id, string_agg(key || ': ' || value, chr(10) ORDER BY n, key) AS body FROM (
 SELECT doc_id, n, k.key, json_extract_string(CASE WHEN json_valid(line) THEN line END, '$.' || k.key) AS value FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE kind = 'agent_memory' AND ends_with(path, '.jsonl') AND text IS NOT NULL),
 (VALUES ('type'), ('timestamp'), ('summary'), ('title')) AS k(key)) WHERE value IS NOT NULL GROUP BY doc_id""",
)
def memory_normalize(t: Tables) -> DataFrame:
    lines = t.documents.where("kind = 'agent_memory' AND path LIKE '%.jsonl' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.get_json_object("line", f"$.{k}").alias("value")) for k in ("summary", "timestamp", "title", "type")))
    kept = lines.select("doc_id", "n", F.explode(pairs).alias("p")).where("p.value IS NOT NULL")
    said = F.array_sort(F.collect_list(F.struct("n", F.col("p.key").alias("key"), F.concat("p.key", F.lit(": "), "p.value").alias("said"))))
    return kept.groupBy("doc_id").agg(said.alias("all")).select("doc_id", F.array_join("all.said", "\n").alias("body"))


reg.text(
    "fn_string",
    """SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 4) AS s, replace(p_name, 'a', '_') AS r, split_part(p_brand, '#', 2) AS b, lpad(p_brand, 12, '.') AS l, reverse(p_type) AS v,
       position('e' IN p_name) AS at, length(p_name) AS n, starts_with(p_type, 'S') AS st, regexp_replace(p_name, '[aeiou]', '') AS rr, levenshtein(p_name, p_type) AS d FROM {part}""".replace("starts_with(p_type, 'S')", "startswith(p_type, 'S')"),
    """SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 4) AS s, replace(p_name, 'a', '_') AS r, split_part(p_brand, '#', 2) AS b, lpad(p_brand, 12, '.') AS l, reverse(p_type) AS v,
       position('e' IN p_name) AS at, length(p_name) AS n, starts_with(p_type, 'S') AS st, regexp_replace(p_name, '[aeiou]', '', 'g') AS rr, levenshtein(p_name, p_type) AS d FROM part""",
)
reg.text(
    "fn_date",
    """SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q,
       CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(o_orderdate + INTERVAL '3' DAY AS DATE) AS later, date_format(o_orderdate, 'yyyy-MM-dd') AS f,
       CAST(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS e FROM {orders}""",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days, CAST(o_orderdate + INTERVAL 3 DAY AS DATE) AS later, strftime(o_orderdate, '%Y-%m-%d') AS f,
       CAST(epoch(o_orderdate) AS BIGINT) AS e FROM orders""",
)
reg.text(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, round(abs(l_tax - l_discount), 6) AS a, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, CAST(floor(l_quantity / 7) AS BIGINT) AS f, round(power(l_quantity, 1.5), 4) AS p,
       round(ln(l_extendedprice), 6) AS ln, round(log10(l_extendedprice), 6) AS lg, round(sqrt(l_extendedprice), 6) AS sq, greatest(l_tax, l_discount) AS g, l_orderkey % 7 AS md FROM {lineitem}""",
)
reg.text("fn_cond", "SELECT doc_id, coalesce(lang, 'none') AS lang, nullif(kind, 'text') AS kind, ifnull(path, '-') AS path, try_cast(substr(source, 1, 1) AS INT) AS digit FROM {documents}")
reg.text(
    "fn_list",
    """SELECT vec_id, size(embedding) AS n, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE)), 5) AS total,
       array_contains(slice(array(1, 2, 3, label), 2, 3), 3) AS has, round(CAST(array_max(embedding) AS DOUBLE), 6) AS top FROM {embeddings}""",
    """SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total,
       list_contains([1, 2, 3, label][2:4], 3) AS has, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top FROM embeddings""",
)
reg.text(
    "fn_struct_map",
    """SELECT c_custkey, s.name AS name, m['seg'] AS seg, CAST(size(map_keys(m)) AS BIGINT) AS keys FROM (SELECT c_custkey, named_struct('name', c_name, 'bal', c_acctbal) AS s, map('seg', c_mktsegment, 'name', c_name) AS m FROM {customer}) AS t""",
    """SELECT c_custkey, s.name AS name, m['seg'] AS seg, len(map_keys(m)) AS keys FROM (SELECT c_custkey, {'name': c_name, 'bal': c_acctbal} AS s, MAP {'seg': c_mktsegment, 'name': c_name} AS m FROM customer)""",
)
reg.text(
    "fn_json",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, array_join(array_sort(json_object_keys(props)), ',') AS keys FROM {events}",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
)
reg.text("fn_hash", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM {documents}", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
reg.text("fn_bool_bit", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'P') AS some_p, bit_xor(o_orderkey) AS bx, bit_and(o_custkey) AS ba FROM {orders} GROUP BY o_orderpriority")


@reg(
    "fn_vector",
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS inner_product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def fn_vector(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", "embedding")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = a.join(b, "vec_id")
    return both.select("vec_id", F.round(X.dot(X.unit_vector(F.col("embedding")), X.unit_vector(F.col("other"))), 6).alias("cosine"), F.round(X.dot(F.col("embedding"), F.col("other")), 5).alias("inner_product"))


QUERIES, SQL = reg.queries, reg.sql
