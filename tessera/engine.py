"""The calls of the engine over one folder of tables: search, inspect, query, changes, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import ranking as K
from .operators import retrieval as R
from .operators.catalog import classify_changes
from .operators.joins import ancestors, longest_prefix_owner
from .plans.registry import Tables
from .plans.retrieval_queries import DIMS, current_docs
from .session import written
from .sources.files import Bounded, bounded_sql


class Workspace:
    """Everything is lazy but :meth:`query`; a search takes one question or a table of questions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.tables = spark, Tables(spark, folder)

    def docs(self, roots: list[str] | None = None, kinds: list[str] | None = None, path_prefix: str | None = None) -> DataFrame:
        """The current texts in scope. Scopes hold on component boundaries and apply before any ranking."""
        docs = current_docs(self.tables)
        if roots:
            docs = docs.where(F.arrays_overlap(ancestors(F.col("path")), F.array(*map(F.lit, roots))))
        if kinds:
            docs = docs.where(F.col("kind").isin(kinds))
        return docs.where(F.col("path").startswith(path_prefix)) if path_prefix else docs

    def _asked(self, queries: str | DataFrame) -> DataFrame:
        return self.spark.createDataFrame([(0, queries)], "query_id long, query string") if isinstance(queries, str) else queries.select("query_id", "query")

    def search(
        self,
        queries: str | DataFrame,
        limit: int = 10,
        roots: list[str] | None = None,
        kinds: list[str] | None = None,
        path_prefix: str | None = None,
        vectors: DataFrame | None = None,
        preview_chars: int = 160,
        depth: int = 100,
        context_path: str | None = None,
    ) -> DataFrame:
        """(query_id, rank, file_id, path, score, lanes, copies, preview).

        ``queries`` is a text or a table of (query_id, query); ``vectors`` may add (query_id, vector). With
        ``context_path`` the source files that a query names in the asker's own root go before others.
        """
        if not 1 <= limit <= 50:
            raise ValueError("limit must be 1 to 50")
        asked = self._asked(queries)
        docs = written(self.docs(roots, kinds, path_prefix), "docs-in-scope")
        texts = {"path": F.concat_ws(" ", "path", "name", "experiment"), "content": F.col("content"), "symbol": F.col("symbols"), "schema": F.col("schema_text")}
        script = (F.endswith("name", F.lit(".sql")), F.concat_ws(" ", "path", "name", "content", "schema_text"))
        wanted = asked.select("query_id", "query", F.explode(F.array(*map(F.lit, texts))).alias("lane"))
        wanted = wanted.unionByName(asked.where(X.is_sql_query(F.col("query"))).select("query_id", X.expand_sql_query(F.col("query")).alias("query"), F.lit("sql").alias("lane")))
        lanes = [R.lane_ranks(R.posting_index(docs, {**texts, "sql": script}), wanted, depth)]
        if vectors is not None:
            inside = self.tables.chunks.join(docs.select("file_id"), "file_id", "left_semi")
            lanes.append(R.vector_lane(inside, vectors, depth, DIMS).withColumn("lane", F.lit("semantic")))
        hits = R.boosted(R.fuse(*lanes), asked, docs, self.tables.symbols, R.exact_path_lane(docs, asked))
        if context_path is not None:
            contexts = asked.select("query_id", F.lit(context_path).alias("context"))
            hits = K.own_checkout_boost(hits.join(docs.select("file_id", "kind"), "file_id"), contexts, self.tables.roots.select(F.col("path").alias("root"))).drop("kind", "in_scope")
        top = R.diversify(R.collapse_copies(hits), min(limit, 20))
        return top.join(docs.select("file_id", F.substring("content", 1, preview_chars).alias("preview")), "file_id").select("query_id", "rank", "file_id", "path", "score", "lanes", "copies", "preview")

    def search_notes(self, queries: str | DataFrame, limit: int = 10, context_path: str | None = None, preview_chars: int = 160, depth: int = 100) -> DataFrame:
        """(query_id, rank, doc_id, path, kind, score, preview) over the agents' skills and notes.

        A skill counts more where its folder holds the context; with a context, skills of other
        folders and notes of other roots are left out. What lifts a note is its root, layer and what the query names.
        """
        asked = self._asked(queries)
        notes = self.tables.documents.where(F.col("kind").isin("agent_skill", "agent_memory") & F.col("text").isNotNull() & F.col("path").isNotNull())
        owned = longest_prefix_owner(notes.select("path").distinct(), self.tables.roots.select(F.col("path").alias("root")))
        docs = notes.select(F.col("doc_id").alias("file_id"), "path", "kind", "text").join(owned, "path", "left").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
        here = F.lit(context_path)
        holds = lambda c: (here == F.col(c)) | F.startswith(here, F.concat(c, F.lit("/")))
        if context_path is not None:
            docs = docs.where(F.when(F.col("kind") == "agent_skill", holds("folder")).otherwise(F.col("root").isNull() | holds("root")))
        docs = written(docs, "notes-in-scope")
        text = F.concat_ws(" ", X.base_name(F.col("path")), "text")
        index = R.posting_index(docs, {"agent": (F.col("kind") == "agent_skill", text), "memory": (F.col("kind") == "agent_memory", text)})
        ranked = R.lane_ranks(index, asked.select("query_id", "query", F.explode(F.array(F.lit("agent"), F.lit("memory"))).alias("lane")), depth)
        hits = R.fuse(ranked).join(docs, "file_id").join(asked, "query_id")
        note = K.memory_boost(F.col("query"), X.base_name(F.col("path")), F.lit(None).cast("string"), F.lit(None).cast("string"), X.memory_layer(F.col("path")), F.col("root").isNotNull(), F.lit(0.0))
        skill = F.lit(R.INSTRUCTION) + R.INSTRUCTION_DEPTH * (F.size(F.split("folder", "/")) - 1) if context_path is not None else F.lit(0.0)
        scored = hits.withColumn("score", F.round(F.col("score") + F.when(F.col("kind") == "agent_memory", note).otherwise(skill), 6))
        return R.best(scored, min(limit, 20), "path").select("query_id", "rank", F.col("file_id").alias("doc_id"), "path", "kind", "score", F.substring("text", 1, preview_chars).alias("preview"))

    def missing(self, paths: list[str]) -> DataFrame:
        """(request_id, what, path, reason): why each of the paths would not be among the hits."""
        asked = self.spark.createDataFrame([(i, "anchor", p) for i, p in enumerate(paths)], "request_id long, what string, path string")
        live = self.tables.files.where("NOT deleted")
        present = self.tables.search_docs.select("path").union(live.select("absolute_path")).distinct()
        return K.diagnose(asked, self.tables.roots.select("path"), live.where("content_indexed").select(F.col("absolute_path").alias("path")), present)

    def inspect(self, path: str, start_line: int = 1, max_lines: int = 80, max_symbols: int = 24) -> DataFrame:
        """One row of a file: its record, its first symbols and a window of numbered lines."""
        from .functions.text import numbered_lines

        doc = current_docs(self.tables).where(F.col("path") == path)
        named = F.slice(F.array_sort(F.collect_set(F.struct("line_start", "line_end", "name", "kind"))), 1, max_symbols)
        symbols = self.tables.symbols.groupBy("file_id").agg(named.alias("outline"))
        excerpt = F.array_join(numbered_lines(F.col("content"), start_line, max_lines), "")
        return doc.join(symbols, "file_id", "left").select("file_id", "path", "kind", "generation", "content_hash", "outline", excerpt.alias("excerpt"))

    def query(self, sql: str, inputs: dict[str, str], roots: list[str], max_rows: int = 100, max_bytes: int = 1 << 20, timeout_ms: int = 30_000) -> Bounded:
        return bounded_sql(self.spark, sql, inputs, roots, max_rows, max_bytes, timeout_ms)

    def changes(self, listing: DataFrame) -> DataFrame:
        """The state of every path of the catalog and of a listing of (path, size, hash)."""
        known = self.tables.files.where("NOT deleted").select(F.col("absolute_path").alias("path"), F.col("size_bytes").alias("size"), F.col("content_hash").alias("hash")).distinct()
        return classify_changes(known, listing, ["path"])

    def status(self) -> DataFrame:
        """Files, deleted and failed files per root, with its last completed generation."""
        files = self.tables.files.select("id", "root_id", "deleted", "extraction_status").distinct()
        counts = files.groupBy("root_id").agg(F.count("*").alias("files"), F.count_if("deleted").alias("deleted"), F.count_if(F.col("extraction_status").contains("failed")).alias("failed"))
        return self.tables.roots.withColumnRenamed("id", "root_id").join(counts, "root_id", "left")
