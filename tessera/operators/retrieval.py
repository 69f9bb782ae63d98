"""Ranked retrieval of many queries at once: lanes, fusion, boosts, copies and diversity.

Every operator is a plan over (query_id, file_id, ...) rows; a query is a row, not a call.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written

# The constants of BM25 and of rank fusion, and the weights of the lanes.
K1, B = 1.2, 0.75
RRF_K = 60
WEIGHTS = {"path": 1.25, "content": 1.0, "symbol": 1.15, "schema": 1.1, "sql": 1.35, "semantic": 1.0, "exact_path": 0.0, "agent": 1.3, "memory": 1.15}
COVERAGE_WEIGHT, EXACT_PATH_BOOST, EXACT_SYMBOL_BOOST, DIRECTORY_PENALTY = 0.05, 2.0, 1.5, 0.00125
# What lifts an instruction whose folder holds the asker's, more the deeper it is.
INSTRUCTION, INSTRUCTION_DEPTH = 1.0, 0.001
#: A term that more than this share of a lane's documents have is scored last, for the files that can still win.
COMMON_SHARE = 0.2
#: Scores are compared to six decimals; bounds keep this much room for that.
ROOM = 1e-5
#: Query vectors that one task compares with its rows, and rows of a task.
QUERY_BLOCK, ROW_BLOCK = 2_048, 65_536


def posting_index(docs: DataFrame, lanes: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """(lane, file_id, len, tok, tf, first): how often each document has each word, for all lanes in one pass.

    A lane is the text it reads, or (condition, text). The words of a document are counted where
    its row is, by sorting them and measuring the runs, so nothing is shuffled; the table is
    written to the shared folder, a folder for each lane. One row of a document is its ``first``, which
    stands for it in counts of documents. Documents without a word have no row.
    """
    parts = [F.struct(F.lit(name).alias("lane"), F.when(lane[0], X.text_tokens(lane[1])).alias("tokens") if isinstance(lane, tuple) else X.text_tokens(lane).alias("tokens")) for name, lane in lanes.items()]
    cut = docs.select("file_id", F.explode(F.array(*parts)).alias("l")).select("file_id", "l.lane", F.sort_array("l.tokens").alias("tokens")).where(F.size("tokens") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1)))
    runs = cut.select("file_id", "lane", "tokens", starts.alias("starts"))
    counted = F.transform("starts", lambda at, n: F.struct(F.get("tokens", at).alias("tok"), (F.coalesce(F.get("starts", n + 1), F.size("tokens")) - at).alias("tf")))
    rows = runs.select("lane", "file_id", F.size("tokens").alias("len"), F.posexplode(counted).alias("n", "w")).select("lane", "file_id", "len", "w.tok", "w.tf", (F.col("n") == 0).alias("first"))
    return written(rows, "postings", "lane")


def lane_ranks(index: DataFrame, asked: DataFrame, depth: int, common_share: float = COMMON_SHARE) -> DataFrame:
    """(lane, query_id, file_id, score, rank): the ``depth`` best documents of each query and lane by BM25.

    ``asked`` has (lane, query_id, query); the words of a query are joined by OR, and all of them
    count. Words that few documents have are scored first. A word that more than ``common_share`` of
    the documents have can add no more than its weight times K1 + 1, so:

    * where the depth-th best score is above all that common words could add, no file without a rarer
      word can be among the best, and common words are looked up only for the files that can still
      reach that score, by file and word, never by the word alone;
    * other queries (few hits, or common words only) are scored over all their postings.

    Both ways give the exact scores. Defined cases: a null or empty query or text has no rows; ties go
    to the smaller file id; a lane without documents has no rows.
    """
    one = ["lane", "query_id"]
    terms = asked.select(*one, F.explode(F.array_distinct(X.text_tokens(F.col("query")))).alias("tok"))
    sizes = index.where("first").groupBy("lane").agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean"))
    found = index.join(terms.select("lane", "tok").distinct(), ["lane", "tok"], "left_semi").groupBy("lane", "tok").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = found.join(sizes, "lane").select("lane", "tok", "mean", idf.alias("idf"), (F.col("df") > common_share * F.col("n_docs")).alias("common"))
    terms = written(terms.join(weighed, ["lane", "tok"]), "query-terms")
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("len") / F.col("mean"))
    part = (F.col("idf") * tf * (K1 + 1) / (tf + norm)).alias("part")
    rare, common = terms.where("NOT common"), terms.where("common")
    most = common.groupBy(*one).agg((F.sum("idf") * (K1 + 1)).alias("most"))
    first = rare.join(index, ["lane", "tok"]).select(*one, "file_id", part).groupBy(*one, "file_id").agg(F.sum("part").alias("part"))
    order = Window.partitionBy(*one).orderBy(F.col("part").desc(), "file_id")
    bounded = first.join(most, one, "left").withColumn("most", F.coalesce("most", F.lit(0.0)))
    least = F.coalesce(F.nth_value("part", depth).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    bounded = bounded.withColumn("least", least).where(((F.col("most") == 0) | (F.col("least") > F.col("most") + ROOM)) & (F.col("part") + F.col("most") + ROOM >= F.col("least")))
    kept = written(bounded.select(*one, "file_id", "part"), "lane-candidates")
    later = kept.select(*one, "file_id").join(common, one).join(index, ["lane", "tok", "file_id"]).select(*one, "file_id", part)
    open_terms = terms.join(kept.select(*one).distinct(), one, "left_anti")
    whole = open_terms.join(index, ["lane", "tok"]).select(*one, "file_id", part)
    scored = kept.unionByName(later).unionByName(whole).groupBy(*one, "file_id").agg(F.round(F.sum("part"), 6).alias("score"))
    w = Window.partitionBy(*one).orderBy(F.col("score").desc(), "file_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def bm25_lane(docs: DataFrame, queries: DataFrame, text: Column, depth: int) -> DataFrame:
    """(query_id, file_id, score, rank): one lane over ``text`` for all queries."""
    return lane_ranks(posting_index(docs, {"text": text}), queries.select(F.lit("text").alias("lane"), "query_id", "query"), depth).drop("lane")


def best(scored: DataFrame, depth: int, tie: str = "file_id") -> DataFrame:
    """Ranks within each query by falling score, ties to the smaller ``tie``, down to ``depth``."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def exact_path_lane(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_id): files that a query names by path or by the end of a path."""
    anchors = queries.select("query_id", F.explode(X.filename_anchors(F.col("query"))).alias("anchor"))
    # every suffix of a path that begins at a component: an equi join instead of a search for ends
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    named = anchors.select("anchor").distinct()
    hits = docs.select("file_id", F.explode(F.array_union(ends, F.array("path"))).alias("anchor")).join(named, "anchor", "left_semi")
    return anchors.join(hits, "anchor").select("query_id", "file_id").distinct()


def vector_lane(chunks: DataFrame, queries: DataFrame, depth: int, dims: int, key: str = "file_id", vector: str = "vector", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, file_id, score, rank): files by the cosine of their best chunk with the query's vector.

    ``queries`` has (query_id, vector). Up to ``query_block`` of them go to the rows where they are,
    as one array (1.5 MB). More are spread: query blocks and row blocks meet in groups of bounded size,
    one for each pair of blocks. Either way a task keeps its ``depth`` best files per query
    before anything is shuffled, and no other rows pass through the driver.
    """
    usable = lambda df, v: df.where((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    rows = usable(chunks.select(F.col(key).cast("long").alias("file_id"), F.col(vector).cast("array<float>").alias("v")), "v")
    asked = usable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("v")), "v")
    few = asked.limit(query_block + 1).toPandas()
    if len(few) <= query_block:
        shared = chunks.sparkSession.sparkContext.broadcast((few["query_id"].to_numpy(), _units(few["v"], dims)))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = _Nearest(names, depth)
            for batch in batches:
                if batch.num_rows and len(names):
                    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                    best.take(q, batch.column(0).to_numpy(zero_copy_only=False), flat.reshape(batch.num_rows, -1).astype(np.float64))
            yield best.rows()

        found = rows.mapInArrow(near, "query_id long, file_id long, score double")
    else:
        q_blocks, r_blocks = -(-asked.count() // query_block), -(-rows.count() // row_block)
        block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.select("query_id", "v", block(q_blocks, "query_id").alias("q")).select("*", every(r_blocks).alias("r"))
        right = rows.select("file_id", "v", block(r_blocks, "v").alias("r")).select("*", every(q_blocks).alias("q"))

        def meet(asked_block: pd.DataFrame, row_block_: pd.DataFrame) -> pd.DataFrame:
            best = _Nearest(asked_block["query_id"].to_numpy(), depth)
            if len(asked_block):
                q = _units(asked_block["v"], dims)
                for at in range(0, len(row_block_), 8_192):
                    part = row_block_.iloc[at : at + 8_192]
                    best.take(q, part["file_id"].to_numpy(), np.array(part["v"].tolist(), dtype=np.float64))
            return best.rows().to_pandas()

        found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInPandas(meet, "query_id long, file_id long, score double")
    return best(found.groupBy("query_id", "file_id").agg(F.max("score").alias("score")), depth)


def _units(vectors, dims: int) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64).reshape(-1, dims)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class _Nearest:
    """The best files of each query among the rows seen so far."""

    def __init__(self, names: np.ndarray, depth: int):
        self.names, self.depth = names, depth
        self.held: list[dict[int, float]] = [{} for _ in names]

    def _cut(self, mine: dict[int, float]) -> list[tuple[int, float]]:
        return sorted(mine.items(), key=lambda e: (-e[1], e[0]))[: self.depth]

    def take(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        # rows are reduced to the best of each file first, then to the best files
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids = ids[first]
        cos = np.maximum.reduceat(np.round(q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6), first, axis=1)
        for i, row in enumerate(cos):
            top = range(len(row)) if len(row) <= self.depth else np.flatnonzero(row >= np.partition(row, len(row) - self.depth)[len(row) - self.depth])
            mine = self.held[i]
            for j in top:
                f = int(ids[j])
                if row[j] > mine.get(f, -2.0):
                    mine[f] = float(row[j])
            if len(mine) > 4 * self.depth:
                self.held[i] = dict(self._cut(mine))

    def rows(self) -> pa.RecordBatch:
        rows = [(int(n), f, s) for n, mine in zip(self.names, self.held, strict=True) for f, s in self._cut(mine)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "file_id", "score"])


def fuse(lanes: DataFrame, *more: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, file_id, score, lanes): the sum of weight / (60 + rank) over the lanes that found a file.

    Tables of (lane, query_id, file_id, rank) are united.
    """
    rows = reduce(DataFrame.unionByName, [df.select("lane", "query_id", "file_id", "rank") for df in (lanes, *more)])
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("lane"))
    whole = rows.withColumn("part", weight / (RRF_K + F.col("rank")))
    return whole.groupBy("query_id", "file_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), ",").alias("lanes"))


def symbol_hits(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_id, symbol, line): the first symbol of a file that a query names, whatever its case."""
    terms = queries.select("query_id", F.explode(X.query_symbol_terms(F.col("query"))).alias("term"))
    named = symbols.where(~F.col("kind").isin("call", "import")).select("file_id", F.col("name").alias("symbol"), F.lower("name").alias("term"), F.col("line_start").alias("line")).distinct()
    return terms.join(named, "term").groupBy("query_id", "file_id").agg(F.min(F.struct("line", "symbol")).alias("m")).select("query_id", "file_id", F.col("m.symbol").alias("symbol"), F.col("m.line").alias("line"))


def boosted(fused: DataFrame, queries: DataFrame, docs: DataFrame, symbols: DataFrame, exact: DataFrame) -> DataFrame:
    """Fused candidates with path coverage, exact paths and exact symbols; files only a symbol names join at 0."""
    named = symbol_hits(symbols, queries).select("query_id", "file_id", "symbol")
    marked = exact.select("query_id", "file_id", F.lit(True).alias("exact"))
    joined = (
        fused.join(named, ["query_id", "file_id"], "full")
        .join(marked, ["query_id", "file_id"], "full")
        .join(queries.select("query_id", "query"), "query_id")
        .join(docs.select("file_id", "path", "name", "content_hash"), "file_id")
    )
    score = (
        F.coalesce("score", F.lit(0.0))
        + COVERAGE_WEIGHT * X.token_coverage(F.col("query"), F.col("path"))
        + F.when(F.col("exact"), EXACT_PATH_BOOST).otherwise(0.0)
        + F.when(F.col("symbol").isNotNull(), EXACT_SYMBOL_BOOST).otherwise(0.0)
    )
    lanes = F.concat_ws(",", F.when(F.col("exact"), "exact_path"), F.when(F.col("symbol").isNotNull(), "exact_symbol"), F.col("lanes"))
    return joined.select("query_id", "file_id", "path", "name", "content_hash", F.round(score, 6).alias("score"), lanes.alias("lanes"))


def collapse_copies(hits: DataFrame) -> DataFrame:
    """Of hits of a query with one name and one content the best, with the number of its copies; without a hash none is a copy."""
    group = Window.partitionBy("query_id", "name", "content_hash")
    first = F.row_number().over(group.orderBy(F.col("score").desc(), "path"))
    kept = hits.withColumn("place", first).withColumn("copies", F.count("*").over(group))
    return kept.where((F.col("place") == 1) | F.col("content_hash").isNull()).withColumn("copies", F.when(F.col("content_hash").isNull(), F.lit(1)).otherwise(F.col("copies"))).drop("place")


def diversify(hits: DataFrame, depth: int, penalty: float = DIRECTORY_PENALTY) -> DataFrame:
    """Ranks after a penalty for every hit that is not the best of its directory.

    Choosing greedily comes to the same: within a directory the best hit always comes first.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    w = Window.partitionBy("query_id", folder).orderBy(F.col("score").desc(), "path")
    spread = hits.withColumn("score", F.round(F.col("score") - F.when(F.row_number().over(w) > 1, penalty).otherwise(0.0), 6))
    return best(spread, depth, "path")
