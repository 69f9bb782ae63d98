"""The most similar vectors of every vector by a hierarchical k-means tree.

The upper cells of the tree are fitted on a bounded sample on the driver, the leaves of each
cell in Spark on a share of all vectors, and every vector is indexed in one leaf. A query goes
down the tree best bin first: a priority queue holds cells and leaves by the similarity of
their centres. Two numbers decide how far it goes: a query takes the leaves whose centre is at
most a margin less similar than the best, nearest first, up to a number of visits. A pair
is found where either of the two visits the leaf that the other is in. Margin and visits are
widened until a set of sample queries, compared with brute force over all rows, reaches the
recall asked for; a second set, with which nothing was chosen, measures it.
"""

from __future__ import annotations

import heapq
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

LOG = logging.getLogger(__name__)

#: The recall that the search is calibrated to.
RECALL = 0.99
#: Vectors of a leaf on average.
LEAF_ROWS = 2_048
#: Sampled vectors per leaf that its cell is fitted on.
LEAF_SAMPLE = 64
#: Vectors the upper cells are fitted on, at most (a bounded sample, chosen by hash).
TOP_SAMPLE = 8_192
#: Centres in the whole tree, at most: it is sent to every executor (96 floats of 32 bits each, 58 MB).
MAX_LEAVES = 150_000
#: Sample queries for which brute force is run, to calibrate the search and to measure it.
SAMPLE_QUERIES = 2_048
#: Cells a query opens at least, before its queue is followed.
OPEN_CELLS = 4
#: Leaves visited at most, to begin with: doubled until the recall asked for is reached, up to all leaves.
FIRST_VISITS = 64
#: Vectors in 1,000,003 shares by hash, by which samples are taken.
SHARES = 1_000_003


def unit_rows(buffers: list[bytes]) -> np.ndarray:
    """Vectors of 32-bit floats as rows of unit length, in 64 bits."""
    x = np.frombuffer(b"".join(buffers), dtype=np.float32).reshape(len(buffers), -1).astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means; no more than there are rows."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(k))
        full = np.flatnonzero(np.diff(np.append(starts, len(x))) > 0)
        sums = np.add.reduceat(x[order], starts[full], axis=0)
        size = np.linalg.norm(sums, axis=1)
        good = size > 1e-12
        centres[full[good]] = sums[good] / size[good, None]
    return centres


@dataclass
class Tree:
    """Centres of the upper cells, and per cell the centres and the numbers of its leaves."""

    cells: np.ndarray
    leaves: list[np.ndarray]
    first: list[int]

    def visits(self, x: np.ndarray, margin: float, most: int = FIRST_VISITS) -> list[list[tuple[int, float]]]:
        """Per row the leaves (number, the least margin that reaches it) that a best-bin-first search visits within ``margin``."""
        out = []
        x = x.astype(np.float32)
        for sims, q in zip(x @ self.cells.T, x, strict=True):
            cells = np.argsort(-sims, kind="stable").tolist()
            queue: list[tuple[float, int]] = []  # a cell c stands as -1 - c

            def open_cell(c: int, q: np.ndarray = q, queue: list = queue) -> None:
                first = self.first[c]
                queue.extend((-s, first + i) for i, s in enumerate((self.leaves[c] @ q).tolist()))

            for c in cells[:OPEN_CELLS]:
                open_cell(c)
            queue += [(-float(sims[c]), -1 - c) for c in cells[OPEN_CELLS:]]
            heapq.heapify(queue)
            seen: list[tuple[int, float]] = []
            best, need = 0.0, 0.0
            while queue and len(seen) < most:
                away, at = heapq.heappop(queue)
                if seen:
                    need = max(need, away - best)  # a cell on the way must be within the margin too
                    if need > margin:
                        break
                if at < 0:
                    open_cell(-1 - at)
                    heapq.heapify(queue)
                    continue
                best = best if seen else away
                seen.append((at, need))
            out.append(seen)
        return out


def _bytes(size: str) -> int:
    """A size as Spark's settings write it, in bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", size.lower()).groups()
    return max(1, int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit])


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(id, k1, k2, vec): rows whose vector has ``dims`` finite numbers, not all zero; 128 bits stand for a vector."""
    v = F.col(vector)
    fit = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).alias("id"), v.cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False))).select("id", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(31), "vec").alias("k2"), "vec")


def _buffers(column: pa.Array) -> list[bytes]:
    """The raw floats of each list of an Arrow column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    n = len(column)
    if n == 0:
        return []
    raw, width = flat.tobytes(), 4 * (len(flat) // n)
    return [raw[i * width : (i + 1) * width] for i in range(n)]


def _share(usable: DataFrame, share: float, seed: int) -> DataFrame:
    """About this share of the vectors, by hash; equal vectors are one."""
    number = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.lit(SHARES))
    return usable.where(number <= int(share * SHARES)).select("k1", "k2", "vec").dropDuplicates(["k1", "k2"])


def fit_tree(usable: DataFrame, total: int, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree over ``total`` vectors.

    Upper cells come from a bounded sample on the driver, the leaves of each cell from a share of
    all vectors in Spark; only centres (at most MAX_LEAVES) come back to the driver.
    """
    leaves = max(1, min(MAX_LEAVES, total // leaf_rows))
    sample = written(_share(usable, min(1.0, leaves * LEAF_SAMPLE / max(1, total)), 3), "vector-sample")
    known = sample.count()
    # a share by hash: no task sends more than its part of the bound
    rows = sample.where(F.pmod(F.xxhash64(F.lit(11), "k1", "k2"), F.lit(SHARES)) <= int(min(1.0, TOP_SAMPLE / max(1, known)) * SHARES)).select("k1", "k2", "vec").toPandas().sort_values(["k1", "k2"])
    if rows.empty:
        rows = sample.limit(1).toPandas()
    if rows.empty:
        return Tree(np.zeros((1, 1), np.float32), [np.zeros((1, 1), np.float32)], [0])
    cells = kmeans(unit_rows([np.asarray(v, dtype=np.float32).tobytes() for v in rows["vec"]]), max(1, round(leaves**0.5)))
    shared = usable.sparkSession.sparkContext.broadcast(cells)
    per_row = leaves / max(1, known)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _buffers(batch.column(0))
            if raw:
                near = np.argmax(unit_rows(raw) @ shared.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(raw, pa.binary())], names=["cell", "raw"])

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        centres = kmeans(unit_rows(rows["raw"].tolist()), max(1, round(len(rows) * per_row)))
        return pd.DataFrame({"cell": [int(rows["cell"].iloc[0])] * len(centres), "centre": [c.astype(np.float32).tobytes() for c in centres]})

    got = sample.select("vec").mapInArrow(place, "cell int, raw binary").groupBy("cell").applyInPandas(split, "cell int, centre binary").toPandas()
    parts = [unit_rows(list(got.loc[got["cell"] == c, "centre"])) if (got["cell"] == c).any() else cells[c : c + 1] for c in range(len(cells))]
    return Tree(cells.astype(np.float32), [p.astype(np.float32) for p in parts], [0, *np.cumsum([len(p) for p in parts]).tolist()[:-1]])


def _best(cos: np.ndarray, ids: list[list[str]], k: int, floor: float) -> list[list[tuple[float, str]]]:
    """Per row of ``cos`` the k best (cosine to ten decimals, id) of the columns' ids, ties to the smaller id."""
    rounded = np.round(cos, 10)
    out = []
    for row in rounded:
        at = np.flatnonzero(row >= floor)
        if len(at) > k:
            at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
        found = sorted((-float(row[c]), i) for c in at for i in ids[c])[:k]
        out.append([(-s, i) for s, i in found])
    return out


@dataclass
class Reach:
    """How far a query goes down the tree, and the recall of sample queries with that.

    ``calibrated`` is the recall of the queries that margin and visits were chosen with, ``held_out`` that of others.
    """

    margin: float
    visits: int
    leaves: int
    mean_visits: float
    calibrated: float
    held_out: float


def true_neighbours(usable: DataFrame, queries: np.ndarray, k: int, floor: float) -> pd.DataFrame:
    """(q, id, cos, raw): the k + 1 best of each query by brute force over all rows, with their vectors.

    A task keeps the best of its rows, and Spark the best of these; what reaches the driver is
    bounded by the number of queries, whatever the number of partitions.
    """
    shared = usable.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the k + 1 best of this partition per query, in blocks of rows
        best: list[dict[str, tuple[float, bytes]]] = [{} for _ in range(len(shared.value))]

        def cut(found: dict[str, tuple[float, bytes]]) -> list[tuple[str, tuple[float, bytes]]]:
            return sorted(found.items(), key=lambda e: (-e[1][0], e[0]))[: k + 1]

        for batch in batches:
            raw = _buffers(batch.column(1))
            if not raw:
                continue
            ids = batch.column(0).to_pylist()
            cos = np.round(shared.value @ unit_rows(raw).T, 10)
            q_at, c_at = np.nonzero(cos >= floor)
            for q, c in zip(q_at.tolist(), c_at.tolist(), strict=True):
                best[q][ids[c]] = (float(cos[q, c]), raw[c])
                if len(best[q]) > 8 * k:
                    best[q] = dict(cut(best[q]))
        rows = [(q, i, s, raw) for q, found in enumerate(best) for i, (s, raw) in cut(found)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.binary())], names=["q", "id", "cos", "raw"])

    found = usable.select("id", "vec").mapInArrow(scan, "q int, id string, cos double, raw binary").dropDuplicates(["q", "id", "cos"])
    first = Window.partitionBy("q").orderBy(F.col("cos").desc(), "id")
    return found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= k + 1).drop("k").toPandas()


def calibrated(usable: DataFrame, total: int, tree: Tree, k: int, floor: float, recall: float) -> Reach:
    """The margin and visits with which sample queries reach ``recall`` against brute force over all rows in the fewest visits.

    The queries are chosen by hash among all vectors; three quarters calibrate, the others measure. While too many neighbours are in leaves not visited, twice as many visits are
    allowed; with all leaves visited none is left out, so the recall is reached in any case.
    """
    leaves = sum(len(part) for part in tree.leaves)
    some = _share(usable, min(1.0, 4 * SAMPLE_QUERIES / max(1, total)), 5)
    apart = some.orderBy(F.xxhash64(F.lit(7), "k1", "k2"), "k1").limit(SAMPLE_QUERIES).select("vec").toPandas()
    if apart.empty:
        return Reach(2.1, leaves, leaves, float(leaves), 1.0, 1.0)
    queries = unit_rows([np.asarray(v, dtype=np.float32).tobytes() for v in apart["vec"]])
    near = true_neighbours(usable, queries, k, floor)
    # a query's own vector is in its first leaf anyway: what counts is the others
    near = near[near["cos"] < 1.0].sort_values(["q", "id"])
    if near.empty:
        return Reach(0.0, 1, leaves, 1.0, 1.0, 1.0)
    asker = near["q"].to_numpy()
    tuned = asker % 4 != 0
    if not tuned.any():
        tuned[:] = True
    others = unit_rows(near["raw"].tolist())
    most = min(FIRST_VISITS, leaves)
    while True:
        # the difference of two cosines is at most 2: nothing but the number of visits ends the search
        orders, back = tree.visits(queries, 2.1, most), tree.visits(others, 2.1, most)
        # a pair is found where either visits the leaf that the other is in
        ways = []
        for way in ([(orders[q], b[0][0]) for q, b in zip(asker, back, strict=True)], [(b, orders[q][0][0]) for q, b in zip(asker, back, strict=True)]):
            ways.append([next(((n, d) for n, (leaf, d) in enumerate(order) if leaf == home), (leaves, np.inf)) for order, home in way])
        place, need = (np.array([[x[i] for x in way] for way in ways], dtype=float) for i in (0, 1))
        options = []
        for visits in sorted({most, *(v for v in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, *(64 << i for i in range(12))) if v < most)}):
            asked = np.sort(np.where(place < visits, need, np.inf).min(axis=0)[tuned])
            margin = float(asked[max(0, min(len(asked), int(np.ceil(recall * len(asked)))) - 1)])
            if np.isfinite(margin):
                options.append((float(np.mean([sum(d <= margin for _, d in order[:visits]) for order in orders])), visits, margin))
        # where fewer visits than were tried do, no more need be looked at
        if options and (min(options)[1] < most or most >= leaves):
            break
        most = min(2 * most, leaves)
    # the fewest visits on average with which the recall is reached
    mean, visits, margin = min(options)
    reached = ((place < visits) & (need <= margin)).any(axis=0)
    reach = Reach(margin, visits, leaves, mean, float(np.mean(reached[tuned])), float(np.mean(reached[~tuned])) if not tuned.all() else 1.0)
    (LOG.info if reach.held_out >= 0.9 else LOG.warning)("vector search: %s", reach)
    return reach


def vector_index(df: DataFrame, key: str, vector: str, dims: int, k: int, floor: float, recall: float, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, Tree, Reach, int]:
    """The usable rows (id, k1, k2, vec), the tree over them, how far a query goes, and the number of rows."""
    usable = usable_vectors(df, key, vector, dims).select(F.col("id").cast("string").alias("id"), "k1", "k2", "vec")
    total = usable.count()
    tree = fit_tree(usable, total, leaf_rows)
    return usable, tree, calibrated(usable, total, tree, k, floor, recall), total


def search_quality(df: DataFrame, key: str = "chunk_id", vector: str = "vector", dims: int = 96, k: int = 5, floor: float = 0.80, recall: float = RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row: rows, leaves, the calibrated margin and visits, and the recall of the calibration and of other queries."""
    _, _, reach, total = vector_index(df, key, vector, dims, k, floor, recall, leaf_rows)
    row = (total, reach.leaves, reach.margin, reach.visits, reach.mean_visits, recall, reach.calibrated, reach.held_out)
    return df.sparkSession.createDataFrame([row], "rows long, leaves long, margin double, visits long, mean_visits double, asked double, calibrated double, held_out double")


def similar_vectors(df: DataFrame, key: str = "chunk_id", vector: str = "vector", dims: int = 96, k: int = 5, floor: float = 0.80, recall: float = RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(id, other, cosine): for every usable vector up to ``k`` other ids with the highest cosine of at least ``floor``.

    Cosines are compared to ten decimals, ties go to the smaller id.

    Equal vectors are combined before anything is shuffled: a partition sends one row for each
    distinct vector with its k + 1 smallest ids (no other id of that vector can be among anyone's
    k best), and the answer of a vector is joined back to all ids that have it. So a vector that
    a third of all rows share costs one query; in that last join its ids are one key, which
    adaptive execution splits over tasks as each answer is a single row.

    Vectors go to their leaves in tasks of about a quarter of the session's advisory partition size
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``; leaves are whole, so some tasks get more),
    whatever the number of rows.

    Defined cases: vectors that are null, of another length, not finite or all zero have no rows
    and are nobody's neighbour; repeated rows count once; an id with several vectors is searched
    for each of them and gets the best of both; a null id is left out; no rows in, no rows out.
    """
    usable, tree, reach, total = vector_index(df, key, vector, dims, k, floor, recall, leaf_rows)
    margin, most = reach.margin, reach.visits
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    task_bytes = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    tasks = max(1, min(reach.leaves, -(-int(total * reach.mean_visits * (4 * dims + 64)) // max(1, _bytes(task_bytes) // 4))))
    keep = k + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[bytes, list[str]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            step = max(1, 4096 * FIRST_VISITS // max(FIRST_VISITS, most))  # a bound on the rows of a batch
            for s in range(0, len(keys), step):
                part = keys[s : s + step]
                order = shared.value.visits(unit_rows([held[p][0] for p in part]), margin, most)
                leaf, home, k1, k2, ids, raw = [], [], [], [], [], []
                for p, seen in zip(part, order, strict=True):
                    for n, (at, _) in enumerate(seen):
                        leaf.append(at)
                        home.append(n == 0)
                        k1.append(p[0])
                        k2.append(p[1])
                        ids.append(held[p][1])
                        raw.append(held[p][0])
                columns = [pa.array(leaf, pa.int32()), pa.array(home), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "home", "k1", "k2", "ids", "raw"])
            held.clear()

        for batch in batches:
            for i, a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _buffers(batch.column(3)), strict=True):
                known = held.get((a, b))
                if known is None:
                    held[(a, b)] = (raw, [i])
                elif i not in known[1]:
                    known[1].append(i)
                    if len(known[1]) > keep:
                        known[1].remove(max(known[1]))
            if len(held) > 100_000:  # a bound on memory; what is sent twice is combined in the leaf
                yield from out()
        yield from out()

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        # those at home in this leaf first, then those that visit it; what was sent twice is one again
        vectors: dict[tuple[int, int], bytes] = {}
        ids: dict[tuple[int, int], set[str]] = {}
        rows = rows.sort_values("home", ascending=False, kind="stable")
        n_home = len(rows.loc[rows["home"], ["k1", "k2"]].drop_duplicates())
        for a, b, own, raw in zip(rows["k1"], rows["k2"], rows["ids"], rows["raw"], strict=True):
            vectors[(a, b)] = raw
            ids.setdefault((a, b), set()).update(own)
        keys = list(vectors)
        named = [sorted(ids[p])[:keep] for p in keys]
        units = unit_rows([vectors[p] for p in keys])
        found: list[list[dict]] = [[] for _ in keys]

        def take(asked: range, low: int, high: int) -> None:
            for s in range(asked.start, asked.stop, 512):
                e = min(s + 512, asked.stop)
                for n, near in enumerate(_best(units[s:e] @ units[low:high].T, named[low:high], keep, floor)):
                    found[s + n] += [{"away": -c, "id": i} for c, i in near]

        if n_home:
            take(range(len(keys)), 0, n_home)  # all, among those at home
            if n_home < len(keys):
                take(range(n_home), n_home, len(keys))  # those at home, among the visitors
        some = [n for n, f in enumerate(found) if f]
        return pd.DataFrame({"k1": [keys[n][0] for n in some], "k2": [keys[n][1] for n in some], "near": [found[n] for n in some]})

    routed = usable.select("id", "k1", "k2", "vec").mapInArrow(route, "leaf int, home boolean, k1 long, k2 long, ids array<string>, raw binary")
    parts = routed.repartition(tasks, "leaf").groupBy("leaf").applyInPandas(search, "k1 long, k2 long, near array<struct<away: double, id: string>>")
    answers = parts.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, keep).alias("near"))
    members = usable.select("id", "k1", "k2").distinct()
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    ranked = members.join(answers, ["k1", "k2"]).select("id", F.explode(others).alias("n")).select("id", F.col("n.id").alias("other"), (-F.col("n.away")).alias("cosine"))
    return ranked


def similar_pairs(df: DataFrame, **options) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: unordered pairs of which at least one is among the other's k best."""
    near = similar_vectors(df, **options)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()
