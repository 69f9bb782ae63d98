"""Changes between consecutive full snapshots of a keyed set of entries.

The snapshots are key-sorted and cut into content-defined chunks; chunks whose digest
also occurs in the neighbouring snapshot are discarded, and only the rows of the
remaining chunks are joined to classify changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A row whose key hash is divisible by this begins a chunk; the mean rows of a chunk.
CHUNK_ROWS = 8

#: Snapshots (not entries) up to which the table of neighbouring versions is broadcast.
BROADCAST_VERSIONS = 500_000

_CHUNK_SCHEMA = "owner string, version long, d1 long, d2 long, paths array<string>, marks array<string>"


def _changes_from_previous(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it (nulls are equal to each other)."""
    n = len(column)
    out = np.ones(n, dtype=bool)
    if n > 1:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] = codes[1:] != codes[:-1]
    return out


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop repeated keys and make the rows of a sorted partition into chunks, each one row with its digest.

    A chunk goes from one boundary row to the next and never over the end of a snapshot.
    The unfinished chunk at the end of a batch is carried into the next batch.
    """
    held: pa.Table | None = None

    def emit(table: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table | None]:
        table = table.combine_chunks()
        owner, version, path = (table.column(c).combine_chunks() for c in ("owner", "version", "path"))
        snapshot = _changes_from_previous(owner) | _changes_from_previous(version)
        fresh = snapshot | _changes_from_previous(path)
        if not fresh.all():
            table = table.filter(pa.array(fresh))
            snapshot = snapshot[fresh]
        starts = np.flatnonzero(snapshot | table.column("cut").to_numpy())
        if starts.size == 0 or starts[0] != 0:
            starts = np.concatenate(([0], starts))
        rest = None
        if not last:
            rest = table.slice(int(starts[-1]))
            table = table.slice(0, int(starts[-1]))
            starts = starts[:-1]
        if table.num_rows == 0:
            return None, rest
        offsets = pa.array(np.append(starts, table.num_rows).astype(np.int32))
        digests = [pa.array(np.add.reduceat(table.column(h).to_numpy().astype(np.uint64), starts).astype(np.int64)) for h in ("h1", "h2")]
        lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in ("path", "mark")]
        firsts = table.select(["owner", "version"]).take(pa.array(starts))
        out = pa.Table.from_arrays([*(c.combine_chunks() for c in firsts.columns), *digests, *lists], names=["owner", "version", "d1", "d2", "paths", "marks"])
        return out, rest

    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = pa.Table.from_batches([batch])
        done, held = emit(pa.concat_tables([held, now]) if held is not None else now, last=False)
        if done is not None:
            yield from done.to_batches()
    if held is not None and held.num_rows:
        done, _ = emit(held, last=True)
        yield from done.to_batches()


def chunked_entries(entries: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of ``(owner, version, path, mark)`` rows, once per key: a row per chunk with its 128-bit digest.

    The rows are range-partitioned by the whole sort key, so a snapshot of any size is
    spread over tasks. A partition edge may cut a chunk; that only makes it unmatched.
    """
    keyed = entries.select(
        "owner",
        "version",
        "path",
        "mark",
        (F.pmod(F.xxhash64("path"), F.lit(chunk_rows)) == 0).alias("cut"),
        F.xxhash64("path", F.coalesce("mark", F.lit("\0"))).alias("h1"),
        F.xxhash64(F.lit(17), F.coalesce("mark", F.lit("\0")), "path").alias("h2"),
    )
    order = ["owner", "version", "path", F.col("mark").asc_nulls_last()]
    ranged = keyed.repartitionByRange("owner", "version", "path").sortWithinPartitions(*order)
    return ranged.mapInArrow(_chunk_batches, _CHUNK_SCHEMA)


def snapshot_changes(
    manifests: DataFrame,
    owner: str = "publish_dir",
    version: str = "generation",
    files: str = "files",
    path: str = "path",
    mark: str = "blake3",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per change between a snapshot and the one before it: (owner, version, path, change).

    ``version`` of the result is the newer snapshot's; ``change`` is ``added``, ``removed`` or ``changed``.

    Defined cases: a null list is no snapshot, an empty list is an empty one; versions are
    ordered by number and repeated deliveries of a version are one snapshot (their entries
    united); a null version or a null path is left out; marks compare without letter case and
    null is a mark of its own; a path with several marks in one snapshot keeps the smallest;
    a null owner is an owner; extra columns are ignored; no rows in, no rows out.
    """
    given = manifests.select(
        F.col(owner).alias("owner"), F.col(version).cast("long").alias("version"), F.col(files).alias("files")
    ).where(F.col("files").isNotNull() & F.col("version").isNotNull())
    entries = (
        given.select("owner", "version", F.explode("files").alias("f"))
        .select("owner", "version", F.col(f"f.{path}").alias("path"), F.lower(F.col(f"f.{mark}")).alias("mark"))
        .where(F.col("path").isNotNull())
    )
    by_owner = Window.partitionBy("owner").orderBy("version")
    versions = (
        given.select("owner", "version")
        .distinct()
        .select(
            F.col("owner").alias("v_owner"),
            F.col("version").alias("v_version"),
            F.lag("version").over(by_owner).alias("before"),
            F.lead("version").over(by_owner).alias("after"),
        )
    )
    if versions.limit(BROADCAST_VERSIONS + 1).count() <= BROADCAST_VERSIONS:
        versions = F.broadcast(versions)
    same = Window.partitionBy("owner", "d1", "d2").orderBy("version")
    seen_before, seen_after = F.lag("version").over(same), F.lead("version").over(same)
    # a chunk is needed as the newer side of one step and as the older side of the next
    steps = F.array(
        F.struct(F.when(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(seen_before), F.col("version")).alias("version"), F.lit(True).alias("newer")),
        F.struct(F.when(F.col("after").isNotNull() & ~F.col("after").eqNullSafe(seen_after), F.col("after")).alias("version"), F.lit(False).alias("newer")),
    )
    unmatched = (
        chunked_entries(entries, chunk_rows)
        .join(versions, F.col("owner").eqNullSafe(F.col("v_owner")) & (F.col("version") == F.col("v_version")))
        .select("owner", "paths", "marks", F.filter(steps, lambda x: x["version"].isNotNull()).alias("steps"))
        .where(F.size("steps") > 0)
    )
    sides = (
        unmatched.select("owner", "steps", F.explode(F.arrays_zip("paths", "marks")).alias("e"))
        .select("owner", F.col("e.paths").alias("path"), F.coalesce("e.marks", F.lit("\0")).alias("mark"), F.explode("steps").alias("s"))
        .select("owner", "path", "mark", "s.version", "s.newer")
    )
    paired = sides.groupBy("owner", "version", "path").agg(
        F.max(F.when(F.col("newer"), F.col("mark"))).alias("now"),
        F.max(F.when(~F.col("newer"), F.col("mark"))).alias("was"),
    )
    return (
        paired.where(~F.col("now").eqNullSafe(F.col("was")))
        .select(
            F.col("owner").alias(owner),
            F.col("version").alias(version),
            F.col("path").alias(path),
            F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"),
        )
    )
