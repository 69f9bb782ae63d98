"""Incremental catalog: what a listing changes in it, and the state that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_changes(catalog: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side with its state: ``added``, ``deleted``, ``unchanged_meta``, ``unchanged_hash`` or ``modified``.

    Both have ``keys``, ``size`` and ``hash``. Equal size and hash: nothing to read. Equal hash
    only: touched, but its content is as before. Nulls are equal to each other. One full outer
    join on the keys; a side's repeats must be removed before.
    """
    a = catalog.select(*keys, F.col("size").alias("old_size"), F.col("hash").alias("old_hash"), F.lit(True).alias("old"))
    b = listing.select(*keys, F.col("size").alias("new_size"), F.col("hash").alias("new_hash"), F.lit(True).alias("new"))
    same_hash = F.col("old_hash").eqNullSafe(F.col("new_hash"))
    state = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(same_hash & F.col("old_size").eqNullSafe(F.col("new_size")), "unchanged_meta")
        .when(same_hash, "unchanged_hash")
        .otherwise("modified")
    )
    return a.join(b, keys, "full").select(*keys, state.alias("state"), "old_size", "new_size", "old_hash", "new_hash")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those with their keys."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*base.columns))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order``, whole."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
