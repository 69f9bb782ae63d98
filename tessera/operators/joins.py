"""Joins that Spark has no operator for, as plans of equi joins, windows and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import filled


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each row of ``left`` with the ``value`` of the last row of ``right`` of its key at or before its time.

    Both sides go through one window as a union, so nothing is multiplied, in ranges of time, so a
    hot key is no task of its own; of right rows at one time the largest value holds. A null key or
    time matches nothing.
    """
    names = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_value"), F.struct(*names).alias("_row"))
    b = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(key, time).agg(F.max(value).alias("_value"))
    both = a.unionByName(b.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    found = filled(both, key, [time, "_side"], "_value").where("_side = 1")
    return found.select(key, time, *(F.col(f"_row.{c}").alias(c) for c in names), F.when(F.col(time).isNotNull() & F.col(key).isNotNull(), F.col("last")).alias(value))


def range_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, reach: int) -> DataFrame:
    """Pairs whose positions are at most ``reach`` apart: an equi join on buckets of that width.

    Each left row looks into its own bucket and the two beside it; so it is a hash or merge join
    that spreads over executors, where a condition on ranges alone would be a nested loop.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
    a = left.withColumn("_b", F.explode(F.array(bucket(left_at) - 1, bucket(left_at), bucket(left_at) + 1)))
    b = right.withColumn("_b", bucket(right_at))
    return a.join(b, "_b").where(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_b")


def ancestors(path: Column) -> Column:
    """All prefixes of an absolute path that end at a component, itself included: ``/a/b`` has ``/a`` and ``/a/b``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix_owner(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the longest root that contains it (null where none does).

    The prefixes of a path are exploded and equi-joined with the roots; component boundaries hold
    by construction. Roots are matched as given, without a slash at the end.
    """
    owned = (
        paths.select(path)
        .distinct()
        .select(path, F.explode(ancestors(F.col(path))).alias("_prefix"))
        .join(roots.select(F.col(root).alias("_prefix")).distinct(), "_prefix")
        .groupBy(path)
        .agg(F.max_by("_prefix", F.length("_prefix")).alias(root))
    )
    return paths.join(owned, path, "left")
