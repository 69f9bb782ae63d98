"""Places, last values and running sums within groups of any size, by ranges: no group is sorted in one task.

Rows are range-partitioned by group and order, so a hot group lies in many partitions and each
partition goes on where the one before it ended. Windows run within a partition's part of a group; what a part
needs of those before it (how many rows, the last value, their sums) is a table of one row a part and group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def _ranged(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_part``, which rises with (groups, order); written, so that it is the same for all who read it."""
    return written(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _same(columns: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns))


def numbered(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``place`` (from 1) of each row in its group and ``size``, the rows of the group.

    Nulls come first; rows equal in ``order`` are placed in any order. A null group is a group.
    """
    ranged = _ranged(df, groups, order)
    parts = ranged.groupBy("_part", *groups).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", *groups, before.alias("_before"), F.sum("_n").over(whole).alias("size"))
    within = F.row_number().over(Window.partitionBy("_part", *groups).orderBy(*order))
    placed = ranged.withColumn("_k", within)
    joined = placed.alias("a").join(offsets.alias("b"), _same(["_part", *groups]))
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("_k") + F.col("_before")).alias("place"), "size")


def rank_percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, a column for each of ``shares``): the nearest-rank percentiles of each group, exact, whatever its size.

    The rank of a share q among n values is ceil(n q), at least 1. Nulls do not count; a group of nulls has no row.
    """
    placed = numbered(df.where(F.col(value).isNotNull()).select(*groups, value), groups, [value])
    at = {name: F.greatest(F.ceil(F.col("size") * q), F.lit(1)) for name, q in shares.items()}
    wanted = reduce(Column.__or__, (F.col("place") == p for p in at.values()))
    return placed.where(wanted).groupBy(*groups).agg(*(F.max(F.when(F.col("place") == p, F.col(value))).alias(name) for name, p in at.items()))


def filled(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``last``: the last ``value`` that is not null at or before each row of its group.

    Nulls of ``order`` come first. Only groups that lie in several partitions take anything over from
    an earlier one: no more than there are partitions.
    """
    ranged = _ranged(df, [group], order)
    place = Window.partitionBy("_part", group).orderBy(*order)
    own = F.last(value, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.groupBy("_part", group).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order)))).alias("_end"))
    several = ends.groupBy(group).agg(F.count("*").alias("_parts")).where("_parts > 1").select(group)
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    split = ends.alias("a").join(several.alias("b"), _same([group]), "left_semi")
    carried = split.select("_part", group, before.alias("_carried"))
    joined = ranged.withColumn("_own", own).alias("a").join(carried.alias("b"), _same(["_part", group]), "left")
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), F.coalesce("_own", "_carried").alias("last"))


def summed(df: DataFrame, groups: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` with each of ``values`` added up over the rows of its group at or before its own.

    No two rows of a group are equal in ``order``; nulls of it come first, null values add nothing.
    """
    ranged = _ranged(df, groups, order)
    parts = ranged.groupBy("_part", *groups).agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *groups, *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    place = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({v: F.coalesce(F.sum(v).over(place), F.lit(0)) for v in values})
    joined = own.alias("a").join(offsets.alias("b"), _same(["_part", *groups]))
    return joined.select(*((F.col(f"a.{c}") + F.col(f"b._{c}")).alias(c) if c in values else F.col(f"a.{c}") for c in df.columns))
