"""Exact percentiles per group by bisection over mergeable daily counts.

The daily table counts rows by day, group and value; daily tables of separate partitions or days
combine by adding counts. For each group and percentile an interval of values is kept; a pass
counts the rows below the interval's midpoints, straight from the daily rows, and keeps the part
that holds the wanted rank, until one value is left. Nothing is rounded and no group is ever
gathered or sorted in one place: a pass adds up at most 65 counts per group and percentile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Midpoints that one pass counts below in each open interval, as a power of two.
PASS_BITS = 6


def daily_counts(rows: DataFrame, keys: list[str], at_ms: str, groups: list[str], values: list[str]) -> DataFrame:
    """Counts by (day, groups, measure, value), each record counted once.

    ``keys`` identify a record (null is a value of its own); all its repeats have the same time,
    so a day's table holds each record once however late it arrives. Null values are left out,
    as are records without a time. Should repeats of a record differ in a value, the largest counts.
    """
    measures = F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).alias("value")) for v in values))
    # 128 bits stand for the identifying columns: the shuffle moves numbers instead of long names
    once = (
        rows.select(
            F.xxhash64(*keys, *(F.col(k).isNull() for k in keys)).alias("k1"),
            F.xxhash64(F.lit(29), *reversed(keys), *(F.col(k).isNull() for k in keys)).alias("k2"),
            F.floor(F.col(at_ms) / 86_400_000).cast("long").alias("day"),
            *groups,
            *(F.col(v).cast("long").alias(v) for v in values),
        )
        .where(F.col("day").isNotNull())
        .groupBy("k1", "k2", "day", *groups)
        .agg(*(F.max(v).alias(v) for v in values))
    )
    return (
        once.select("day", *groups, F.explode(measures).alias("m"))
        .where(F.col("m.value").isNotNull())
        .groupBy("day", *groups, F.col("m.measure").alias("measure"), F.col("m.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def combine(*daily: DataFrame) -> DataFrame:
    """Daily tables of separate partitions or days as one; equal values add up."""
    whole = reduce(DataFrame.unionByName, daily)
    return whole.groupBy(*[c for c in whole.columns if c != "n"]).agg(F.sum("n").alias("n"))


def _shift(low: Column, high: Column, pass_bits: int) -> Column:
    """Binary digits that a pass leaves out, so that low..high has at most 2**pass_bits + 1 parts; halves do not overflow."""
    half = F.call_function("shiftright", high, F.lit(1)) - F.call_function("shiftright", low, F.lit(1))
    return F.greatest(F.length(F.bin(half)) + 1 - pass_bits, F.lit(0))


def bisect(daily: DataFrame, groups: list[str], percents: list[float], pass_bits: int = PASS_BITS) -> DataFrame:
    """(groups, measure, percent, n, value, error_bound): the nearest-rank percentile of each group.

    The rank of percent p among n values is ceil(n * p / 100), at least 1. ``daily`` has rows
    (groups, measure, value, n); the same value may stand in any number of rows (days, partitions).
    A pass counts the rows below the midpoints of each open interval (multiples of a power of two,
    2**pass_bits of them, so it halves the interval ``pass_bits`` times) and narrows the interval
    to the least and largest value in the part that holds the rank. ``value`` is exact for every
    64-bit integer: ``error_bound`` is always 0.

    The intervals are a table in the shared folder, one row a group: Spark broadcasts it where its
    written size allows and otherwise joins by shuffle, with a hot group split by adaptive execution.

    Defined cases: a null group is a group; ties are counted by rank; no rows in, no rows out.
    """
    keys = [*groups, "measure"]
    counts = written(daily.select(*keys, F.col("value").cast("long").alias("value"), "n"), "daily-values")
    marks = F.array(
        *(
            F.struct(
                F.lit(float(p)).alias("percent"),
                F.greatest(F.ceil(F.col("total") * float(p) / 100.0), F.lit(1)).cast("long").alias("rank"),
                F.lit(0).cast("long").alias("below"),
                F.col("low").alias("low"),
                F.col("high").alias("high"),
            )
            for p in percents
        )
    )
    ends = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    state = written(ends.select(*keys, "total", marks.alias("marks")), "intervals")
    while not state.where(F.exists("marks", lambda m: m["low"] < m["high"])).isEmpty():
        wanted = F.filter("s.marks", lambda m: (m["low"] < m["high"]) & (F.col("c.value") >= m["low"]) & (F.col("c.value") <= m["high"]))
        inside = counts.alias("c").join(state.alias("s"), _same("c", "s", keys)).select(*(F.col(f"c.{k}") for k in keys), "c.value", "c.n", F.explode(wanted).alias("m"))
        shift = _shift(F.col("m.low"), F.col("m.high"), pass_bits)
        slot = F.call_function("shiftright", F.col("value"), shift) - F.call_function("shiftright", F.col("m.low"), shift)
        slots = inside.groupBy(*keys, "m.percent", slot.alias("slot")).agg(F.sum("n").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
        gathered = slots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("percent", "slot", "n", "first", "last"))).alias("slots"))
        narrowed = state.alias("s").join(gathered.alias("g"), _same("s", "g", keys), "left")
        moved = F.transform("s.marks", lambda m: F.when(m["low"] < m["high"], _narrowed(m, F.filter("g.slots", lambda x: x["percent"] == m["percent"]))).otherwise(m))
        state = written(narrowed.select(*(F.col(f"s.{k}") for k in keys), "s.total", moved.alias("marks")), "intervals")
    return state.select(*keys, "total", F.explode("marks").alias("m")).select(*keys, "m.percent", F.col("total").alias("n"), F.col("m.low").alias("value"), F.lit(0).cast("long").alias("error_bound"))


def _narrowed(mark: Column, slots: Column) -> Column:
    """The interval of the first slot at which the running count reaches the rank, with the rows below it."""
    begin = F.struct(mark["below"].alias("below"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))

    def step(seen: Column, slot: Column) -> Column:
        here = seen["below"] + slot["n"] >= mark["rank"]
        further = F.struct(
            F.when(here, seen["below"]).otherwise(seen["below"] + slot["n"]).alias("below"), F.when(here, slot["first"]).alias("low"), F.when(here, slot["last"]).alias("high")
        )
        return F.when(seen["low"].isNotNull(), seen).otherwise(further)

    found = F.aggregate(slots, begin, step)
    return F.struct(mark["percent"].alias("percent"), mark["rank"].alias("rank"), found["below"].alias("below"), found["low"].alias("low"), found["high"].alias("high"))


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))
