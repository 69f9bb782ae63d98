"""Filling containers of a fixed capacity with items of varying size.

First-fit decreasing with a tournament tree over the free room of the open containers, run
independently in randomised groups: a group is bounded whatever the number of items, and
with thousands of items in a group the room lost at its edge is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Items that one group holds on average.
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, numbered from 0; every size is at most the capacity.

    A leaf of the tree is a container, a node holds the most room below it; the first
    container with room for an item is found from the root in the tree's height.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    places = [0] * len(sizes)
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    for i in order:
        need = sizes[i]
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        places[i] = node - leaves
        room[node] -= need
        node //= 2
        while node:
            most = room[2 * node] if room[2 * node] > room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return places


def pack(items: DataFrame, specs: DataFrame, item: str = "doc_id", size: str = "tokens", spec: str = "spec_id", capacity: str = "capacity_tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """Assign every item to containers of every spec: (spec, item, part, container_id, start, size).

    An item larger than the capacity is split into full containers of its own and a rest that
    is packed like any other item; ``part`` counts its parts from 0 and ``start`` is where a
    part begins in the item. No other item is split. A container id is unique within a spec.
    Full parts never enter a group: they are rows that Spark numbers in shares of bounded size, so
    an item of any size fills no task.

    Defined cases: a null or negative size counts as 0; an item of size 0 has one part of size
    0; repeated rows are items of their own; a spec whose capacity is null or below 1 gets no
    rows; the number of specs is small (they are broadcast after a count of at most 1,000).
    """
    known = specs.select(F.col(spec).alias("s_spec"), F.col(capacity).cast("long").alias("s_cap")).where(F.col("s_cap") >= 1)
    if known.limit(1001).count() > 1000:
        raise ValueError("more than 1,000 container specs")
    sized = written(items.select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size")), "item-sizes")
    groups = max(1, -(-sized.count() // group_items))
    # the number of a row, not its id, chooses the group, so that a repeated id cannot fill one
    placed = (
        sized.withColumn("row", F.monotonically_increasing_id())
        .withColumn("grp", F.pmod(F.xxhash64("item", "row"), F.lit(groups)))
        .join(F.broadcast(known))
        .withColumn("full", F.floor(F.col("size") / F.col("s_cap")))
        .withColumn("rest", F.col("size") - F.col("full") * F.col("s_cap"))
    )
    rests = placed.where((F.col("rest") > 0) | (F.col("size") == 0)).select("s_spec", "s_cap", "grp", "item", F.col("full").alias("part"), (F.col("full") * F.col("s_cap")).alias("start"), F.col("rest").alias("piece"))
    split = placed.where("full > 0").select("s_spec", "s_cap", "item", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("part"))
    shares = max(1, -(-(split.agg(F.count("*")).first()[0]) // group_items))
    split = split.withColumn("share", F.pmod(F.xxhash64("row", "part"), F.lit(shares)))
    number = F.row_number().over(Window.partitionBy("s_spec", "share").orderBy("row", "part"))
    whole = split.select(
        F.col("s_spec").alias(spec),
        F.col("item").alias(item),
        "part",
        # behind the numbers of all groups
        ((F.lit(groups) + F.col("share")) * F.lit(1 << 32) + number).alias("container_id"),
        (F.col("part") * F.col("s_cap")).alias("start"),
        F.col("s_cap").alias("size"),
    )

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "part"], kind="stable")
        places = first_fit_decreasing(rows["piece"].tolist(), int(rows["s_cap"].iloc[0]))
        return pd.DataFrame(
            {
                spec: rows["s_spec"].to_numpy(),
                item: rows["item"].to_numpy(),
                "part": rows["part"].to_numpy(),
                "container_id": rows["grp"].to_numpy() * (1 << 32) + np.asarray(places, dtype=np.int64),
                "start": rows["start"].to_numpy(),
                "size": rows["piece"].to_numpy(),
            }
        )

    kinds = dict(rests.dtypes)
    packed = rests.groupBy("s_spec", "grp").applyInPandas(fill, f"{spec} {kinds['s_spec']}, {item} {kinds['item']}, part long, container_id long, start long, size long")
    return packed.unionByName(whole)
