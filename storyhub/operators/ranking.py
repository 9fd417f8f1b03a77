"""Limits per group, one row per key, and stable top lists.

`row_number() <= n` lets Spark cut each map task to n rows per group before
the shuffle (WindowGroupLimit), so a group that holds a third of all rows sends
at most n rows per task and never lands whole in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyhub.functions.text import col

LANE_ORDER = ["mainstream", "grassroots", "discourse"]


def first_n(df: DataFrame, keys, order, n: int, rank: str | None = None) -> DataFrame:
    """First n rows of every group; `rank` keeps the position as a column."""
    keys = [keys] if isinstance(keys, (str, Column)) else list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def one_per_key(df: DataFrame, keys, order: str = "ord", keep: str = "first") -> DataFrame:
    """One row per key: the first or the last in load order."""
    return first_n(df, keys, F.col(order).asc() if keep == "first" else F.col(order).desc(), 1)


def top_n(df: DataFrame, order, n: int | None = None, skip: int = 0) -> DataFrame:
    """Global top list (a bounded heap per task, then one merge)."""
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out if n is None else out.limit(n)


def lane_balanced(items: DataFrame, hub="cluster_id", lane="lane", order="ord", per_lane=2, total=6) -> DataFrame:
    """Up to `total` items per hub: `per_lane` of each lane, then list order.

    Only the first total+1 rows of each lane of a hub can matter, so both
    windows see a bounded number of rows per hub.
    """
    lane_no = F.lit(len(LANE_ORDER))
    for i, name in reversed(list(enumerate(LANE_ORDER))):
        lane_no = F.when(F.coalesce(F.col(lane) == name, F.lit(False)), F.lit(i)).otherwise(lane_no)
    near = first_n(items.withColumn("__lane", lane_no), [hub, "__lane"], order, total + 1, rank="__in_lane")
    size = F.count("*").over(W.partitionBy(hub))
    picked = (F.col("__size") > total) & (F.col("__lane") < len(LANE_ORDER)) & (F.col("__in_lane") <= per_lane)
    near = near.withColumn("__size", size).withColumn("__picked", picked)
    lane_key = F.when(F.col("__picked"), F.col("__lane")).otherwise(F.lit(len(LANE_ORDER)))
    return first_n(
        near, hub, [F.col("__picked").desc(), lane_key.asc(), F.col(order).asc()], total, rank="position"
    ).drop("__lane", "__in_lane", "__size", "__picked")


def hero_and_rest(hubs: DataFrame, hub="hub_id", updated="last_updated_at") -> DataFrame:
    """Mark the latest hub as hero and the others as rest; a lone hub is both."""
    newest_first = F.struct(-F.unix_micros(updated), F.col(hub))
    # One aggregate row, so the broadcast is bounded whatever the input.
    hero = hubs.agg(F.min_by(hub, newest_first).alias(hub), (F.count("*") == 1).alias("__lone"))
    return (
        hubs.join(F.broadcast(hero), hub, "left")
        .withColumn("is_hero", F.col("__lone").isNotNull())
        .withColumn("is_rest", F.coalesce("__lone", F.lit(True)))
        .drop("__lone")
    )
