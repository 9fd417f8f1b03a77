"""Retention sets: what to keep and what to delete, as frames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.functions import times
from storyhub.operators.views import freshness


def orphan_hubs(hubs: DataFrame, made: DataFrame, as_of, hours: float = 168) -> DataFrame:
    """Recent hubs that this run did not make."""
    recent = hubs.filter(F.col("last_updated_at") >= times.hours_before(as_of, hours))
    return recent.join(made.select("hub_id"), "hub_id", "left_anti")


def ghost_hubs(hubs: DataFrame, items: DataFrame) -> DataFrame:
    """Hubs no item refers to. The anti join needs no prior distinct: a hub
    referred to by many rows is settled by its first match."""
    used = items.filter("cluster_id IS NOT NULL").select(F.col("cluster_id").alias("hub_id"))
    return hubs.join(used, "hub_id", "left_anti")


class Retention(NamedTuple):
    kept_items: DataFrame
    deleted_items: DataFrame
    kept_hubs: DataFrame
    deleted_hubs: DataFrame


def retain(items: DataFrame, hubs: DataFrame, as_of, hours: float = 72) -> Retention:
    """Old items and items on the purge list go; old hubs and hubs left without
    items go; kept items lose their embedding."""
    cutoff = times.hours_before(as_of, hours)
    marked = freshness(items.withColumn("__time", F.col("published_at")), as_of)
    marked = marked.withColumn("published_at", F.col("__time")).drop("__time")
    gone = (F.col("status") == "purged") | F.coalesce(F.col("published_at") < cutoff, F.lit(False))
    kept = marked.filter(~gone).drop("status", "embedding")
    old = F.coalesce(F.col("last_updated_at") < cutoff, F.lit(False))
    ghosts = ghost_hubs(hubs.filter(~old), kept)
    return Retention(
        kept,
        marked.filter(gone).drop("status"),
        hubs.filter(~old).join(ghosts.select("hub_id"), "hub_id", "left_anti"),
        hubs.filter(old).unionByName(ghosts),
    )
