"""Writers: keyed upsert, change detection, logs, cache files, site map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.functions import text
from storyhub.operators.ranking import one_per_key, top_n


def upsert(current: DataFrame | None, incoming: DataFrame, key: str = "url", order: str = "ord", uuid: str | None = None) -> DataFrame:
    """New state of a table: the last incoming row per key replaces the old
    one. `uuid` names a column whose badly formed values become null. On a table
    format with MERGE the same frame is its source (`merge_upsert`)."""
    latest = one_per_key(incoming, key, order, keep="last")
    if uuid:
        latest = latest.withColumn(uuid, F.when(text.is_uuid(uuid), F.col(uuid)))
    if current is None:
        return latest
    untouched = current.join(latest.select(key), key, "left_anti")
    return untouched.unionByName(latest, allowMissingColumns=True)


def merge_upsert(incoming: DataFrame, table: str, key: str = "url", order: str = "ord") -> None:
    """MERGE into a v2 table; Spark plans and spreads the write."""
    latest = one_per_key(incoming, key, order, keep="last").alias("source")
    latest.mergeInto(table, F.expr(f"{table}.{key} = source.{key}")).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def changed_items(items: DataFrame, snapshot: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """Clustered items whose cluster id or time differs from what was loaded;
    one row per key, the last wins."""
    old = snapshot.select(key, F.col("cluster_id").alias("__cid"), F.col("published_at").alias("__pub"))
    new = one_per_key(items.filter("cluster_id IS NOT NULL"), key, order, keep="last")
    differs = ~F.col("cluster_id").eqNullSafe(F.col("__cid")) | ~F.col("published_at").eqNullSafe(F.col("__pub"))
    return new.join(old, key, "left").filter(differs).drop("__cid", "__pub")


def append_log(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_state(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark, path: str, schema=None, whole_file: bool = True) -> DataFrame:
    """Cache files: one JSON array per file, or one object per line."""
    reader = spark.read.option("multiLine", whole_file)
    return (reader.schema(schema) if schema else reader).json(path)


def truncate(spark, path: str) -> None:
    """Empty a table and keep its schema."""
    like = spark.read.parquet(path)
    like.limit(0).write.mode("overwrite").parquet(path)


def site_map(hubs: DataFrame, site: str, limit: int = 500, priority: float = 0.7) -> DataFrame:
    base = site.rstrip("/")
    latest = top_n(hubs.select("hub_id", "last_updated_at"), [F.col("last_updated_at").desc(), F.col("hub_id")], limit)
    return latest.select(
        F.concat(F.lit(f"{base}/hub/"), text.uri_component(F.col("hub_id"))).alias("url"),
        F.col("last_updated_at").alias("last_modified"),
        F.lit("daily").alias("change_frequency"),
        F.lit(priority).alias("priority"),
    )
