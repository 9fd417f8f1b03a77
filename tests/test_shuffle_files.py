"""Intermediate tables leave no shuffle files behind."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from storyhub.session import materialize


def _shuffled(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*.data", recursive=True)}


def test_a_stored_table_frees_its_shuffle_files(spark):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 1000)
    before = _shuffled(spark)
    counts = materialize(rows.groupBy("k").agg(F.collect_list("id").alias("ids")))
    assert not _shuffled(spark) - before
    assert counts.count() == 1000 and counts.agg(F.sum(F.size("ids"))).first()[0] == 20_000
    assert materialize(counts.repartition(7)).count() == 1000
