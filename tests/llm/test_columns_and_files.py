"""Columns with names the operators use themselves, and file stages over many tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from test_operators import LONG, SF, path  # noqa: F401

CLASHES = ["row", "kinds", "found", "was_null", "whole", "__row", "own_0", "kept", "part", "group", "a b"]


@pytest.fixture
def clashing(spark):
    texts = [(1, LONG), (2, "start " + LONG), (3, "password = abcdefgh12 and more"), (4, None), (5, "")]
    rows = [(d, t, "en", "s", len(t or ""), *[f"{c}{d}" for c in CLASHES]) for d, t in texts]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(2)


@pytest.mark.parametrize("name", ["redact", "strip_repeats", "quality", "jaccard"])
def test_clashing_columns_stay(spark, clashing, name):
    import corpus_pipeline
    from storyhub.llm import secrets, substrings

    run = {
        "redact": secrets.redact,
        "strip_repeats": substrings.strip_repeats,
        "quality": lambda docs: corpus_pipeline.quality_stage(spark, docs, SF),
        "jaccard": lambda docs: corpus_pipeline.jaccard_stage(spark, docs, SF),
    }[name]
    out = run(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    for r in rows:
        assert [r[c] for c in CLASHES] == [f"{c}{r['doc_id']}" for c in CLASHES]
    if name == "redact":
        assert {r["doc_id"]: r["text"] for r in rows}[3] == "[SECRET] and more"
    if name == "strip_repeats":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5} and {r["doc_id"]: r["text"] for r in rows}[2] == "start"


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_archives_are_worked_in_parallel(spark):
    from storyhub.llm import warc
    from storyhub.session import scratch_path

    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(8)
    folder = scratch_path(spark, "warc")
    records = warc.write_monolithic(pages, f"{folder}/crawl")
    index = warc.normalise(warc.mark_revisits(records, 0), f"{folder}/crawl", f"{folder}/archive")
    files = index.select("file").distinct().count()
    # Eight tasks; files that hash to one task share it.
    assert files == 8 and tasks_with_rows(warc.by_file(index)) >= 4 and tasks_with_rows(warc.read_records(index)) >= 4
    assert warc.read_records(index).count() == pages.count()


def test_id_files_are_read_in_parallel(spark):
    from storyhub.llm import coder
    from storyhub.session import scratch_path

    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # so little text is one file else
    try:
        files = coder.write_ids(docs, path("byte_bpe_50k.json"), scratch_path(spark, "ids"), file_ids=1_000)
    finally:
        spark.conf.set(merging, "true")
    assert files.count() == 4
    out = coder.read_ids(files)
    assert tasks_with_rows(out) >= 2 and out.count() == docs.count()
