"""One query per operator over the whole of its table, with SQL where SQL can
express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyhub.llm import (
    alignment,
    bpe,
    chat,
    coder,
    jaccard,
    mixing,
    packing,
    periodic,
    quality,
    secrets,
    substrings,
    twins,
    vectors,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_quality_rules")
def op1(spark, path):
    return quality.quality_verdicts(table(spark, path, "documents"))


@query("op2_jaccard_join", twins.JACCARD)
def op2(spark, path):
    return jaccard.similar_documents(table(spark, path, "documents"))


@query("op3_perspective_rotation", chat.SQL)
def op3(spark, path):
    return chat.rotate_perspectives(table(spark, path, "conversations"))


@query("op4_range_coded_ids")
def op4(spark, path):
    return coder.token_files(table(spark, path, "documents"), vocabulary("byte_bpe_50k.json")).drop("ids")


@query("op5_secret_scan", twins.SECRETS)
def op5(spark, path):
    return secrets.secret_report(table(spark, path, "documents"))


@query("op6_curve_packing")
def op6(spark, path):
    return packing.pack_documents(table(spark, path, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")


@query("op9_bpe_round_trip")
def op9(spark, path):
    return bpe.encode_documents(table(spark, path, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_doubling_dedup", twins.SUBSTRINGS)
def op7(spark, path):
    return substrings.remove_repeats(table(spark, path, "documents")).drop("kept")


@query("op8_metric_vector_join", twins.VECTORS)
def op8(spark, path):
    return vectors.near_duplicate_vectors(table(spark, path, "embeddings"))


@query("op10_warc_normaliser", twins.WARC)
def op10(spark, path):
    return warc.archive_pages(table(spark, path, "pages")).drop("url", "payload")


@query("op11_token_alignment")
def op11(spark, path):
    docs = table(spark, path, "documents")
    return alignment.align_tokenizers(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), full=False)[0]


@query("op12_periodic_runs")
def op12(spark, path):
    return periodic.periodic_runs(table(spark, path, "documents"), plant=True, full=False)


@query("op13_fair_mixing", mixing.SQL)
def op13(spark, path):
    return mixing.mix_report(table(spark, path, "documents"))
