"""The stages one after the other against plain loops."""

from __future__ import annotations

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import test_operators as loops  # noqa: E402


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{loops.SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "secret_scans", "packing"]
    made, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, loops.SF).write.parquet(f"{tmp_path}/{name}")
        made[name] = before, after = now, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == docs.columns
        now = after
    rows = {name: (loops.pairs(a), loops.pairs(b) if name != "packing" else b.collect()) for name, (a, b) in made.items()}

    before, after = rows["quality_rules"]
    failed = {d for d, t in before if loops.base_counts(t)[5]}
    assert {d for d, _ in after} <= {d for d, _ in before} - failed and len(after) > 0.9 * (len(before) - len(failed))

    before, after = rows["ngram_jaccard_join"]
    first = {d for d, _, part in loops.jaccard_loop(before) if d == part}
    loops.same(after, [(d, t) for d, t in before if d in first])

    before, after = rows["substring_dedup"]
    words = {d: " ".join(loops.WORD.findall(t or "")) for d, t in after}
    import hashlib

    for d, _, removed, digest in loops.windows_loop(before, 50):
        assert hashlib.sha256(words[d].encode()).hexdigest() == digest
        assert removed or dict(after)[d] == dict(before)[d]

    before, after = rows["secret_scans"]
    for d, t in after:
        assert loops.secrets_loop(t)[:3] == (0, 0, 0) and (loops.secrets_loop(dict(before)[d])[:3] != (0, 0, 0) or t == dict(before)[d] or "[SECRET]" in t)

    before, after = rows["packing"]
    assert {r["doc_id"] for r in after} == {d for d, _ in before}
    assert corpus_pipeline.run(spark, loops.SF).count() == len(after)


def test_filters_act_on_rows(spark):
    """Rows without an id are filtered too, and of rows that share an id each is judged."""
    import corpus_pipeline

    long = [" ".join(f"{a}{k}" for k in range(40)) for a in "abc"]
    rows = [(None, "too short"), (5, "short"), (5, long[0]), (None, long[1]), (None, long[1]), (7, long[2]), (7, long[2]), (None, long[2]), (6, long[2])]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    judged = loops.pairs(corpus_pipeline.quality_stage(spark, docs, loops.SF))
    assert not {t for _, t in judged} & {"too short", "short"} and (5, long[0]) in judged
    got = loops.pairs(corpus_pipeline.jaccard_stage(spark, docs.filter("length(text) > 20"), loops.SF))
    loops.same(got, [(5, long[0]), (None, long[1]), (6, long[2])])


def test_entry_has_every_query():
    import __spark_entry__ as entry

    names = entry.queries()
    for k in range(1, 11):
        assert len([n for n in names if n.startswith(f"op{k}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
