"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a shuffled order that depends on ids alone,
all of them once and then once more. A document that is sent has a virtual
finish time: the words its source has sent by then, divided by the source's
target. All sources would reach their targets at time 1 together, so sorting all
documents by finish time serves each source by its weight at every moment; the
mix is the head of that order, up to the total budget.

A long document is sent in parcels of PARCEL words with finish times of their own,
so that the cut at the budget leaves each source within a parcel of its target.
A document is cut only there.

Orders and running totals are made by range sorts, so a source that holds most
documents is spread over many tasks. Sources themselves are rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.llm import arrays
from storyhub.operators.running import running_totals
from storyhub.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
PARCEL = 128
SEED = "mix"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in arrays.slices(batches):
        data, at = arrays.text_bytes(piece.column("text"))
        *_, word_at = arrays.find_words(data, at)
        kept = [piece.column(c) for c in ("doc_id", "source", "key", "tie")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(word_at), pa.int64())], ["doc_id", "source", "key", "tie", "size"])


def sized_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """row, doc_id, source, size in words, and what a source is shuffled by: a hash
    of the id, then of the text."""
    spoken = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"),
        F.md5(F.concat(F.lit(seed), spoken)).alias("key"), F.xxhash64("text").alias("tie"),
    )
    sized = slim.mapInArrow(_sizes, "doc_id long, source string, key string, tie long, size long")
    return materialize(sized.withColumn("row", F.monotonically_increasing_id()))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """One row per source: `rank` in code point order (null last), source_size, `offset` (words
    of the sources before it), and target.

    The budget, `share` of all words, is divided by weight; a target stops at
    `copies` times its source, and what is left over goes to the others by
    weight. In the order of limit to weight, the sources up to some place are
    at their limit and the rest share one level; that place is the first at
    which the level of the rest is within the next source's limit.
    """
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    one = totals.select("source", F.col("source").isNull().alias("none"), "source_size", F.lit(1).cast("long").alias("one"))
    ranked = running_totals(one, ["none", "source"], ["one", "source_size"])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = (
        ranked.select("source", "source_size", F.col("before_one").alias("rank"), F.col("before_source_size").alias("offset"))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * int(copies))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    ranked = materialize(ranked)
    filled = running_totals(ranked.select("ratio", "rank", "limit", "weight"), ["ratio", "rank"], ["limit", "weight"])
    all_of = ranked.agg((F.sum("source_size") * float(share)).alias("budget"), F.sum("weight").alias("weights"))
    level = (F.col("budget") - F.col("before_limit")) / (F.col("weights") - F.col("before_weight"))
    levels = filled.withColumn("budget", all_of.select("budget").scalar()).withColumn("weights", all_of.select("weights").scalar())
    first = levels.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("ratio", "rank", "level"))["level"].alias("level"))
    return ranked.withColumn("level", first.scalar()).select(
        "source", "rank", "offset", "source_size", F.least(F.col("weight") * F.col("level"), F.col("limit").cast("double")).alias("target")
    )


def _queued(docs: DataFrame, copies: int, seed: str, weights, share: float) -> DataFrame:
    """Rows with the words their source has sent before them (`at`, first round)."""
    sized = sized_rows(docs, seed)
    targets = materialize(source_targets(sized, weights, share, copies))
    named = targets.withColumnRenamed("source", "__source")
    rows = sized.join(named, sized["source"].eqNullSafe(named["__source"])).drop("__source")
    placed = running_totals(materialize(rows), ["rank", "key", "tie", "row"], ["size"])
    return materialize(
        placed.select("row", "doc_id", "source", "rank", "size", "source_size", "target", (F.col("before_size") - F.col("offset")).alias("at"))
    )


def _taken(queued: DataFrame, share: float, copies: int, parcel: int) -> DataFrame:
    """Words the mix takes of every copy of a document: row, copy, finish, taken."""
    sent = queued.filter("size > 0").select(
        "row", "rank", "target", "size", "source_size", "at", F.explode(F.sequence(F.lit(0), F.lit(int(copies) - 1))).alias("copy")
    )
    sent = sent.withColumn("from", F.explode(F.expr(f"sequence(0L, size - 1, {int(parcel)}L)")))
    sent = sent.withColumn("words", F.least(F.lit(int(parcel)).cast("long"), F.col("size") - F.col("from")))
    sent = sent.withColumn("end", F.col("copy") * F.col("source_size") + F.col("at") + F.col("from") + F.col("words"))
    sent = sent.select("row", "copy", "rank", "end", "words", (F.col("end") / F.col("target")).alias("finish"))
    budget = queued.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) * float(share))).scalar()
    cut = running_totals(sent, ["finish", "rank", "end"], ["words"]).withColumn("budget", budget).filter("before_words < budget")
    return cut.groupBy("row", "copy").agg(
        F.max("finish").alias("finish"), F.sum(F.least("words", F.col("budget") - F.col("before_words"))).alias("taken")
    )


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, parcel: int = PARCEL, seed: str = SEED
) -> DataFrame:
    """The mix: doc_id, source, copy (0 or more), finish and taken, one row for every
    copy of a document with words in it. Sorted by `finish` it serves the sources
    by weight; `taken` is less than the size only where the budget cuts.

    Options and odd rows as in `mix_report`.
    """
    queued = _queued(docs, copies, seed, weights, share)
    return _taken(queued, share, copies, parcel).join(queued.select("row", "doc_id", "source"), "row").select(
        "doc_id", "source", "copy", "finish", "taken"
    )


def mix_report(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, parcel: int = PARCEL, seed: str = SEED
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, and
    taken, the words of it in the mix with repeats counted.

    Null or empty text: size 0, nothing taken. Null source: a source of its own,
    the last in order. Rows with equal or no doc_id are queued one by one, ordered
    by a hash of the text; rows equal in both are alike in all outputs. Equal
    finish times are ordered by source. Other columns are ignored; no documents
    give no rows. No copy is taken twice, so no document exceeds `copies` times
    its size.
    """
    queued = _queued(docs, copies, seed, weights, share)
    taken = _taken(queued, share, copies, parcel).groupBy("row").agg(F.sum("taken").alias("taken"))
    return queued.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('mix' || coalesce(doc_id::varchar, '')) as key, md5(coalesce(text, '')) as tie
  from documents),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, [5, 2, 1][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int] as weight,
         row_number() over (order by source nulls last) as rank, 2 * source_size as cap from sums),
filled as (
  select *, cap / weight as ratio,
         coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as caps,
         coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as taken_weight,
         sum(source_size) over () * 1.5::double as budget, sum(weight) over () as weights
  from ranked),
level as (
  select arg_min((budget - caps::double) / (weights - taken_weight)::double, struct_pack(a := ratio, b := rank)) as level
  from filled where (budget - caps::double) / (weights - taken_weight)::double <= ratio),
targets as (select source, rank, source_size, least(weight * level, cap::double) as target from ranked, level),
queued as (
  select s.doc_id, s.size, t.rank, t.source_size, t.target, row_number() over () as n,
         sum(s.size) over (partition by t.rank order by s.key, s.tie rows unbounded preceding) - s.size as sent_before
  from sized s join targets t on s.source is not distinct from t.source),
sent as (
  select n, rank, c.copy * source_size + sent_before + least(p.part * 128 + 128, size) as ends, least(128, size - p.part * 128) as words, target
  from (select *, unnest(range(0, (size + 127) // 128)) as part from queued) p, (values (0), (1)) c(copy)),
timed as (
  select n, words, sum(words) over (order by ends / target, rank, ends rows unbounded preceding) - words as before_words from sent),
taken as (
  select n, sum(least(words, budget - before_words)) as taken
  from timed, (select floor(sum(size) * 1.5::double) as budget from sized) where before_words < budget group by n)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from queued left join taken using (n)
"""
