"""Exact near-duplicate join of vectors by pivots.

Unit vectors with cosine >= t lie within distance r = sqrt(2 - 2t). Pivots, a
bounded sample of the vectors of each label, split a label into cells: a vector
is at home in the cell of its nearest pivot. Two linked vectors can have
different homes only if each lies near the border between the cells, so a vector
is also sent to every cell whose border is within r of it and whose pivot is
within the cell's radius plus r (triangle inequality). Cells are then joined by
themselves: each task compares a chunk of home vectors with a chunk of all
vectors of the cell, and returns counts and a spanning forest, never pairs.
Equal vectors are one node with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyhub.operators.components import connected_components
from storyhub.session import materialize

CELL_ROWS = 2000
"""Vectors a cell should have; sets the number of pivots of a label."""
MAX_PIVOTS = 256
"""Most pivots of a label. They are held by every task: at most MAX_PIVOTS per
label times the vector's size."""
CHUNK_ROWS = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, scaled to length 1 in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    # Scaled first, so that squares can neither overflow nor vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def _assigner(pivots: dict, reach: float):
    """Rows (label, dim, cell, home, id, n, gap, v); with radii known, one row for every cell a vector must be compared in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                groups.setdefault(key, []).append(k)
            for key, rows in groups.items():
                part = batch.take(pa.array(rows))
                x, p = _matrix(part.column("v")), pivots[key]
                d = _distances(x, p)
                home = d.argmin(axis=1)
                near = d[np.arange(len(x)), home]
                between = _distances(p, p)[home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (d**2 - near[:, None] ** 2) / (2 * between)
                border[between < 1e-9] = 0.0
                in_cell = (border <= reach + 1e-9) & (d - near[:, None] <= 2 * reach + 1e-9)
                in_cell[np.arange(len(x)), home] = True
                at, cell = np.nonzero(in_cell)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(pa.array(at)),
                        part.column("dim").take(pa.array(at)),
                        pa.array(cell.astype(np.int32)),
                        pa.array(cell == home[at]),
                        part.column("id").take(pa.array(at)),
                        part.column("n").take(pa.array(at)),
                        pa.array(d[at, cell]),
                        part.column("v").take(pa.array(at)),
                    ],
                    ["label", "dim", "cell", "home", "id", "n", "gap", "v"],
                )

    return run


def _joiner(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False)
        x = _matrix(table.column("v").combine_chunks())
        ids = table.column("id").to_numpy()
        n = table.column("n").to_numpy()
        home, all_ = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        linked = x[home] @ x[all_].T >= threshold
        linked &= ids[home][:, None] != ids[all_][None, :]
        links = linked @ n[all_]
        # Spread the smallest id over linked vectors until nothing changes.
        low_all = ids[all_].copy()
        low_home = ids[home].copy()
        top = np.iinfo(np.int64).max
        while len(home) and len(all_):
            fresh_home = np.minimum(low_home, np.where(linked, low_all[None, :], top).min(axis=1))
            fresh_all = np.minimum(low_all, np.where(linked, fresh_home[:, None], top).min(axis=0))
            if (fresh_home == low_home).all() and (fresh_all == low_all).all():
                break
            low_home, low_all = fresh_home, fresh_all
        return pa.table(
            {
                "a": pa.array(np.concatenate((ids[home], ids[all_]))),
                "b": pa.array(np.concatenate((low_home, low_all))),
                "links": pa.array(np.concatenate((links, np.zeros(len(all_), np.int64))).astype(np.int64)),
            }
        )

    return run


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    A vector that is null, zero or holds a null or a non-finite component, and
    one without label or id, links with nothing: its component is itself.
    Vectors of different lengths never link. Equal vectors of a label link with
    each other. Other columns are ignored; no rows give no rows.
    """
    spark = rows.sparkSession
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    usable = F.expr(
        """vec_id is not null and label is not null and v is not null and exists(v, x -> x <> 0)
        and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"""
    )
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    keyed = rows.filter("ok").select("vec_id", "label", "v", F.xxhash64("v").alias("h"))
    nodes = materialize(
        keyed.groupBy("label", "h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("v"))
    )
    sizes = {(r["label"], r["dim"]): r["c"] for r in nodes.groupBy("label", "dim").agg(F.count("*").alias("c")).collect()}
    # Pivots: the vectors of smallest hash, a fixed number per label.
    wanted = spark.createDataFrame(
        [(k[0], k[1], min(MAX_PIVOTS, math.ceil(c / CELL_ROWS))) for k, c in sizes.items()], "label string, dim int, want int"
    )
    place = F.expr("row_number() over (partition by label, dim order by xxhash64(h), id)")
    chosen = nodes.withColumn("place", place).filter(F.col("place") <= MAX_PIVOTS).join(wanted, ["label", "dim"]).filter("place <= want")
    picked: dict[tuple, list] = {}
    for r in chosen.orderBy("label", "dim", "place").select("label", "dim", "v").collect():
        picked.setdefault((r["label"], r["dim"]), []).append(r["v"])
    pivots = {k: _matrix(pa.array(v, pa.list_(pa.float64()))) for k, v in picked.items()}
    reach = math.sqrt(2 - 2 * threshold)
    sent = nodes.select("label", "dim", "id", "n", "v").mapInArrow(
        _assigner(pivots, reach), "label string, dim int, cell int, home boolean, id long, n long, gap double, v array<double>"
    )
    sent = materialize(sent)
    cell = ["label", "dim", "cell"]
    stats = sent.groupBy(*cell).agg(
        F.max(F.when(F.col("home"), F.col("gap"))).alias("radius"),
        F.ceil(F.sum(F.col("home").cast("int")) / CHUNK_ROWS).cast("int").alias("homes"),
        F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("members"),
    )
    sent = sent.join(stats, cell).filter(F.col("home") | (F.col("gap") <= F.col("radius") + reach + 1e-9))
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    homes = sent.filter("home").select(
        *cell, chunk("homes").alias("i"), F.explode(F.expr("sequence(0, members - 1)")).alias("j"), F.lit(0).alias("side"), "id", "n", "v"
    )
    members = sent.filter("homes > 0").select(
        *cell, F.explode(F.expr("sequence(0, homes - 1)")).alias("i"), chunk("members").alias("j"), F.lit(1).alias("side"), "id", "n", "v"
    )
    found = materialize(homes.unionByName(members).groupBy(*cell, "i", "j").applyInArrow(_joiner(threshold), "a long, b long, links long"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b").filter("a <> b"))
    settled = nodes.join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "label", "h", "v", F.expr("coalesce(links, 0) + n - 1").alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    good = keyed.join(settled, ["label", "h", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
