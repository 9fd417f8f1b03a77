"""Running totals over rows in a global order, without one task that sees all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from storyhub.session import materialize


def running_totals(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """rows with `before_<value>`, the sum of that column over all rows before
    in the given order (nulls first, which should be total).

    Rows are sorted by range; each range adds up by itself and gets the sum of
    the ranges before it. Only those sums, one row per range, meet in the driver.
    """
    names = [f"before_{v}" for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(values, 0)
        for batch in batches:
            columns = list(batch.columns)
            for v in values:
                n = batch.column(v).to_numpy(zero_copy_only=False)
                ends = held[v] + np.cumsum(n)
                columns.append(pa.array(ends - n, pa.int64()))
                held[v] = int(ends[-1]) if len(n) else held[v]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    schema = StructType([*ordered.schema.fields, *[StructField(n, LongType()) for n in names]])
    summed = materialize(ordered.mapInArrow(run, schema))
    held, bases = [0] * len(values), []
    for r in summed.groupBy("__range").agg(*[F.sum(v).alias(v) for v in values]).orderBy("__range").collect():
        bases.append((r["__range"], *held))
        held = [x + r[v] for x, v in zip(held, values, strict=True)]
    base = rows.sparkSession.createDataFrame(bases, "__range int, " + ", ".join(f"__base{k} long" for k in range(len(values))))
    out = summed.join(base, "__range")
    added = {n: F.col(n) + F.col(f"__base{k}") for k, n in enumerate(names)}
    return out.withColumns(added).select(*rows.columns, *names)
