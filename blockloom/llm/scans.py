"""Running sums over a table in one global order, without one task for all rows or for one key.

Rows are sorted by range over all tasks; each task sums up its own part as a stream; and what the parts before it add is a
row per part, which the driver adds up: as many rows as there are shuffle partitions, whatever the table. A key that holds
most rows is cut by range like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import partitions, written


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """df sorted by `by` over all of its partitions. Its sample reads df twice, so df should be a written table."""
    return df.repartitionByRange(partitions(df.sparkSession), *by).sortWithinPartitions(*by)


def segments(key: np.ndarray, before: int | None) -> np.ndarray:
    """For each row the index of the first row of its run of equal keys; -1 where the run began before, with key `before`."""
    at = np.arange(len(key))
    new = np.concatenate(([before is None or key[0] != before], key[1:] != key[:-1]))
    return np.maximum.accumulate(np.where(new, at, -1))


def counted(df: DataFrame, key: str, *by: str) -> DataFrame:
    """df with `ord`: the row's number from 1 among the rows of its key (a long, not null), in the order `by`. df is a written table."""
    schema = StructType([*df.schema.fields, StructField("part", IntegerType()), StructField("ord", LongType())])
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at).to_numpy()
            first, i = segments(keys, last), np.arange(1, len(keys) + 1)
            order = np.where(first < 0, i + n, i - first)
            last, n = int(keys[-1]), int(order[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(order)], names=schema.names)

    rows = written(in_order(df, key, *by).mapInArrow(run, schema))
    ends = rows.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max(F.struct(key, "ord")).ord.alias("n")).orderBy("part").collect()
    told, key_before, n = [], None, 0
    for r in ends:
        add = n if r.first == key_before else 0
        told.append((r.part, r.first, add))
        n = r.n + (add if r.first == r.last else 0)
        key_before = r.last
    carry = df.sparkSession.createDataFrame(told, "of_part int, of_key long, add long")
    out = rows.join(F.broadcast(carry), (F.col("part") == F.col("of_part")) & (F.col(key) == F.col("of_key")), "left")
    return out.withColumn("ord", F.col("ord") + F.coalesce("add", F.lit(0))).drop("of_part", "of_key", "add", "part")


def summed(df: DataFrame, values: list[str], *by: str) -> DataFrame:
    """df with `<value>_before` for each value (longs): the sum over all rows before it in the order `by`. df is a written table."""
    schema = StructType([*df.schema.fields, StructField("part", IntegerType()), *[StructField(f"{v}_before", LongType()) for v in values]])
    at = [df.columns.index(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = [0] * len(at), TaskContext.get().partitionId()
        for b in batches:
            out = []
            for k, i in enumerate(at):
                x = b.column(i).to_numpy()
                out.append(pa.array(np.cumsum(x) - x + total[k]))
                total[k] += int(x.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), *out], names=schema.names)

    rows = written(in_order(df, *by).mapInArrow(run, schema))
    ends = rows.groupBy("part").agg(*[F.sum(v).alias(v) for v in values]).orderBy("part").collect()
    told, before = [], [0] * len(values)
    for r in ends:
        told.append((r.part, *before))
        before = [a + r[v] for a, v in zip(before, values)]
    carry = df.sparkSession.createDataFrame(told, "of_part int, " + ", ".join(f"{v}_add long" for v in values))
    out = rows.join(F.broadcast(carry), F.col("part") == F.col("of_part"))
    return out.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"{v}_add") for v in values}).drop("part", "of_part", *[f"{v}_add" for v in values])
