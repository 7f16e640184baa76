"""Running sums and numbers along one order of a whole table, without a task that sees all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, lean, spare, written


def running(df: DataFrame, order: list[Column], value: str, into: str, name: str) -> tuple[DataFrame, int]:
    """df in `order`, with the sum of `value` (longs, none null) over all rows before as `into`; and the sum of all.

    Rows are range-partitioned and summed within each range; the ranges' totals, one number each, are added up by the
    driver and joined back. The ranges are written first, so that a lost executor can't move a row to another range.
    Equal rows of the order are told apart by where they were read, so many of them spread over several ranges.
    """
    spark = df.sparkSession
    part, tie = spare(df, "part", "tie")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col(tie)]
    placed = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(tie)

    def sums(batches: Batches) -> Batches:
        carry, own = 0, TaskContext.get().partitionId()
        for batch in batches:
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = carry + np.cumsum(values)
            carry = int(upto[-1]) if len(upto) else carry
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - values), pa.array(np.full(len(values), own, np.int32))], [*batch.schema.names, into, part])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    own = written(placed.mapInArrow(lean(sums), f"{kept}, `{into}` long, `{part}` int"), name)
    totals = sorted(own.groupBy(part).agg(F.max(F.col(into) + F.col(value))).collect())  # one row a range
    ends = np.cumsum([0] + [t[1] for t in totals]).tolist()
    offsets = spark.createDataFrame([(t[0], before) for t, before in zip(totals, ends)], f"`{part}` int, before long")
    out = own.join(F.broadcast(offsets.withColumnRenamed("before", f"{part}_before")), part)  # one row a range
    return out.withColumn(into, F.col(into) + F.col(f"{part}_before")).drop(part, f"{part}_before"), ends[-1]
