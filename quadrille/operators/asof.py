"""As-of look-up: each point with the last boundary before it, for boundaries that are a table and no formula."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.sources.shared import shared_path


def asof(points: DataFrame, at: str, bounds: DataFrame, bound: str, value: str, into: str, strict: bool = True) -> DataFrame:
    """points with `into`: the `value` of the last boundary before the point's `at` (with `strict` off: before or at it).

    Both tables are range-partitioned together by the key; each range carries its last boundary along its rows, and the last
    boundary of all ranges before, one a range, comes in by a broadcast. Neither table has to fit anywhere, and points
    of one key spread over ranges. Of boundaries at one key the greatest value counts; boundaries without a key or value are
    left out; points without a key, and those before the first boundary, get null.
    """
    spark = points.sparkSession
    kind = points.select(F.col(at)).unionByName(bounds.select(F.col(bound).alias(at))).schema[0].dataType
    one = points.select(F.struct(*points.columns).alias("_row"), F.col(at).cast(kind).alias("_k"), F.lit(0 if strict else 1).alias("_kind"), F.lit(None).cast(bounds.schema[value].dataType).alias("_v"))
    other = bounds.where(F.col(bound).isNotNull() & F.col(value).isNotNull()).select(F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.col(bound).cast(kind).alias("_k"), F.lit(1 if strict else 0).alias("_kind"), F.col(value).alias("_v"))
    keys = [F.col("_k").asc_nulls_first(), F.col("_kind"), F.col("_v"), F.col("_tie")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = one.unionByName(other).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)

    def carried(batches):
        last, own = None, TaskContext.get().partitionId()
        for batch in batches:
            v = batch.column("_v")
            last = pa.nulls(1, v.type) if last is None else last
            known = np.maximum.accumulate(np.where(v.is_valid().to_numpy(zero_copy_only=False), np.arange(1, len(v) + 1), 0)) if len(v) else np.zeros(0, np.int64)
            found = pa.concat_arrays([last, v]).take(pa.array(known))
            last = found.slice(len(found) - 1) if len(found) else last
            point = batch.column("_row").is_valid()
            rows = pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_k"), found, pa.array(np.full(len(v), own, np.int32))], ["_row", "_k", "_v", "_p"])
            yield rows.filter(point)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, row_type[0]), pa.nulls(1, row_type[1]), last, pa.array([own], pa.int32())], ["_row", "_k", "_v", "_p"])

    from pyspark.sql.pandas.types import to_arrow_type

    row_type = to_arrow_type(one.schema["_row"].dataType), to_arrow_type(kind)
    text = ", ".join(f"{n} {placed.schema[n].dataType.simpleString()}" for n in ("_row", "_k", "_v")) + ", _p int"
    path = shared_path(spark, "asof")
    placed.mapInArrow(carried, text).write.parquet(path)
    held = spark.read.schema(text).parquet(path)
    ends = {r._p: r._v for r in held.where("_row IS NULL").select("_p", "_v").collect()}  # one row a range
    before, rows = None, []
    for p in range(ranges):
        rows.append((p, before))
        before = ends.get(p) if ends.get(p) is not None else before
    earlier = spark.createDataFrame(rows, f"_p int, _before {bounds.schema[value].dataType.simpleString()}")
    met = held.where("_row IS NOT NULL").join(F.broadcast(earlier), "_p")  # one row a range
    return met.select("_row.*", F.when(F.col("_k").isNotNull(), F.coalesce("_v", "_before")).alias(into))
