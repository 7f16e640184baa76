"""Space-filling layout: positions along a Morton curve, files by blocks of it, boxes read by ranges of keys.

A position becomes two whole numbers of `BITS` bits, whose bits alternate in its key. A table is written in the order of the key,
in one folder for each block (the key's first `BLOCK` bits), so that a box opens only the folders its key ranges meet, and in them
only the row groups whose least and greatest keys do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, BLOCK = 16, 8
SHIFTS = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _parted(x: Column) -> Column:
    """The bits of a 16-bit number with a gap after each."""
    x = x.cast("long")
    for by, mask in SHIFTS:
        x = F.shiftleft(x, by).bitwiseOR(x).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _step(value: Column, low: float, high: float) -> Column:
    cell = F.floor((value - low) / (high - low) * (1 << BITS))
    return F.least(F.greatest(cell, F.lit(0)), F.lit((1 << BITS) - 1))


def morton(lat: Column, lon: Column) -> Column:
    """Key of a position; null or NaN coordinates have none."""
    sound = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(sound, F.shiftleft(_parted(_step(lat, -90.0, 90.0)), 1).bitwiseOR(_parted(_step(lon, -180.0, 180.0))))


def write_clustered(df: DataFrame, path: str, lat: str, lon: str) -> None:
    """df in key order, a folder for each block; crowded blocks are written by several tasks. Rows without a position go to a block of their own."""
    keyed = df.withColumn("morton", morton(F.col(lat), F.col(lon)))
    keyed = keyed.withColumn("block", F.coalesce(F.shiftright("morton", 2 * BITS - BLOCK), F.lit(-1)).cast("int"))
    keyed.repartitionByRange("block", "morton").sortWithinPartitions("block", "morton").write.partitionBy("block").parquet(path)


def ranges(box: tuple[float, float, float, float], most: int = 64) -> list[tuple[int, int]]:
    """Key ranges, `most` at most, that cover a box (minx, miny, maxx, maxy): quarters are split while they are partly inside."""
    cell = lambda v, low, span: min(max(int((v - low) / span * (1 << BITS)), 0), (1 << BITS) - 1)
    x0, x1, y0, y1 = cell(box[0], -180, 360), cell(box[2], -180, 360), cell(box[1], -90, 180), cell(box[3], -90, 180)
    done, open_ = [], [(0, 0, BITS)]
    while open_:
        x, y, bits = open_.pop(0)  # the largest first
        side = 1 << bits
        if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
            continue
        inside = x >= x0 and y >= y0 and x + side - 1 <= x1 and y + side - 1 <= y1
        if inside or not bits or len(done) + len(open_) + 4 > most:
            first = sum(((y >> b & 1) << 2 * b + 1) | ((x >> b & 1) << 2 * b) for b in range(BITS))
            done.append((first, first + (1 << 2 * bits) - 1))
        else:
            half = side >> 1
            open_ += [(x + dx, y + dy, bits - 1) for dy in (0, half) for dx in (0, half)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], lat: str, lon: str) -> DataFrame:
    """The rows of a clustered table within a box, edges included, without its key columns."""
    spans = ranges(box)
    blocks = sorted({k for a, b in spans for k in range(a >> 2 * BITS - BLOCK, (b >> 2 * BITS - BLOCK) + 1)})
    near = F.lit(False)
    for a, b in spans:
        near = near | F.col("morton").between(a, b)
    df = spark.read.parquet(path).where(F.col("block").isin(blocks) & near)
    return df.where(F.col(lon).between(box[0], box[2]) & F.col(lat).between(box[1], box[3])).drop("morton", "block")
