"""Coverage of the globe by datasets: masks, comparison, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.grid import GridSpec


def has_data(most: float = 0.5) -> Column:
    """Not more than this share of missing data; unknown shares count as data."""
    n = F.col("nodata")
    return F.coalesce((n <= most) | F.isnan(n), F.lit(True))


def coverage_mask(df: DataFrame, spec: GridSpec, most: float = 0.5) -> DataFrame:
    """y, x, value (255) of the covered cells in an image of the whole grid, north up; other cells have no row."""
    rows, cols = spec.n, int(spec.n * 2)
    y, x = rows - (F.col("grid_row_u") + rows // 2) - 1, F.col("grid_col_r") + cols // 2
    cells = df.where(has_data(most)).select(y.cast("int").alias("y"), x.cast("int").alias("x")).distinct()
    return cells.where(F.col("y").between(0, rows - 1) & F.col("x").between(0, cols - 1)).withColumn("value", F.lit(255))


def compare_coverage(first: DataFrame, second: DataFrame, keys=("grid_row_u", "grid_col_r")) -> DataFrame:
    """Cells of either dataset with status both, first or second."""
    a, b = (df.select(*keys).distinct().withColumn(tag, F.lit(True)) for df, tag in ((first, "_a"), (second, "_b")))
    status = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def colour_mix(first: Column, second: Column) -> Column:
    """One colour of two (struct<r,g,b>): red where both are equally bright, green of the first, blue of the second."""
    bright = lambda c: c["r"] + c["g"] + c["b"]
    red = F.when(bright(first) == bright(second), first["r"]).otherwise(F.lit(0))
    return F.struct(red.alias("r"), first["g"].alias("g"), second["b"].alias("b"))


def mixed_coverage(first: DataFrame, second: DataFrame) -> DataFrame:
    """y, x, r, g, b of two masks (y, x, value; as `coverage_mask` gives) laid over each other: white where both cover a
    cell, green and blue where only the first or second does. A cell of neither has no row."""
    a, b = (df.groupBy("y", "x").agg(F.max("value").alias(n)) for df, n in ((first, "_a"), (second, "_b")))
    grey = lambda n: F.struct(*[F.coalesce(F.col(n), F.lit(0)).alias(c) for c in "rgb"])
    return a.join(b, ["y", "x"], "full_outer").select("y", "x", colour_mix(grey("_a"), grey("_b")).alias("_c")).select("y", "x", "_c.*")


def coverage_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Samples and cells for each combination of `by`, with subtotals."""
    return df.rollup(*by).agg(F.count("*").alias("samples"), F.countDistinct("grid_cell").alias("cells"))
