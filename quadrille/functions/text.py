"""Names, paths and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_tag(url: Column, root: str) -> Column:
    """The path element after `root/` in a url, null if it has none."""
    found = F.regexp_extract(url, rf"\Q{root}\E/([^/]+)", 1)
    return F.when(found != "", found)


def sample_path(source: Column, grid_cell: Column, product_id: Column) -> Column:
    """source/row/cell/product, the place of an unpacked sample."""
    return F.concat_ws("/", source, F.split_part(grid_cell, F.lit("_"), F.lit(1)), grid_cell, product_id)


def sample_checksum(geometry: Column, timestamp: Column, product_id: Column, embedding: Column, digits: int = 6) -> Column:
    """SHA-256 of geometry, time, product and all elements of the embedding at a fixed number of digits."""
    shown = F.concat(F.lit("["), F.array_join(F.transform(embedding, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), " "), F.lit("]"))
    return F.sha2(F.concat_ws("_", geometry, F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss"), product_id, shown), 256)
