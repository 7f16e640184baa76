"""An index that grows by files: only files it doesn't hold yet are encoded, and each add is committed as a whole.

Layout of the folder: the model (`VectorIndex.write_model`), codes/batch=<name>/list_id=<n>/ and manifest/batch=<name>/ with
one row for each file (file, size, batch). An add writes its codes first and its manifest last; readers take the codes of
batches with a manifest only, so an add that fails leaves nothing that a search sees, and is simply done again. One
writer at a time. A vector is named by its file and its row there, which no later add changes.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators.vector_index import VectorIndex
from quadrille.sources.readers import parquet_files

MANIFEST = "file string, size long, batch string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, size, batch of all files that the index holds."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)


def codes(spark: SparkSession, path: str) -> DataFrame:
    """vec_id (file#row), file, row_idx, list_id, code of every vector of the index, by list."""
    kept = [r.batch for r in manifest(spark, path).select("batch").distinct().collect()]  # one row an add
    schema = "vec_id string, file string, row_idx long, code binary, batch string, list_id int"
    if not kept:
        return spark.createDataFrame([], schema).drop("batch")
    return spark.read.schema(schema).parquet(f"{path}/codes").where(F.col("batch").isin(kept)).drop("batch")


def add(spark: SparkSession, path: str, folder: str, vector: str = "embedding") -> int:
    """Encode the Parquet files of a folder that the index doesn't hold yet; the number of files added.

    A file that has changed its size since it was added is an error: its codes would no longer be those of its rows.
    """
    known = manifest(spark, path).select(F.col("file").alias("own"), F.col("size").alias("own_size"))
    there = parquet_files(spark, folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    met = there.join(known, there["file"] == known["own"], "left")
    changed = met.where("own IS NOT NULL AND own_size <> size").select("file").limit(5).collect()
    if changed:
        raise ValueError(f"files have changed since they were added: {', '.join(r.file for r in changed)}")
    new = met.where("own IS NULL").select("path", "file", "size").orderBy("file").collect()  # names of files, as Spark lists them itself
    if not new:
        return 0
    index, batch = VectorIndex.load_model(spark, path), uuid.uuid4().hex
    rows = spark.read.parquet(*[r.path for r in new])
    file, row = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.col("_metadata.row_index")
    placed = rows.select(file.alias("file"), row.alias("row_idx"), F.col(vector)).withColumn("vec_id", F.concat_ws("#", "file", "row_idx"))
    coded = index.encode(placed, "vec_id", vector).withColumn("batch", F.lit(batch))
    coded.hint("rebalance", "list_id").write.mode("append").partitionBy("batch", "list_id").parquet(f"{path}/codes")
    done = spark.createDataFrame([(r.file, r.size) for r in new], "file string, size long").withColumn("batch", F.lit(batch))
    done.coalesce(1).write.mode("append").partitionBy("batch").parquet(f"{path}/manifest")
    return len(new)


def create(spark: SparkSession, index: VectorIndex, path: str) -> None:
    """An index without vectors, to be added to."""
    index.write_model(spark, path)
