"""Point reads of archives: which row groups and columns are opened, and what comes back."""

import io
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quadrille.sources import archive_rows, readers

from .compare import duck, same


@pytest.fixture
def folder(tmp_path):
    """Two archives of 1,000 row groups of one row, one of groups of seven rows."""
    (tmp_path / "a").mkdir()
    for name, first, each in (("x", 0, 1), ("y", 1000, 1), ("z", 2000, 7)):
        ids = list(range(first, first + 1000))
        table = pa.table({"id": ids, "band": pa.array([b"%d" % i * 20 for i in ids], pa.binary()), "other": pa.array([b"o" * 2000] * 1000, pa.binary())})
        pq.write_table(table, tmp_path / "a" / f"{name}.parquet", row_group_size=each, compression="none", use_dictionary=False)
    return tmp_path / "a"


def test_reads_wanted_groups_only(spark, folder, tmp_path, monkeypatch):
    rows = [("x", i) for i in range(3, 1000, 100)] + [("z", 0), ("z", 6), ("z", 7), ("z", 999)]
    wanted = spark.createDataFrame([(f"{folder}/{f}.parquet", i) for f, i in rows + rows[:3]] + [(None, 1), ("x", None)], "parquet_url string, parquet_row int")
    archive_rows.plan_rows(wanted, f"{tmp_path}/plan", 1000)
    schema = StructType([StructField("band", BinaryType())])
    reader = archive_rows.ArchiveRowReader(schema, {"wanted": f"{tmp_path}/plan"})
    parts = reader.partitions()
    assert len(parts) == 2  # one for each file with wanted rows
    opened, read = Counter(), pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, g, columns=None, **k: opened.update([(self.metadata.num_rows, self.metadata.num_row_groups, g, tuple(columns))]) or read(self, g, columns=columns, **k))
    got = [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()]
    assert sorted(got) == sorted(b"%d" % (i + {"x": 0, "z": 2000}[f]) * 20 for f, i in rows)
    assert set(opened.values()) == {1} and Counter(n for _, n, _, _ in opened) == {1000: 10, 143: 3} and {c for *_, c in opened} == {("band",)}


def test_reads_few_bytes(folder):
    class Counted(io.FileIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.total += len(out)
            return out

    list(archive_rows.picked(f"{folder}/y.parquet", [5, 500], ["band"], lambda url: pa.PythonFile(Counted(url))))
    size = (folder / "y.parquet").stat().st_size
    footer = int.from_bytes((folder / "y.parquet").read_bytes()[-8:-4], "little")
    assert size > 2_000_000 and Counted.total < footer + 80_000


def test_joins_back(spark, folder):
    wanted = spark.createDataFrame([(f"file:{folder}/{f}.parquet", i, i * 2) for f, i in (("x", 9), ("y", 10), ("z", 11), ("z", 11))], "parquet_url string, parquet_row int, tag int")
    images = archive_rows.read_rows(wanted, StructType([StructField("id", LongType())]), portion=5)
    assert sorted((r.id, r.tag, r.parquet_row) for r in readers.rows_of(wanted, images).collect()) == [(9, 18, 9), (1010, 20, 10), (2011, 22, 11), (2011, 22, 11)]
    none = archive_rows.read_rows(wanted.where("tag < 0"), StructType([StructField("id", LongType())]))
    assert none.count() == 0 and none.columns == ["parquet_url", "parquet_row", "id"]


def test_missing_row(spark, folder):
    with pytest.raises(IndexError, match="no row 1000"):
        list(archive_rows.picked(f"{folder}/x.parquet", [1000], ["id"]))


def test_decodes_after_the_join(spark, folder):
    meta = spark.createDataFrame([(f"file://{folder}/x.parquet", 5)], "parquet_url string, parquet_row int")
    images = readers.archive(spark, str(folder), ["band", "id"])
    mark = F.pandas_udf(lambda v: v.map(len), "long")
    plan = readers.read_samples(meta, images, ["band"], [], raster=mark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")


def test_plan_is_read_by_portion(spark, folder, tmp_path, monkeypatch):
    wanted = spark.createDataFrame([(f"{folder}/{f}.parquet", i) for f in "xyz" for i in range(0, 1000, 3)], "parquet_url string, parquet_row int")
    archive_rows.plan_rows(wanted.coalesce(1), f"{tmp_path}/plan", 5)
    reader = archive_rows.ArchiveRowReader(StructType([StructField("id", LongType())]), {"wanted": f"{tmp_path}/plan"})
    parts, taken, own = reader.partitions(), [], pq.ParquetFile.read_row_groups
    monkeypatch.setattr(pq, "read_table", None)  # the whole plan is never read
    monkeypatch.setattr(pq.ParquetFile, "read_row_groups", lambda self, groups, **k: taken.append((self.metadata.num_row_groups, len(groups))) or own(self, groups, **k))
    got = [v for p in parts for b in reader.read(p) for v in b.column(0).to_pylist()]
    assert sorted(got) == [i + k for k in (0, 1000, 2000) for i in range(0, 1000, 3)]
    assert len(taken) == len(parts) > 500 and {n for _, n in taken} == {1} and max(n for n, _ in taken) <= 64


def test_addresses(spark, folder):
    mine = archive_rows.addresses(spark, str(folder), ["id"])
    theirs = readers.archive(spark, str(folder), ["id"])
    plain = lambda df: sorted((archive_rows.uri(r.parquet_url), r.parquet_row, r.id) for r in df.collect())
    assert plain(mine) == plain(theirs) and mine.columns == theirs.columns and mine.count() == 3000


def test_query(spark, sf_dir):
    from quadrille.plans import queries

    assert same(queries.queries()["archive_point_read"](spark, sf_dir), duck(sf_dir), queries.oracle_sql()["archive_point_read"]) is None
    assert np.isfinite(queries.queries()["ivf_pq_batch"](spark, sf_dir).agg(F.sum("score")).first()[0])
