"""Joins whose result is far larger than their inputs are dealt to many tasks, and give the rows of a plain join."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators.metadata import crowded_join, tiled_join
from quadrille.plans import queries as plans

QUERIES = plans.queries()


@pytest.mark.parametrize("join", [crowded_join, tiled_join, lambda *a: tiled_join(*a, tile=8)])
def test_rows_of_a_plain_join(spark, join):
    left = spark.createDataFrame([(i % 3 if i % 7 else None, "x", i) for i in range(300)], "k int, m string, a long")
    right = spark.createDataFrame([(i % 4 if i % 5 else None, "x" if i % 6 else None, i) for i in range(90)] * 2, "k int, m string, b long")
    found, plain = (sorted(df.select("k", "m", "a", "b").collect()) for df in (join(left, right, ["k", "m"]), left.join(right, ["k", "m"])))
    assert len(plain) > 2000 and found == plain
    assert join(left.limit(0), right, ["k", "m"]).isEmpty()


def test_right_rows_repeat_in_one_order(spark):
    left, right = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("a")), spark.range(504).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    rows = tiled_join(left, right, ["k"]).select("a", "b").collect()
    runs = [rows[i : i + 504] for i in range(0, len(rows), 504)]
    assert len(runs) == 40 and all(len({r.a for r in run}) == 1 for run in runs) and len({tuple(r.b for r in run) for run in runs}) == 1


@pytest.mark.parametrize("name", ["samples_at_points", "archive_row_join"])
def test_dealt_to_many_tasks(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert found.rdd.getNumPartitions() >= 100  # one or two before, whatever the result's size
