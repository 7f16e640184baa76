"""Nearest neighbours where one bucket is hot: slices of vectors and of queries lose no neighbour."""

import numpy as np
from pyspark.sql import functions as F

from quadrille.llm.ann import search


def test_slices_change_nothing(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    x[:40] = x[0]  # a third of the rows are copies of one vector
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = [
        sorted(tuple(r) for r in search(vectors, F.col("id") % 5 == 0, k=7, tables=2, cell_rows=n).select("query_id", "rank", "vec_id", "score").collect())
        for n in (15, 8192)
    ]
    assert found[0] == found[1] and len(found[0]) == 24 * 7
    copies = {q: [v for p, _, v, _ in found[0] if p == q] for q in (0, 5)}
    assert len(set(copies[0])) == 7 and all(r[0] != r[2] for r in found[0])
