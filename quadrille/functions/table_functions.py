"""Table functions for SQL: several rows for each row of a table, by LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StructField, StructType

from quadrille.operators.fragments import FragmentPlan

FRAGMENT = StructType([StructField(n, IntegerType()) for n in ("frag_row", "frag_col", "y_offset", "x_offset", "size")])


@udtf
class Fragments:
    """fragments(height, size, overlap): a row for each fragment of an image; none where height or size is null, or the
    image is smaller than a fragment. `overlap` is a constant."""

    def __init__(self):
        self.plans: dict[tuple, FragmentPlan] = {}

    @staticmethod
    def analyze(height: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        for name, argument in (("height", height), ("size", size)):
            if not isinstance(argument.dataType, IntegerType):
                raise TypeError(f"{name} is a whole number, not {argument.dataType.simpleString()}")
        if not overlap.isConstantExpression:
            raise TypeError("overlap is a constant")
        return AnalyzeResult(schema=FRAGMENT)

    def eval(self, height, size, overlap):
        if height is None or size is None or height < size:
            return
        key = (height, size, float(overlap))
        if key not in self.plans:
            self.plans[key] = FragmentPlan(*key)
        offsets = self.plans[key].offsets
        for i, y in enumerate(offsets):
            for j, x in enumerate(offsets):
                yield i, j, y, x, size


def register(spark: SparkSession) -> None:
    spark.udtf.register("fragments", Fragments)
