"""Buckets of vectors against Spark's own ntile, without its single task."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoterra.operators import similarity


@pytest.mark.parametrize("n", [0, 3, 5, 52])
def test_buckets_equal_ntile_without_one_task(spark, n):
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 3)]) for i in range(n)], "id long, vec array<double>")
    got = similarity.ntile_buckets(v, 2, 5)
    assert "ntile(" not in got._jdf.queryExecution().toString()
    centre = similarity.mean_vector(v, 2)
    d = F.round(1 - similarity.cosine(F.col("vec"), F.array(*[F.lit(x) for x in centre])), 9)
    want = v.withColumn("bucket", F.ntile(5).over(Window.orderBy(d, "id"))).groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
