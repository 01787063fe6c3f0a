"""Passes of queries follow the number of queries, not of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from tierscope.llm import neighbours


@pytest.mark.parametrize(("most", "want"), [(1 << 20, 3), (40 * 8 * 8, 10)])
def test_passes_do_not_follow_partitions(spark, most, want):
    rng = random.Random(7)
    rows = [(i, [rng.random() for _ in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts in (1, 4, 64):
        asked, passes = neighbours.in_passes(df.repartition(parts), block=20, query_blocks=8, most=most)
        of = asked.withColumn("n", F.octet_length("ids") / 8).groupBy("pass").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()
        assert passes == len(of) == want and sum(r.n for r in of) == 400
        assert max(r.n for r in of) <= 400 / want + parts and all(r.blocks == -(-r.n // 20) for r in of)


def test_many_partitions_and_passes_find_the_same(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, many = (sorted(map(tuple, neighbours.nearest(df.repartition(p), k=3, every=10, block=4, query_blocks=b).collect())) for p, b in ((1, 99), (16, 2)))
    assert one == many and len(one) == 90
