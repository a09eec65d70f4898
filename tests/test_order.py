"""Order statistics against sorting."""

import random

import numpy as np
from pyspark.sql import functions as F

from candlewright.operators import order


def test_places_equal_sorting(spark):
    rng = random.Random(2)
    data = [(("a", "a", "a", "b", None)[i % 5], rng.choice([1.0, 2.0, 2.5, rng.random() * 100, None])) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, v double")
    for most in (1_000_000, 20):
        found = order.at_places(rows, ["g"], "v", lambda n: F.array(F.lit(0), F.floor(n / 2), n - 1, n), most=most)
        assert found.count() == 3
        for r in found.collect():
            own = sorted(v for g, v in data if g == r.g and v is not None)
            assert r.n == len(own) and r.at == {0: own[0], len(own) // 2: own[len(own) // 2], len(own) - 1: own[-1]}


def test_one_value_for_most_rows(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(7.0).alias("v"))
    own = np.array([float(i) if i % 10 == 0 else 7.0 for i in range(5000)])
    got = order.quantiles(rows, [], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    assert [got.n, got.p10, got.p50, got.p99] == [5000, *np.percentile(own, [10, 50, 99])]
    assert order.quantiles(rows.limit(0), [], "v", {"p": 0.5}).count() == 0


def test_ranked_splits_equal_values(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).cast("double").alias("v")).repartition(4)
    data = sorted(((5.0 if i % 3 == 0 else None if i % 7 == 0 else float(i % 50)), i) for i in range(4000) if i % 3 == 0 or i % 7) + [(None, i) for i in range(4000) if i % 3 and i % 7 == 0]
    want = {i: k + 1 for k, (v, i) in enumerate(sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1])))}
    assert {r.id: r.place for r in order.ranked(rows, "v", "id").collect()} == want
