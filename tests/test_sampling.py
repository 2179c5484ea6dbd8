"""Bounded samples and the prefilter of the hull."""

import numpy as np
from pyspark.sql import functions as F

from garimpo.operators import geo
from garimpo.schema import lowest_hashes


def test_lowest_hashes_keeps_the_smallest_and_little_more(spark):
    df, h = spark.range(20_000).repartition(200), F.xxhash64("id")
    want = [r[0] for r in df.orderBy(h).limit(300).collect()]
    low = lowest_hashes(df, h, 300)
    assert [r[0] for r in low.orderBy(h).limit(300).collect()] == want
    assert low.count() < 900  # over 200 partitions together


def test_lowest_hashes_of_small_tables(spark):
    assert lowest_hashes(spark.range(5), F.xxhash64("id"), 300).count() == 5
    assert lowest_hashes(spark.range(0), F.xxhash64("id"), 300).count() == 0


def test_hull_prefilter_keeps_all_corners(spark):
    xy = np.random.default_rng(0).normal(size=(3000, 2)).round(2)
    kept = np.array([tuple(r) for r in geo.outside(spark.createDataFrame(xy.tolist(), "x double, y double")).collect()])
    assert len(kept) < 100
    assert {tuple(p) for p in geo.hull_points(kept)} == {tuple(p) for p in geo.hull_points(xy)}
