"""Passes over many rows: enough tasks whatever the files, ties as before."""

import numpy as np
from pyspark.sql import functions as F

from garimpo.operators import cluster
from garimpo.schema import stage


def test_points_of_one_file_are_spread_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TASK_ROWS", 100)
    points = stage(spark.range(450).select(F.col("id").cast("double").alias("z")).coalesce(1))
    parts = cluster.spread(points)
    assert parts.rdd.getNumPartitions() == 4 and parts.agg(F.sum("z")).first()[0] == 449 * 225
    monkeypatch.setattr(cluster, "TASK_ROWS", 1000)
    assert cluster.spread(points) is points


def test_the_first_of_equally_near_centres_takes_the_row():
    near, best = cluster.nearest(np.array([[3.0, 1.0, 2.0], [3.0, 0.0, 2.0], [1.0, 0.0, 2.0]]))
    assert near.tolist() == [2, 1, 0] and best.tolist() == [1.0, 0.0, 2.0]


def test_points_of_crowded_cells_are_not_counted_one_by_one(spark, monkeypatch):
    """Two crowds and one lone point: only the lone point asks for its neighbours."""
    rows = [(i, (i % 50) * 1e-4 + (5.0 if i >= 50 else 0.0)) for i in range(100)] + [(100, 2.5)]
    asked = []
    real = cluster.neighbour_aggregate
    monkeypatch.setattr(cluster, "neighbour_aggregate", lambda left, *a, **o: asked.append(left.count()) or real(left, *a, **o))
    got = {r.id: r.cluster for r in cluster.dbscan(spark.createDataFrame(rows, "id long, x double"), ["x"], 1.0, 3).collect()}
    assert asked == [1, 1]
    assert [got[i] for i in (0, 49, 50, 99, 100)] == [0, 0, 1, 1, -1]


def test_cells_that_are_known_to_touch_are_not_refined(spark, monkeypatch):
    from garimpo.operators import neighbours

    monkeypatch.setattr(neighbours, "COMPARED_PAIRS", 1)
    points = stage(spark.range(400).select((F.col("id") / 200.0).alias("x")))  # evenly in [0, 2), cells of side 1
    whole = neighbours.frontier(points, points, ["x"], 1.0, side=1.0, ordered=False, same_points=True)
    less = neighbours.frontier(points, points, ["x"], 1.0, side=1.0, ordered=False, same_points=True, any_pair=True)
    assert len(less.inside) + len(less.compare) < len(whole.inside) + len(whole.compare)
    assert [tuple(r) for r in neighbours.touching_cells(points, ["x"], 1.0, 1.0).collect()] == [(0, 1)]
