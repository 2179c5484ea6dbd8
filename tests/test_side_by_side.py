"""Parts of a report and radii of a search run side by side and give what they gave one by one."""

from threading import Barrier

import pytest
from pyspark.sql import functions as F

from garimpo.operators import charts, cluster, insights
from garimpo.operators.runner import Part
from garimpo.plans.base import enriched_rows
from tests.conftest import SMALL


def test_parts_are_built_together_and_in_order(spark):
    together = Barrier(3, timeout=60)

    def part(name):
        def build(df, got):
            together.wait()  # breaks unless all three are being built
            return {name: df.agg(F.count("*").alias(name)), f"_{name}": 1}

        return build

    parts = [Part(n, part(n)) for n in "cab"]
    parts.append(Part("last", lambda df, got: {"last": df.select(F.lit(got["_a"] + got["_c"]).alias("x")).limit(1)}, after=("a", "c")))
    out = insights.build_all(spark.range(7), parts)
    assert list(out) == ["c", "a", "b", "last"] and out["a"].first().a == 7 and out["last"].first().x == 2


def test_an_error_of_a_part_is_raised(spark):
    def fails(df, got):
        raise ValueError("no such thing")

    parts = [Part("bad", fails), Part("after", lambda df, got: {"x": df}, after=("bad",))]
    with pytest.raises(ValueError, match="no such thing"):
        insights.build_all(spark.range(3), parts)


def test_radii_are_tried_together(spark, monkeypatch):
    """Which radii are tried, at what width, with the noise of each told in advance."""
    df = spark.range(4).select(F.col("id").alias("op_id"), *[F.col("id").cast("double").alias(c) for c in ("CFEM", "LONGITUDE", "LATITUDE")])
    radii, tried = tuple(round(0.1 * i, 1) for i in range(1, 20)), []
    for least in (0.1, 0.7, 1.9, 9.0):

        def told(points, axes, eps, *rest, **more):
            tried.append(eps)
            return points.select("id", F.lit(0 if eps >= least else cluster.NOISE).cast("bigint").alias("Cluster_DBSCAN"))

        monkeypatch.setattr(cluster, "dbscan", told)
        tried.clear()
        row = cluster.dbscan_search(df, radii=radii)["summary"].first()
        # one cluster ends the walk at the first radius without noise, so there is no candidate
        assert (row.eps, row.silhouette_score) == (0.5, 0.0)
        assert len(tried) == len(set(tried)) <= 9 and (least in tried) == (least < 2)


def test_timeline_of_two_dashboards_is_made_once(spark):
    rows = enriched_rows(spark, SMALL)
    bundles = insights.chart_bundles(rows)
    line = bundles["executive"]["timeline"]
    assert line is bundles["advanced"]["timeline"] and not set(line.inputFiles()) & set(rows.inputFiles())


def test_results_are_written_together(spark, tmp_path, monkeypatch):
    together, write = Barrier(2, timeout=60), insights.write_json
    monkeypatch.setattr(insights, "write_json", lambda *args: (together.wait(), write(*args)))
    results = {"b": {"x": spark.range(3)}, "a": spark.range(2), "model": 5}
    assert insights.export_results(results, str(tmp_path)) == [f"{tmp_path}/b/x", f"{tmp_path}/a"]
    assert spark.read.json(f"{tmp_path}/b/x").count() == 3 and spark.read.json(f"{tmp_path}/a").count() == 2


def test_tree_reads_rows_once_per_state(spark):
    rows = [("N", "PA", 1.5), ("N", "PA", None), ("N", "AM", 1e25), ("S", "RS", None), (None, "MG", 3.0)]
    tree = charts.region_state_tree(spark.createDataFrame(rows, "REGIAO string, ESTADO string, CFEM double"))
    found = {(r.REGIAO, r.ESTADO): (r.CFEM_TOTAL, r.NUM_OPERACOES) for r in tree.collect()}
    assert found == {
        ("N", "PA"): (1.5, 1), ("N", "AM"): (1e25, 1), ("S", "RS"): (None, 0), ("N", None): (1e25, 2), ("S", None): (None, 0),
        (None, None): (1e25, 2),
    }
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Expand")[1]  # below the copies of the levels
