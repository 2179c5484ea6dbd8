"""Plans whose parts may fail: guards, errors, prerequisites, small and odd tables."""

import pytest
from pyspark.sql import functions as F

from garimpo.operators import insights, runner
from garimpo.operators.runner import Part, run_plan

SCHEMA = "op_id long, TITULAR string, PRIMEIRODESUBS string, ESTADO string, `MUNICIPIO(S)` string, CFEM double, LONGITUDE double, LATITUDE double"


def rows(spark, n):
    return spark.createDataFrame(
        [(i, f"C{i % 3}", f"S{i % 2}", "MG" if i % 2 else "PA", f"M{i}", 10.0 * i + 1, -50.0 + i, -20.0 + i % 4) for i in range(n)], SCHEMA
    )


def ends(tables):
    return {r["part"]: r["status"] for r in tables["status"].collect()}


def test_an_error_ends_its_part_and_those_that_need_it(spark):
    def bad(df, got):
        return {"t": df.select(F.raise_error(F.lit("no")).alias("x"))}

    def good(df, got):
        return {"n": df.agg(F.count("*").alias("n")), "_kept": 7}

    def tolerant(df, got):
        return {"v": df.sparkSession.range(got["_kept"]), "found": df.sparkSession.range(int("t" in got))}

    plan = [
        Part("bad", bad), Part("good", good), Part("after_bad", good, after=("bad",)),
        Part("after_all", tolerant, after=("bad", "good"), tolerant=True), Part("few", good, ("a",), 4),
        Part("absent", good, ("b",)),
    ]
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("nan"),)], "a double")
    for workers in (1, 4):
        out = run_plan(df, plan, workers)
        assert ends(out) == {
            "bad": "failed", "good": "ok", "after_bad": "skipped", "after_all": "ok", "few": "too few rows",
            "absent": "missing column",
        }
        status = {r["part"]: r for r in out["status"].collect()}
        assert (status["few"]["rows"], status["absent"]["rows"], status["good"]["rows"]) == (3, None, 5)
        assert status["absent"]["message"] == "b" and status["after_bad"]["message"] == "needs bad"
        assert sorted(out) == ["found", "n", "status", "v"]
        assert out["v"].count() == 7 and out["found"].count() == 0


def test_plans_are_in_order(spark):
    with pytest.raises(ValueError):
        run_plan(spark.range(1), [Part("a", None, after=("b",)), Part("b", None)])
    with pytest.raises(ValueError):
        run_plan(spark.range(1), [Part("a", None), Part("a", None)])


def test_three_rows_give_a_status_for_each_part(spark):
    out = insights.analysis(rows(spark, 3), trees=2, restarts=2)
    got = ends(out)
    assert [got[p] for p in ("clustering", "density_clustering", "components", "anomalies", "predictions")] == ["too few rows"] * 5
    assert got["time_series"] == "missing column" and got["market"] == got["insights"] == "ok"
    fact = out["insights"].first()
    assert fact["optimal_clusters"] is None and fact["anomaly_rate"] is None and fact["concentration_level"]
    got = ends(insights.spatial_analysis(rows(spark, 3)))
    assert got["hotspots"] == got["autocorrelation"] == "too few rows" and got["executive_summary"] == "skipped"
    assert got["clustering"] == got["distribution"] == got["territory"] == "ok"


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single_row_tables_survive(spark, n):
    got = ends(insights.analysis(rows(spark, n), trees=2, restarts=2))
    assert got["clustering"] == "too few rows" and got["market"] == ("ok" if n else "too few rows")
    assert "failed" not in ends(insights.spatial_analysis(rows(spark, n))).values()


def test_enough_rows_end_well_and_equal_the_plain_report(spark):
    df = rows(spark, 30).withColumn("DATA", F.expr("date_add(date'2020-01-01', cast(op_id * 20 as int))"))
    out = insights.analysis(df, trees=2, restarts=2)
    assert set(ends(out).values()) == {"ok"}, out["status"].collect()
    plain = insights.comprehensive(df, trees=2, restarts=2)
    assert set(out) == set(plain) | {"status"}
    assert out["market_concentration"].collect() == plain["market_concentration"].collect()


def test_guards_by_group(spark):
    df = rows(spark, 12).withColumn("CFEM", F.when(F.col("ESTADO") == "MG", F.col("CFEM")))
    got = {(r["ESTADO"], r["part"]): (r["status"], r["rows"]) for r in runner.guard_status(
        df, [Part("a", None, ("CFEM",), 5), Part("b", None, ("x", "y"))], "ESTADO").collect()}
    assert got == {
        ("MG", "a"): ("ok", 6), ("PA", "a"): ("too few rows", 0), ("MG", "b"): ("missing column", None),
        ("PA", "b"): ("missing column", None),
    }
