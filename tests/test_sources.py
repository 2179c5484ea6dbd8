"""CSV round trips, sums of odd amounts, ordered insights."""

import pytest
from pyspark.sql import functions as F

from garimpo.functions.numbers import total
from garimpo.operators import insights
from garimpo.sources import tables

ROWS = [('EMPRESA "X"; FILIAL', "1"), ("two\nlines", "2"), ("comma, here", "3"), ("plain", "4")]


def test_csv_keeps_quotes_separators_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "TITULAR string, CFEM string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), sep=",")
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)


def test_csv_reads_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('TITULAR;CFEM\n"EMPRESA ""X""; FILIAL";10\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [('EMPRESA "X"; FILIAL', "10")]


def test_csv_columns_in_any_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TITULAR;CFEM\nA;1\n")
    (tmp_path / "b.csv").write_text("CFEM;TITULAR\n2;B\n")
    got = tables.read_csv_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["TITULAR"], r["CFEM"]) for r in got.collect()) == [("A", "1"), ("B", "2")]
    with pytest.raises(Exception, match="CSV header does not conform|HEADER"):
        tables.read_csv(spark, str(tmp_path)).collect()


def test_total_rounds_nothing_and_does_not_overflow(spark):
    def summed(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(total("v")).first()[0]

    assert summed(1e-7, 4e-7) == pytest.approx(5e-7)
    assert summed(1e-15, 2e-15) == pytest.approx(3e-15)
    assert summed(2e18, 1.0) == pytest.approx(2e18)
    assert summed(None) is None
    assert summed(0.1, 0.2, 0.3) == 0.6


def test_all_recommendations(spark):
    facts = spark.createDataFrame(
        [("Mercado altamente concentrado", 11.0, 0.6, 6, "all"), ("", 10.0, 0.5, 5, "none")],
        "concentration_level string, anomaly_rate double, regional_dominance double, optimal_clusters int, k string",
    )
    got = {r["k"]: len(r["recommendations"]) for r in insights.recommendations(facts, "k").collect()}
    assert got == {"all": 4, "none": 0}
