"""Cleaning, derived columns, sources and sinks on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from garimpo.functions.numbers import parse_number
from garimpo.operators import clean, enrich, kpi, quality
from garimpo.sources import tables


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "text,want",
    [
        (" 1 234,5 ", 1234.5), ("1.234,56", None), ("1.0D", None), ("1f", None), ("NaN", None), ("", None),
        ("-3", -3.0), ("5.", 5.0), (".5", 0.5), ("1e3", 1000.0), ("abc", None), (None, None),
        ("\t12,25 ", 12.25), ("+7", 7.0), ("1_000", None), ("0x10", None),
    ],
)
def test_numbers(spark, text, want):
    assert one(spark, text, parse_number) == want


@pytest.mark.parametrize(
    "text,default,strict",
    [
        ("ALMEIDA'S MINERAÇÃO LTDA.", "ALMEIDAS MINERAÇÃO LTDA.", "ALMEIDAS MINERAÇÃO LTDA."),
        ("MINERADORA B S.A.", "MINERADORA B S.A.", "MINERADORA B S.A.."),
        ("VALE SA", "VALE S.A.", "VALE S.A."),
        ("MINA S.A", "MINA S.A.", "MINA S.A."),
        ("MINA SA LTDA", "MINA S.A.", "MINA S.A."),
        ("ÁGUA & CIA ME", "ÁGUA  CIA ME", "ÁGUA  CIA ME"),
        ("PEDRAS-RARAS EPP", "PEDRAS-RARAS EPP", "PEDRAS-RARAS EPP"),
        ("CASA SABIÁ", "CASA SABIÁ", "CASA SABIÁ"),
    ],
)
def test_company_names(spark, text, default, strict):
    assert one(spark, text, lambda c: clean.company_name(c)) == default
    assert one(spark, text, lambda c: clean.company_name(c, strict=True)) == strict


def test_headers_are_merged(spark):
    df = spark.createDataFrame([("MG", None, 1.0), (None, "PA", 2.0)], " Uf string, Estado string, `valor_cfem` double")
    out = clean.normalise_headers(df)
    assert out.columns == ["ESTADO", "CFEM"]
    assert [tuple(r) for r in out.orderBy("CFEM").collect()] == [("MG", 1.0), ("PA", 2.0)]


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "Titular string, Municipio string, UF string, Substancia string, LONGITUDE string, LATITUDE string, CFEM string, DATA string"
    )


ROW = ("Vale S.A.", "Mariana ", "minas gerais", "ferro", "-43,4", "-20.3", "1000,50", "03/04/2024")


def changed(**values):
    names = ["titular", "municipio", "uf", "substancia", "lon", "lat", "cfem", "data"]
    return tuple(values.get(n, v) for n, v in zip(names, ROW))


def test_clean_end_to_end(spark):
    rows = [
        ROW, changed(lon="-74", lat="6"), changed(lon="-74,1"), changed(lat=None), changed(cfem="0"), changed(cfem="x"),
        changed(uf="XX"), changed(uf=None), changed(data="13/13/2024"), changed(data="2024-04-03"), changed(titular=None),
    ]
    out = clean.clean(raw(spark, rows)).orderBy("LONGITUDE", "DATA").collect()
    assert len(out) == 5
    assert {r.ESTADO for r in out} == {"MG"}
    assert sum(r.DATA is None for r in out) == 2
    first = [r for r in out if r.DATA is not None][0]
    assert (first.DATA.day, first.DATA.month) == (3, 4)
    assert out[0]["MUNICIPIO(S)"] == "MARIANA" and not any(r.CFEM_OUTLIER for r in out)
    token = clean.clean(raw(spark, rows), null_token="NAN").where("TITULAR = 'NAN'").count()
    assert token == 1 and sum(r.TITULAR is None for r in out) == 1


def test_outliers_are_judged_before_the_state_filter(spark):
    rows = [changed(cfem=str(v)) for v in (10, 11, 12, 13)] + [changed(cfem="1000"), changed(cfem="9999", uf="XX")]
    out = clean.clean(raw(spark, rows))
    # quartiles of all six amounts: 11.25 and 753.25; the fence is wide because of the dropped row
    assert {r.CFEM: r.CFEM_OUTLIER for r in out.collect()} == {10.0: False, 11.0: False, 12.0: False, 13.0: False, 1000.0: False}
    alone = clean.clean(raw(spark, rows[:5]))
    assert [r.CFEM for r in alone.where("CFEM_OUTLIER").collect()] == [1000.0]


def test_literal_rows(spark):
    df = enrich.enrich(clean.clean(tables.literal_operations(spark)))
    assert df.count() == 9
    bands = {r.CFEM_FAIXA for r in df.collect()}
    assert bands == {"Até 10K", "10K-100K", "100K-1M", "1M-10M", "Acima 10M"}
    assert {r.ESTADO: r.DENSIDADE_ESTADO for r in df.collect()}["MG"] == 5
    row = quality.geographic_consistency(df).first()
    assert row.total_com_coordenadas == 9 and row.inconsistencias_geograficas >= 1
    assert kpi.basic_kpis(df).first().total_empresas == 9


def test_band_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 10000.0, 10000.01, 100000.0, 1e7, 1.1e7, None)], "v double")
    got = [r.b for r in df.select(enrich.amount_band(F.col("v")).alias("b")).collect()]
    assert got == [None, None, "Até 10K", "10K-100K", "10K-100K", "1M-10M", "Acima 10M", None]


def test_unknown_state_keeps_its_count_and_has_no_region(spark):
    df = spark.createDataFrame([("ZZ", "A", "X", 1.0)] * 3 + [(None, "A", "Y", 1.0)], "ESTADO string, TITULAR string, PRIMEIRODESUBS string, CFEM double")
    out = enrich.enrich(df).orderBy("ESTADO").collect()
    assert [r.DENSIDADE_ESTADO for r in out] == [None, 3, 3, 3]
    assert all(r.REGIAO is None and r.DIVERSIFICACAO_EMPRESA == 2 for r in out)


def test_quality_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([("A", None, 1.0), ("A", None, 1.0), (None, 2.0, 1.0), (None, 2.0, 3.0)], "TITULAR string, LONGITUDE double, LATITUDE double")
    assert tuple(quality.duplicates(df).first()) == (1, 2, 1)
    assert {r.column: r.pct for r in quality.completeness(df).collect()} == {"TITULAR": 50.0, "LONGITUDE": 50.0, "LATITUDE": 100.0}


def test_csv_json_round_trip(spark, tmp_path):
    df = tables.literal_operations(spark)
    tables.write_csv(df, f"{tmp_path}/csv")
    back = tables.read_csv(spark, f"{tmp_path}/csv", sep=",")
    assert back.columns == df.columns and {t for _, t in back.dtypes} == {"string"}
    assert clean.clean(back).count() == 9
    tables.write_json(df, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 9


def test_contract_and_sample(spark):
    sample = tables.sample_operations(spark, 2000)
    assert tables.check_contract(sample).first().is_valid
    assert tables.check_contract(sample.drop("CFEM")).first().missing == ["CFEM"]
    row = sample.select(F.avg(F.ln("CFEM")).alias("m"), F.stddev(F.ln("CFEM")).alias("s"), F.countDistinct("ESTADO").alias("e")).first()
    assert row.m == pytest.approx(10, abs=0.2) and row.s == pytest.approx(2, abs=0.1) and row.e == 8


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").withColumnsRenamed({"s_name": "TITULAR", "s_acctbal": "CFEM"})
    plan = kpi.select_rows(df, low=10.0, company="Supplier#000000001").select("TITULAR")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s_acctbal), IsNotNull(s_name), GreaterThanOrEqual(s_acctbal,10.0), EqualTo(s_name" in plan
    assert "s_nationkey" not in plan
