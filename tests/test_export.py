"""Exports with a manifest: types and texts come back, what is damaged or unfinished is not read."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from garimpo.sources import export

PLAIN = [
    (1, ' a "quoted";\ntext, ', 0.1, True, dt.date(2020, 2, 29), dt.datetime(2020, 1, 1, 1, 2, 3, 456789)),
    (2, "", float("nan"), None, None, None), (3, None, 1e300, False, dt.date(1999, 1, 1), None), (3, None, 1e300, False, dt.date(1999, 1, 1), None),
]
PLAIN_SCHEMA = "k long, t string, v double, b boolean, d date, m timestamp"


@pytest.fixture
def results(spark):
    plain = spark.createDataFrame(PLAIN, PLAIN_SCHEMA)
    nested = spark.createDataFrame([(["a", None], {"x": 1}), ([], None)], "l array<string>, s struct<x: int>")
    return {"rows": plain, "outer": {"nested": nested, "plain": plain, "none": plain.where("k > 9"), "model": object()}, "n": 3}


def texts(df):
    return sorted(repr(r) for r in df.collect())


def test_every_table_comes_back(spark, tmp_path, results):
    run = export.export_run(results, str(tmp_path), csv=["rows"])
    back = export.read_export(spark, str(tmp_path))
    assert sorted(back) == ["outer/nested", "outer/none", "outer/plain", "rows"]
    assert texts(back["rows"]) == texts(back["outer/plain"]) == texts(results["rows"])
    assert texts(back["outer/nested"]) == texts(results["outer"]["nested"])
    assert back["outer/none"].schema == results["rows"].schema and back["outer/none"].count() == 0
    assert {r["table"]: r["rows"] for r in export.manifest(spark, str(tmp_path), run).collect()} == {
        "rows": 4, "outer/plain": 4, "outer/nested": 2, "outer/none": 0}


def test_damage_is_found(spark, tmp_path, results):
    run = export.export_run(results, str(tmp_path), csv=["rows"])
    part = max(glob.glob(f"{tmp_path}/{run}/outer/plain/part-*"), key=os.path.getsize)
    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    assert os.path.exists(crc)
    os.remove(crc)
    text = open(part).read()
    open(part, "w").write(text.replace('"k":', '"k":9', 1))
    with pytest.raises(ValueError, match="not as they were written: outer/plain$"):
        export.read_export(spark, str(tmp_path))
    assert len(export.read_export(spark, str(tmp_path), verify=False)) == 4


def test_a_failed_run_leaves_the_one_before(spark, tmp_path, results):
    first = export.export_run(results, str(tmp_path))
    bad = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        export.export_run({"rows": results["rows"], "bad": bad}, str(tmp_path))
    assert {r["run"] for r in export.manifest(spark, str(tmp_path)).collect()} == {first}
    second = export.export_run({"rows": results["rows"]}, str(tmp_path))
    assert sorted(export.read_export(spark, str(tmp_path))) == ["rows"] and second > first
    assert len(export.read_export(spark, str(tmp_path), first)) == 4


def test_nested_columns_are_no_csv(spark, tmp_path, results):
    with pytest.raises(ValueError, match="nested"):
        export.export_run(results["outer"], str(tmp_path), csv=["nested"])
    with pytest.raises(ValueError, match="no table"):
        export.export_run({"n": 3}, str(tmp_path))
