"""Quoted CSV over byte ranges: equal to what was written, whatever lies on a border."""

import csv
import random

import pytest

from garimpo.sources import split_csv, tables

ALPHABET = ["a", "bc", ";", '"', "\n", "\r\n", "é", "日本", " ", '""', ";;", "\n\n"]


def odd_text(r: random.Random, long: bool) -> str:
    return "x" + "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 400 if long else 6))) + "y"


def write(path, rows, end="\r\n", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        out = csv.writer(f, delimiter=";", lineterminator=end)
        out.writerow(["name", "Amount", "note"])
        out.writerows(rows)


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("most", [0, 1000])
def test_records_over_range_borders(spark, tmp_path, small_ranges, end, most):
    r = random.Random(7)
    rows = [(odd_text(r, i % 10 == 0), str(i), odd_text(r, False)) for i in range(400)]
    write(tmp_path / "a.csv", rows[:300], end)
    write(tmp_path / "b.csv", rows[300:], end)
    df = split_csv.read_split_csv(spark, str(tmp_path), broadcast_ranges=most)
    assert df.columns == ["name", "Amount", "note"]
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    whole = tables.read_csv(spark, str(tmp_path), multiline=True)
    assert whole.columns == df.columns
    if end == "\n":  # the whole-file reader rewrites line breaks in texts of files with Windows line ends
        assert sorted(map(tuple, whole.collect())) == sorted(rows)
    assert split_csv.lines_of(spark, str(tmp_path / "a.csv"), "utf-8").rdd.getNumPartitions() > 50


def test_files_without_breaks_in_texts_are_read_without_a_shuffle(spark, tmp_path, small_ranges):
    rows = [(f"n{i}", str(i), "") for i in range(300)]
    write(tmp_path / "a.csv", rows)
    df = split_csv.read_split_csv(spark, str(tmp_path / "a.csv"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in df.collect()] == [(a, b, None) for a, b, _ in rows]


def test_latin_1_bom_short_rows_and_empty_lines(spark, tmp_path):
    write(tmp_path / "l.csv", [("São", "1", "ç\nã")], encoding="latin-1")
    assert [tuple(x) for x in tables.read_csv(spark, str(tmp_path / "l.csv"), encoding="latin-1").collect()] == [
        ("São", "1", "ç\nã")
    ]
    (tmp_path / "b.csv").write_text('﻿A;B\n1;2\n\n3\n""";""";4', encoding="utf-8")
    got = tables.read_csv(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["A", "B"]
    assert [tuple(x) for x in got.collect()] == [("1", "2"), ("3", None), ('";"', "4")]


def test_only_a_header(spark, tmp_path):
    (tmp_path / "h.csv").write_text("A;;A\n")
    got = tables.read_csv(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["A0", "_c1", "A2"] and got.count() == 0


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        tables.read_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "open.csv").write_text('A;B\n1;"2\n3;4\n')
    with pytest.raises(ValueError, match="never ends"):
        tables.read_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "stray.csv").write_text('A;B\n5" pipe;2\n3;4\n')
    with pytest.raises(ValueError, match="never ends"):
        tables.read_csv(spark, str(tmp_path / "stray.csv"))
    assert tables.read_csv(spark, str(tmp_path / "stray.csv"), multiline=True).count() == 2
