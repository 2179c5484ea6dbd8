"""Exports of many tables that are whole or absent: every run has a folder, its manifest comes last.

While a table is written its rows are counted and summed up as an order-free checksum. The manifest
is one file, written when all tables are; a run without it is unfinished and never read. The reader
counts and sums again before it hands a table out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.sources.split_csv import read_split_csv
from garimpo.sources.tables import MOMENTS, write_csv, write_json

MANIFEST = "`table` string, format string, rows bigint, checksum string, schema string"
TIMES = {"timestampFormat": MOMENTS}


def figures(df: DataFrame) -> list[Column]:
    """``rows`` and ``checksum`` as aggregates: the sum of row hashes, the same in any order, copies counted."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), TIMES)
    return [F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum")]


def flat(results: dict, prefix: str = "") -> dict[str, DataFrame]:
    """Tables of a nested result under ``outer/inner`` names; models and scalars are left out."""
    out: dict[str, DataFrame] = {}
    for name, value in results.items():
        if isinstance(value, dict):
            out |= flat(value, f"{prefix}{name}/")
        elif isinstance(value, DataFrame):
            out[f"{prefix}{name}"] = value
    return out


def as_csv(schema: T.StructType) -> bool:
    return not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for f in schema)


def export_run(results: dict, path: str, csv: Sequence[str] = (), workers: int = 4) -> str:
    """Write all tables of ``results`` below ``path`` and return the name of the run.

    Tables named in ``csv`` become CSV, the others JSON lines; a CSV table holds plain columns only.
    Up to ``workers`` tables are written at a time. If one fails the error is raised, no
    manifest is written, and earlier runs stay what is read. An empty table keeps its schema in the manifest.
    """
    tables = flat(results)
    if not tables:
        raise ValueError("no table to export")
    for name in csv:
        if name in tables and not as_csv(tables[name].schema):
            raise ValueError(f"{name} has nested or binary columns, which CSV cannot hold")
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"
    spark = next(iter(tables.values())).sparkSession

    def write(name: str) -> tuple:
        df, seen = tables[name], Observation()
        kind, writer = ("csv", write_csv) if name in csv else ("json", write_json)
        writer(df.observe(seen, *figures(df)), f"{path}/{run}/{name}")
        return name, kind, seen.get["rows"], seen.get["checksum"], df.schema.json()

    with ThreadPoolExecutor(workers) as pool:
        written = list(pool.map(inheritable_thread_target(spark)(write), tables))
    spark.createDataFrame(written, MANIFEST).coalesce(1).write.json(f"{path}/{run}/_manifest")
    return run


def manifest(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """``run, table, format, rows, checksum, schema`` of a run, by default of the last finished one."""
    listed = spark.read.schema(MANIFEST).json(f"{path}/{run or '*'}/_manifest").withColumn(
        "run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    )
    return listed.where(F.col("run") == listed.agg(F.max("run").alias("run")).scalar())


def read_export(spark: SparkSession, path: str, run: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a finished run with their types; ``ValueError`` names those that differ from the manifest."""
    out: dict[str, DataFrame] = {}
    told = {r["table"]: r for r in manifest(spark, path, run).collect()}  # a row per table
    for name, r in told.items():
        schema, target = T.StructType.fromJson(json.loads(r["schema"])), f"{path}/{r['run']}/{name}"
        if not r["rows"]:
            out[name] = spark.createDataFrame([], schema)
        elif r["format"] == "csv":
            text = read_split_csv(spark, target, sep=",", keep_empty=True).toDF(*schema.names)
            out[name] = text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        else:
            out[name] = spark.read.options(**TIMES).schema(schema).json(target)
    if verify:
        def differs(name: str) -> bool:
            now = out[name].agg(*figures(out[name])).first()
            return (now["rows"], now["checksum"]) != (told[name]["rows"], told[name]["checksum"])

        with ThreadPoolExecutor(4) as pool:
            bad = [n for n, d in zip(out, pool.map(inheritable_thread_target(spark)(differs), out)) if d]
        if bad:
            raise ValueError(f"not as they were written: {', '.join(sorted(bad))}")
    return out
