"""Quoted CSV read by many tasks, although a quoted text may hold line breaks.

Spark cuts a file into byte ranges and gives each line to the range in which it begins. Whether a
line break ends a record depends on the quotes before it, so two passes run: the first counts the
quotes of every range, whose running parity tells which ranges begin inside a quoted text; the
second joins the lines of each record. Records that cross a border leave one fragment in each of
their ranges; only fragments are shuffled. The fields are then parsed by Spark.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.schema import stage

#: Encodings in which the bytes of line ends and quotes mean nothing else and Spark decodes on its own.
SPLITTABLE = {"utf-8": None, "utf8": None, "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1"}
BOM = "﻿"
#: Ranges that begin inside a quoted text are sent to all tasks up to this many (24 bytes each).
BROADCAST_RANGES = 500_000
WHOLE, OPENING, FOLLOWING = 0, 1, 2
PLACE = ["file", "block", "file_name"]


def lines_of(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """``value`` per line with its file (hashed), the start of its byte range and whether its quotes are odd."""
    charset = SPLITTABLE[encoding.lower()]
    value = F.decode(F.col("value").cast("binary"), charset) if charset else F.col("value")
    return spark.read.option("lineSep", "\n").text(path).select(
        value.alias("value"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_path").alias("file_name"),
    ).withColumn("odd", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)


def column_names(header: str, sep: str) -> list[str]:
    """Names in a header line; an empty one becomes ``_c<position>``, repeated ones get their position."""
    names = next(csv.reader([header], delimiter=sep))
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def plain_header(line: str) -> str:
    return line.removeprefix(BOM).removesuffix("\r")


def assemble(header: str):
    """Task code: lines of byte ranges, in order, to records and fragments without the header lines."""
    schema = pa.schema(
        [("record", pa.string()), ("kind", pa.int32()), ("file", pa.int64()), ("block", pa.int64()), ("at", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        held: list[str] = []  # lines of the record that is open, or of the one the range began in
        inside = begun_inside = False

        def fragment() -> list[tuple]:
            return [("\n".join(held), FOLLOWING if begun_inside else OPENING, *place, 0 if begun_inside else 1)] if held else []

        for batch in batches:
            rows: list[tuple] = []
            values = batch.column("value").to_pylist()
            odd = batch.column("odd").to_numpy(zero_copy_only=False)
            file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block"))
            changes = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            for start, end in zip([0, *changes], [*changes, len(values)]):
                if start == end:
                    continue
                here, first = (int(file[start]), int(block[start])), start
                if here != place:
                    rows += fragment()
                    place, held = here, []
                    inside = begun_inside = bool(batch.column("begins_inside")[start].as_py())
                    if place[1] == 0:
                        if plain_header(values[start]) != header:
                            raise ValueError(f"CSV header does not conform: {values[start]!r} instead of {header!r}")
                        first += 1
                for i in range(first, end):
                    if odd[i]:
                        inside = not inside
                    if inside:
                        held.append(values[i])
                    elif held or begun_inside:
                        held.append(values[i])
                        if begun_inside:
                            rows += fragment()
                            begun_inside = False
                        else:
                            rows.append(("\n".join(held), WHOLE, *place, 0))
                        held = []
                    else:
                        rows.append((values[i], WHOLE, *place, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if rows := fragment() if place else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


RECORDS = "record string, kind int, file bigint, block bigint, at bigint"


def in_order(lines: DataFrame, ranges: DataFrame, broadcast: bool) -> DataFrame:
    """``lines`` with the flags of their ``ranges``, still in the order of the file within a range."""
    if broadcast:
        return lines.join(F.broadcast(ranges), ["file", "block"], "left")
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    joined = numbered.join(ranges, ["file", "block"], "left").repartition("file", "block")
    return joined.sortWithinPartitions("file", "block", "line").drop("line")


def read_split_csv(
    spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "utf-8",
    broadcast_ranges: int = BROADCAST_RANGES, keep_empty: bool = False,
) -> DataFrame:
    """Text columns of delimited files in which quotes enclose a text or are doubled inside one.

    A file of any size is read by many tasks. The order of rows is that of records, but for those
    that cross the border of a range. Rules: empty lines are no records; a missing field is null;
    an empty file set has no header and raises ``ValueError``, as do a header over two lines,
    a quoted text that never ends and, when rows are read, a file with another header. A quote inside a
    text that is not enclosed is not this form of CSV: read such files whole. With ``keep_empty`` two
    quotes are an empty text, else null as nothing is.
    """
    lines = lines_of(spark, path, encoding)
    top = lines.where("block = 0").select("value", "odd").head(1)
    if not top:
        raise ValueError(f"no header line in {path}")
    header = plain_header(top[0]["value"])
    if top[0]["odd"]:
        raise ValueError("a quoted column name with a line break")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block")
    # one row per byte range, counted before the shuffle
    ranges = lines.groupBy(*PLACE).agg((F.sum("odd") % 2).alias("odd"))
    ranges = ranges.withColumn("begins_inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    ends_inside = (F.col("begins_inside").cast("int") + F.col("odd")) % 2 == 1
    ranges = ranges.withColumn("ends_inside", ends_inside)
    ranges = stage(ranges.withColumn("last", F.lead("block").over(after).isNull()))
    open_file = ranges.where("last and ends_inside").select("file_name").head(1)
    if open_file:
        raise ValueError(f"a quoted text in {open_file[0][0]} never ends; read the file whole if quotes are plain text")
    crossed = ranges.where("begins_inside or ends_inside").select("file", "block", "begins_inside")
    n = crossed.limit(broadcast_ranges + 1).count()
    lines = lines.drop("file_name")
    run = assemble(header)
    if n:
        marked = in_order(lines, crossed, n <= broadcast_ranges)
        records = marked.mapInArrow(run, RECORDS).where(F.col("kind") == WHOLE).select("record")
        # the ranges that take part in a crossing once more, for their fragments
        few = marked.where(F.col("begins_inside").isNotNull())
        records = records.unionByName(joined_fragments(few.mapInArrow(run, RECORDS)))
    else:
        records = lines.withColumn("begins_inside", F.lit(False)).mapInArrow(run, RECORDS).select("record")
    records = records.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
    names = column_names(header, sep)
    # parsed under names of its own, so that a header of any spelling is possible
    fields = [f"f{i}_{uuid4().hex[:8]}" for i in range(len(names))]
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    empty = uuid4().hex  # stands for two quotes, which the parser would take for null
    if keep_empty:
        options["emptyValue"] = empty
    parsed = F.from_csv("record", F.lit(", ".join(f"{f} string" for f in fields)), options)
    parsed = records.select(parsed.alias("r"))

    def field(f: str) -> Column:
        return F.when(F.col(f"r.{f}") == empty, "").otherwise(F.col(f"r.{f}")) if keep_empty else F.col(f"r.{f}")

    return parsed.select(*[field(f).alias(n) for f, n in zip(fields, names)])


def joined_fragments(pieces: DataFrame) -> DataFrame:
    """Records that cross a border; a record is as large as its own text, whatever the file's size."""
    order = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.where(F.col("kind") != WHOLE)
    chained = pieces.withColumn("chain", F.sum(F.when(F.col("kind") == OPENING, 1).otherwise(0)).over(order))
    sorted_pieces = F.sort_array(F.collect_list(F.struct("block", "at", "record")))
    return chained.groupBy("file", "chain").agg(
        F.array_join(F.transform(sorted_pieces, lambda p: p["record"]), "\n").alias("record")
    ).select("record")
