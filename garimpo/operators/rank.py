"""Order statistics without a single-partition sort.

``exact_quantiles`` and ``global_rank`` cut the value axis into ranges of about equal size.
The cut points are plain literals, so the range of a row is a pure function of the row:
a task that is run again puts the row in the same range. Only per-range counts travel to
one place, never the rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.numbers import EXACT, exact_and_rest
from garimpo.schema import lowest_hashes, range_count

TARGETS_ON_DRIVER = 20_000


def _ranges(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """Add ``_range``: index of the half-open range ``[cut, next cut)`` that holds the value."""
    splits = [-math.inf, *cuts, math.inf]
    if len(splits) < 3:
        return df.withColumn("_range", F.lit(0))
    out = Bucketizer(splits=splits, inputCol=column, outputCol="_range").transform(df)
    return out.withColumn("_range", F.col("_range").cast("int"))


def _value_cuts(df: DataFrame, column: str, ranges: int) -> list[float]:
    """Approximate equal-count cut points (at most ``ranges`` doubles reach the driver)."""
    row = df.agg(
        F.percentile_approx(
            column, [i / ranges for i in range(1, ranges)], 8 * ranges
        ).alias("cuts")
    ).first()
    return sorted(set(row.cuts or []))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    by: tuple[str, ...] = (),
    ranges: int | None = None,
    copies: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles as rows ``(*by, prob, quantile)``.

    Passes: approximate cut points; counts per (group, range), from which the range and the
    offset of every wanted rank follow; then only rows of those ranges are kept, folded to
    (value, count) before the shuffle and ordered inside their range. No group is ever held by
    one task: a range holds about ``1/ranges`` of the rows, and copies of a value collapse.
    A row counts as often as its column ``copies`` says, if that is given.
    """
    spark = df.sparkSession
    ranges = ranges or range_count(df, 256)
    number = F.col(value).cast("double")
    keep = number.isNotNull() & ~F.isnan(number)
    for key in by:
        keep = keep & F.col(key).isNotNull()
    rows = df.where(keep).select(*by, number.alias("_value"), *([F.col(copies).alias("_each")] if copies else []))
    counted = F.sum("_each") if copies else F.count("*")
    rows = _ranges(rows, "_value", _value_cuts(rows, "_value", ranges))

    counts = rows.groupBy(*by, "_range").agg(counted.alias("_n"))
    running = Window.partitionBy(*by).orderBy("_range")
    position = F.col("prob") * (F.col("_total") - 1)
    wanted = (
        counts.withColumn("_end", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn(
            "_side",
            F.explode(
                F.array(
                    F.struct(F.floor(position).alias("rank"), F.lit(0).alias("upper")),
                    F.struct(F.ceil(position).alias("rank"), F.lit(1).alias("upper")),
                )
            ),
        )
        .withColumn("_offset", F.col("_side.rank") - (F.col("_end") - F.col("_n")))
        .where((F.col("_offset") >= 0) & (F.col("_offset") < F.col("_n")))
        .select(
            *by, "_range", "prob", F.col("_side.upper").alias("_upper"), "_offset",
            (position - F.floor(position)).alias("_fraction"),
        )
    )
    # The wanted ranks are few unless there are very many groups: then they stay distributed.
    found = wanted.limit(TARGETS_ON_DRIVER + 1).collect()
    if len(found) <= TARGETS_ON_DRIVER:
        wanted = F.broadcast(spark.createDataFrame(found, wanted.schema))
    on = [*by, "_range"]
    folded = (
        rows.join(wanted.select(*on).distinct(), on, "left_semi")
        .groupBy(*on, "_value")
        .agg(counted.alias("_copies"))
        .withColumn("_last", F.sum("_copies").over(Window.partitionBy(*on).orderBy("_value")))
    )
    hits = folded.join(wanted, on).where(
        (F.col("_offset") < F.col("_last"))
        & (F.col("_offset") >= F.col("_last") - F.col("_copies"))
    )
    low = F.max(F.when(F.col("_upper") == 0, F.col("_value")))
    high = F.max(F.when(F.col("_upper") == 1, F.col("_value")))
    return hits.groupBy(*by, "prob").agg(
        (low + (high - low) * F.max("_fraction")).alias("quantile")
    )


def quantile_columns(
    df: DataFrame, value: str, named: dict[str, float], by: tuple[str, ...] = (), copies: str | None = None
) -> DataFrame:
    """``exact_quantiles`` with one column per probability (one row per group)."""
    long = exact_quantiles(df, value, list(dict.fromkeys(named.values())), by, copies=copies)
    return long.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name)
            for name, p in named.items()
        ]
    )


def _key_range(key: Column, cuts: list) -> Column:
    """Number of ``cuts`` at or below ``key``, as a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(cuts[middle]), tree(low, middle)).otherwise(
            tree(middle + 1, high)
        )

    return tree(0, len(cuts))


def global_rank(
    df: DataFrame,
    value: str,
    key: str,
    descending: bool = False,
    running: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``row_rank`` (1..n by value, ties by key) and ``value_rank`` (ties share the first).

    ``running`` names an amount whose exact running sum in that order is added as
    ``running_total``. ``key`` must be unique. Rows of equal value may be many: a value that
    takes more than one cut point is split further along ``key``.
    """
    ranges = ranges or range_count(df, 64)
    signed = (-F.col(value) if descending else F.col(value)).cast("double")
    rows = df.where(signed.isNotNull() & ~F.isnan(signed)).withColumn("_signed", signed)
    keyed = rows.select("_signed", key, F.xxhash64(F.col(key)).alias("_h"))
    sample = lowest_hashes(keyed, F.col("_h"), ranges * 32).orderBy("_h").limit(ranges * 32).collect()
    points = sorted((r[0], r[1]) for r in sample)
    cuts = [points[i * len(points) // ranges] for i in range(1, ranges)] if points else []
    by_value: dict[float, list] = {}
    for v, k in dict.fromkeys(cuts):
        by_value.setdefault(v, []).append(k)
    values = sorted(by_value)
    heavy = {v: sorted(ks) for v, ks in by_value.items() if len(ks) > 1}

    rows = _ranges(rows, "_signed", values)
    part = F.lit(0)
    if heavy:
        part = None
        for v, ks in heavy.items():
            part = (F if part is None else part).when(
                F.col("_signed") == F.lit(v), _key_range(F.col(key), ks)
            )
        part = part.otherwise(F.lit(max(len(ks) for ks in heavy.values()) + 1))
    rows = rows.withColumn("_part", part)

    # what a decimal cannot hold is added as double
    amount, rest = exact_and_rest(running) if running else (F.lit(0).cast(EXACT), F.lit(0.0))
    order = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_range").orderBy("_part")
    before = (
        rows.groupBy("_range", "_part")
        .agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"), F.sum(rest).alias("_r"))
        # at most about two rows per cut point are left here
        .withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
        .withColumn("_sum_before", F.coalesce(F.sum("_s").over(order), F.lit(0)))
        .withColumn("_rest_before", F.coalesce(F.sum("_r").over(order), F.lit(0.0)))
        .withColumn("_range_before", F.first("_before").over(whole))
        .drop("_n", "_s", "_r")
    )
    local = Window.partitionBy("_range", "_part").orderBy("_signed", key)
    ranked = rows.join(F.broadcast(before), ["_range", "_part"])
    ranked = ranked.withColumn("row_rank", F.col("_before") + F.row_number().over(local))
    tie = Window.partitionBy("_range", "_part").orderBy("_signed")
    first = F.col("_before") + F.rank().over(tie)
    if heavy:
        first = F.when(
            F.col("_signed").isin(list(heavy)), F.col("_range_before") + 1
        ).otherwise(first)
    ranked = ranked.withColumn("value_rank", first)
    if running:
        rows_so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = ranked.withColumn(
            "running_total",
            (F.col("_sum_before") + F.coalesce(F.sum(amount).over(rows_so_far), F.lit(0))).cast("double")
            + F.col("_rest_before") + F.coalesce(F.sum(rest).over(rows_so_far), F.lit(0.0)),
        )
    return ranked.drop(
        "_signed", "_range", "_part", "_before", "_sum_before", "_rest_before", "_range_before"
    )


def average_ranks(df: DataFrame, value: str, by: str, ranges: int | None = None) -> DataFrame:
    """Rank sums with ties averaged: rows ``(by, n, rank_sum, tie_term)``.

    Rows are first folded to (value, group) counts, so equal values never pile up.
    ``tie_term`` is the group's share of the sum of ``t^2 - 1`` over its rows, where ``t`` is
    the number of copies of the row's value in the whole table.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(
        F.col(value).cast("double").alias("_value"), F.col(by)
    )
    cuts = _value_cuts(rows, "_value", ranges or range_count(df, 64))
    folded = _ranges(rows.groupBy("_value", by).agg(F.count("*").alias("_n")), "_value", cuts)
    # counted on the rows themselves: map-side combine leaves one small row per task and range
    before = (
        _ranges(rows, "_value", cuts)
        .groupBy("_range")
        .agg(F.count("*").alias("_m"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_m").over(
                    Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_m")
    )
    up_to = Window.partitionBy("_range").orderBy("_value")  # range frame: ties included
    same = Window.partitionBy("_range", "_value")
    ranked = (
        folded.withColumn("_upto", F.sum("_n").over(up_to))
        .withColumn("_ties", F.sum("_n").over(same))
        .join(F.broadcast(before), "_range")
        .withColumn(
            "_rank", F.col("_before") + F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2
        )
    )
    ties = F.col("_ties").cast("double")
    return ranked.groupBy(by).agg(
        F.sum("_n").alias("n"),
        F.sum(F.col("_n") * F.col("_rank")).alias("rank_sum"),
        F.sum(F.col("_n") * (ties * ties - 1)).alias("tie_term"),
    )
