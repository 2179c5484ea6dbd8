"""Monthly roll-up and its trend, season, growth and volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.numbers import mean, ratio, total
from garimpo.schema import AMOUNT, DATE


def monthly(df: DataFrame, date: str = DATE) -> DataFrame:
    """Sum, count and mean per calendar month; months without rows do not appear."""
    return (
        df.where(F.col(date).isNotNull() & F.col(AMOUNT).isNotNull())
        .groupBy(F.date_trunc("month", F.col(date)).cast("date").alias("month"))
        .agg(total(AMOUNT).alias("total"), F.count("*").alias("operations"), mean(AMOUNT).alias("mean"))
        .withColumn("period", F.date_format("month", "yyyy-MM"))
    )


def monthly_growth(df: DataFrame, date: str = DATE) -> DataFrame:
    """``monthly`` with its row index and the change on the previous present month in percent.

    The windows run over one row per month, never over operations.
    """
    by_month = Window.orderBy("month")
    previous = F.lag("total").over(by_month)
    return monthly(df, date).withColumns(
        {
            "month_index": (F.row_number().over(by_month) - 1).cast("bigint"),
            "growth_rate": F.try_divide(F.col("total") - previous, previous) * 100,
        }
    )


def trend(df: DataFrame, date: str = DATE) -> DataFrame:
    """One row: trend slope, mean growth, volatility; ``status`` tells when rows are too few."""
    m = monthly_growth(df, date)
    slope = F.coalesce(F.regr_slope("total", "month_index"), F.lit(0.0))
    volatility = F.when(
        F.avg("total") > 0, ratio(F.stddev_samp("total"), F.avg("total"))
    ).otherwise(F.lit(0.0))
    return m.agg(
        slope.alias("trend_slope"),
        F.avg("growth_rate").alias("average_growth_rate"),
        volatility.alias("volatility"),
        F.when(F.coalesce(F.sum("operations"), F.lit(0)) < 2, "Dados insuficientes para análise temporal")
        .otherwise("ok")
        .alias("status"),
    )


def seasonal(df: DataFrame, date: str = DATE) -> DataFrame:
    """Mean amount per month of the year."""
    return (
        df.where(F.col(date).isNotNull() & F.col(AMOUNT).isNotNull())
        .groupBy(F.month(date).alias("month_of_year"))
        .agg(mean(AMOUNT).alias("mean"))
    )


def timeline(df: DataFrame, date: str = DATE) -> DataFrame:
    """Chart table of the monthly evolution."""
    return monthly(df, date).select(
        F.col("period").alias("PERIODO"),
        F.col("total").alias("CFEM_TOTAL"),
        F.col("operations").alias("NUM_OPERACOES"),
        F.col("mean").alias("CFEM_MEDIO"),
    )
