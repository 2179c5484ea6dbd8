"""Derived columns of a clean table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.labels import operation_size
from garimpo.functions.numbers import band
from garimpo.operators import dims
from garimpo.schema import AMOUNT, COMPANY, REGION, STATE, SUBSTANCE, sized_broadcast

# Amount band edges and labels.
AMOUNT_EDGES = [0, 10_000, 100_000, 1_000_000, 10_000_000]
AMOUNT_LABELS = ["Até 10K", "10K-100K", "100K-1M", "1M-10M", "Acima 10M"]


def amount_band(amount: Column) -> Column:
    return band(amount, AMOUNT_EDGES, AMOUNT_LABELS)


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumn(REGION, dims.region_of(F.col(STATE)))


def with_state_density(df: DataFrame) -> DataFrame:
    """Rows per state on every row.

    A window over the state would send each state to one task; counts are combined on the map
    side instead and joined back, broadcast if their number is small.
    """
    counts = df.groupBy(STATE).agg(F.count("*").alias("DENSIDADE_ESTADO"))
    counts = counts.where(F.col(STATE).isNotNull())
    return df.join(sized_broadcast(counts), STATE, "left")


def with_company_diversity(df: DataFrame) -> DataFrame:
    """Distinct substances of the row's company."""
    diversity = (
        df.where(F.col(COMPANY).isNotNull())
        .groupBy(COMPANY)
        .agg(F.countDistinct(SUBSTANCE).alias("DIVERSIFICACAO_EMPRESA"))
    )
    return df.join(sized_broadcast(diversity), COMPANY, "left")


def enrich(df: DataFrame) -> DataFrame:
    out, columns = df, set(df.columns)
    if AMOUNT in columns:
        out = out.withColumns(
            {"CFEM_FAIXA": amount_band(F.col(AMOUNT)), "PORTE_EMPRESA": operation_size(F.col(AMOUNT))}
        )
    if STATE in columns:
        out = with_state_density(with_region(out))
    if {COMPANY, SUBSTANCE} <= columns:
        out = with_company_diversity(out)
    return out
