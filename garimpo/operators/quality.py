"""Data-quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.numbers import ratio
from garimpo.operators import dims
from garimpo.schema import COMPANY, LAT, LON, STATE


def completeness(df: DataFrame) -> DataFrame:
    """Share of non-null values per column, as rows ``(column, pct)``; one scan."""
    names = df.columns
    row = df.agg(
        *[
            ratio(F.count(F.col(f"`{c}`")) * 100, F.count("*")).alias(f"c{i}")
            for i, c in enumerate(names)
        ]
    )
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("pct"))
        for i, c in enumerate(names)
    ]
    return row.select(F.inline(F.array(*pairs)))


def repeated_rows(df: DataFrame, *columns: str):
    """Rows beyond the first of every distinct combination (nulls count as equal).

    Combinations are folded on the map side, so a combination held by a third of all rows
    costs one row per task.
    """
    groups = df.groupBy(*[F.col(f"`{c}`") for c in columns or df.columns]).agg(
        F.count("*").alias("n")
    )
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")).scalar()


def duplicates(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(
        repeated_rows(df).alias("total_duplicatas"),
        repeated_rows(df, COMPANY).alias("duplicatas_por_empresa"),
        repeated_rows(df, LON, LAT).alias("duplicatas_por_localizacao"),
    )


def outlier_share(df: DataFrame) -> DataFrame:
    flagged = F.count_if("CFEM_OUTLIER")
    return df.agg(
        flagged.alias("total_outliers"),
        ratio(flagged * 100, F.count("*")).alias("percentual_outliers"),
    )


def geographic_consistency(df: DataFrame) -> DataFrame:
    """Operations outside the box of their region, over those with coordinates."""
    boxes = F.broadcast(dims.region_boxes(df.sparkSession))
    placed = (
        df.where(F.col(LON).isNotNull() & F.col(LAT).isNotNull())
        .select(LON, LAT, dims.region_of(F.col(STATE)).alias("REGIAO"))
        .join(boxes, "REGIAO", "left")
    )
    outside = ~(
        F.col(LAT).between(F.col("lat_min"), F.col("lat_max"))
        & F.col(LON).between(F.col("lon_min"), F.col("lon_max"))
    )
    return placed.agg(
        F.count_if(outside).alias("inconsistencias_geograficas"),
        F.count("*").alias("total_com_coordenadas"),
        F.coalesce(ratio(F.count_if(outside) * 100, F.count("*")), F.lit(0.0)).alias(
            "percentual_inconsistencias"
        ),
    )


def quality_status(df: DataFrame) -> DataFrame:
    """Status flags of the quality page: any duplicate row; more than 5 % outliers.

    Both come from one pass over the distinct rows and their counts.
    """
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies"))
    outliers = F.sum(F.when(F.col("CFEM_OUTLIER"), F.col("_copies")).otherwise(0))
    row = groups.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("repeated"),
        ratio(outliers * 100, F.sum("_copies")).alias("percentual_outliers"),
    )
    return row.select(
        F.when(F.col("repeated") > 0, "Duplicatas Encontradas")
        .otherwise("Sem Duplicatas")
        .alias("duplicatas"),
        F.when(F.col("percentual_outliers") > 5, "Outliers Detectados")
        .otherwise("Poucos Outliers")
        .alias("outliers"),
    )
