"""State and region tables, territorial concentration and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import labels
from garimpo.functions.numbers import mean, ratio, total
from garimpo.operators import dims
from garimpo.operators.enrich import with_region
from garimpo.operators.kpi import first_group, hhi_of, top_k, totals_by
from garimpo.schema import AMOUNT, COMPANY, PLACE, REGION, STATE, SUBSTANCE


def profile(df: DataFrame, keys: list[str], distinct: dict[str, str]) -> DataFrame:
    """Total, operations, mean and distinct counts per key.

    Distinct counts go through Spark's two-step plan keyed by (key, value), so a key that holds
    a third of all rows is spread over its values before it is counted.
    """
    return (
        df.na.drop(subset=keys)
        .groupBy(*keys)
        .agg(
            F.count(AMOUNT).alias("NUM_OPERACOES"),
            F.coalesce(total(AMOUNT), F.lit(0.0)).alias("CFEM_TOTAL"),
            mean(AMOUNT).alias("CFEM_MEDIO"),
            *[F.countDistinct(c).alias(name) for name, c in distinct.items()],
        )
    )


def state_table(df: DataFrame) -> DataFrame:
    return profile(
        df, [STATE], {"NUM_EMPRESAS": COMPANY, "NUM_SUBSTANCIAS": SUBSTANCE, "NUM_MUNICIPIOS": PLACE}
    )


def region_table(df: DataFrame) -> DataFrame:
    return profile(with_region(df), [REGION], {"NUM_EMPRESAS": COMPANY, "NUM_ESTADOS": STATE})


def territorial_hhi(df: DataFrame) -> DataFrame:
    """HHI by state and by region with labels, as rows ``(level, hhi, interpretation)``.

    States are totalled once; regions are totals of the at most 27 known states plus none else.
    """
    states = totals_by(df, STATE).select(STATE, "total")
    regions = (
        with_region(states).na.drop(subset=[REGION]).groupBy(REGION).agg(F.sum("total").alias("total"))
    )
    both = hhi_of(states).select(F.lit("state").alias("level"), "hhi").unionByName(
        hhi_of(regions).select(F.lit("region").alias("level"), "hhi")
    )
    return both.withColumn("interpretation", labels.territorial_concentration(F.col("hhi")))


def states_per_company(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col(COMPANY).isNotNull())
        .groupBy(COMPANY)
        .agg(F.countDistinct(STATE).alias("NUM_ESTADOS_ATUACAO"))
    )


def mean_states_per_company(df: DataFrame) -> DataFrame:
    return states_per_company(df).agg(
        F.avg("NUM_ESTADOS_ATUACAO").alias("avg_territorial_diversification")
    )


def most_diversified(df: DataFrame, k: int = 10) -> DataFrame:
    return top_k(states_per_company(df), "NUM_ESTADOS_ATUACAO", COMPANY, k)


def geographic_insights(df: DataFrame) -> DataFrame:
    """Leading state, most diverse state, number of states, share of the leader."""
    states = totals_by(df, STATE)
    diverse = (
        df.where(F.col(STATE).isNotNull())
        .groupBy(STATE)
        .agg(F.countDistinct(SUBSTANCE).alias("n"))
    )
    size = states.agg(
        F.count("*").alias("n"), ratio(F.max("total"), F.sum("total")).alias("share")
    )
    return df.sparkSession.range(1).select(
        first_group(states, STATE, "total").alias("leading_state"),
        first_group(diverse, STATE, "n").alias("most_diverse_state"),
        size.select("n").scalar().alias("geographic_concentration"),
        size.select("share").scalar().alias("regional_dominance"),
    )


def substance_insights(df: DataFrame) -> DataFrame:
    """Top substance by total and by mean, number of substances, share of the leader."""
    substances = totals_by(df, SUBSTANCE)
    size = substances.agg(
        F.count("*").alias("n"), ratio(F.max("total"), F.sum("total")).alias("share")
    )
    return df.sparkSession.range(1).select(
        first_group(substances, SUBSTANCE, "total").alias("most_valuable_substance"),
        first_group(substances, SUBSTANCE, "mean").alias("highest_average_value"),
        size.select("n").scalar().alias("substance_diversity"),
        size.select("share").scalar().alias("concentration_by_substance"),
    )


def state_bubbles(df: DataFrame) -> DataFrame:
    """Map circles per state: reference point, total, companies, radius 10 to 50."""
    states = (
        df.where(F.col(STATE).isNotNull())
        .groupBy(STATE)
        .agg(
            F.coalesce(total(AMOUNT), F.lit(0.0)).alias("CFEM_TOTAL"),
            F.countDistinct(COMPANY).alias("NUM_EMPRESAS"),
        )
    )
    largest = totals_by(df, STATE).agg(F.max("total").alias("m")).scalar()
    points = F.broadcast(dims.state_points(df.sparkSession))
    return states.join(points, STATE).withColumn(
        "radius", 10 + F.try_divide(F.col("CFEM_TOTAL"), largest) * 40
    )
