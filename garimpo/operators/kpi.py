"""Headline figures, rankings, filters and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.numbers import mean, ratio, total
from garimpo.operators.rank import quantile_columns
from garimpo.schema import AMOUNT, COMPANY, KEY, PLACE, STATE, SUBSTANCE, lowest_hashes


def totals_by(df: DataFrame, *keys: str, amount: str = AMOUNT) -> DataFrame:
    """Total, rows and mean per key; rows without a key are left out."""
    return (
        df.na.drop(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.coalesce(total(amount), F.lit(0.0)).alias("total"),
            F.count(amount).alias("operations"),
            mean(amount).alias("mean"),
        )
    )


def hhi_of(totals: DataFrame, value: str = "total", by: tuple[str, ...] = ()) -> DataFrame:
    """Herfindahl-Hirschman index: sum of squared shares, in one pass over group totals."""
    v = F.col(value)
    return totals.groupBy(*by).agg(
        ratio(F.sum(v * v), F.sum(v) * F.sum(v)).alias("hhi"), F.count(v).alias("groups")
    )


def statistics(df: DataFrame) -> DataFrame:
    """One row with all headline figures. The median is exact and distributed."""
    median = quantile_columns(df, AMOUNT, {"cfem_mediano": 0.5})
    hhi = hhi_of(totals_by(df, COMPANY))
    plain = df.agg(
        F.count("*").alias("total_registros"),
        F.countDistinct(COMPANY).alias("total_empresas"),
        F.countDistinct(STATE).alias("total_estados"),
        F.countDistinct(PLACE).alias("total_municipios"),
        F.countDistinct(SUBSTANCE).alias("total_substancias"),
        total(AMOUNT).alias("cfem_total"),
        mean(AMOUNT).alias("cfem_medio"),
        F.stddev_samp(AMOUNT).alias("cfem_std"),
        F.min(AMOUNT).alias("cfem_min"),
        F.max(AMOUNT).alias("cfem_max"),
    )
    return plain.select(
        "*",
        median.scalar().alias("cfem_mediano"),
        hhi.select("hhi").scalar().alias("hhi_empresas"),
    )


def basic_kpis(df: DataFrame) -> DataFrame:
    """The six figures of the first dashboard."""
    return df.agg(
        total(AMOUNT).alias("total_cfem"),
        F.countDistinct(COMPANY).alias("total_empresas"),
        F.countDistinct(STATE).alias("total_estados"),
        F.countDistinct(PLACE).alias("total_municipios"),
        F.countDistinct(SUBSTANCE).alias("total_substancias"),
        mean(AMOUNT).alias("cfem_medio"),
    )


def kpi_cards(df: DataFrame) -> DataFrame:
    """Indicator table ``(kpi, value)``."""
    row = df.agg(
        total(AMOUNT).alias("t"),
        F.countDistinct(COMPANY).cast("double").alias("c"),
        F.countDistinct(STATE).cast("double").alias("e"),
        F.countDistinct(SUBSTANCE).cast("double").alias("s"),
    )
    # Card titles.
    return row.selectExpr(
        "stack(4, 'Total CFEM', t, 'Empresas', c, 'Estados', e, 'Substâncias', s) AS (kpi, value)"
    )


def selection_cards(df: DataFrame) -> DataFrame:
    """Rows, total, companies, states, mean, maximum and minimum of a (filtered) selection."""
    return df.agg(
        F.count("*").alias("registros"),
        total(AMOUNT).alias("cfem_total"),
        F.countDistinct(COMPANY).alias("empresas"),
        F.countDistinct(STATE).alias("estados"),
        mean(AMOUNT).alias("cfem_medio"),
        F.max(AMOUNT).alias("cfem_max"),
        F.min(AMOUNT).alias("cfem_min"),
    )


def top_k(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """Largest ``k`` rows, ties by smallest key (a distributed take-ordered, no full sort)."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


def top_groups(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Groups with the largest totals."""
    return top_k(totals_by(df, key).select(key, "total"), "total", key, k)


def top_rows(df: DataFrame, k: int, key: str = KEY) -> DataFrame:
    return top_k(df.where(F.col(AMOUNT).isNotNull()), AMOUNT, key, k)


def first_group(totals: DataFrame, key: str, value: str) -> Column:
    """Key with the largest value, smallest key on ties, as a scalar column."""
    best = totals.agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("b"))
    return best.select("b.k").scalar()


def select_rows(
    df: DataFrame,
    states: list[str] | None = None,
    substances: list[str] | None = None,
    low: float | None = None,
    high: float | None = None,
    regions: list[str] | None = None,
    sizes: list[str] | None = None,
    company: str | None = None,
) -> DataFrame:
    """Dashboard filter. Plain predicates on columns, so they reach the file scan."""
    rules = []
    for column, allowed in (
        (STATE, states), (SUBSTANCE, substances), ("REGIAO", regions), ("PORTE_EMPRESA", sizes),
    ):
        if allowed is not None:
            rules.append(F.col(column).isin(allowed))
    if low is not None:
        rules.append(F.col(AMOUNT) >= low)
    if high is not None:
        rules.append(F.col(AMOUNT) <= high)
    if company is not None:
        rules.append(F.col(COMPANY) == company)
    for rule in rules:
        df = df.where(rule)
    return df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values for a filter list."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def amount_limits(df: DataFrame) -> DataFrame:
    return df.agg(F.min(AMOUNT).alias("low"), F.max(AMOUNT).alias("high"))


def preview(df: DataFrame, n: int = 10, key: str = KEY) -> DataFrame:
    return df.orderBy(key).limit(n)


def sample_rows(df: DataFrame, n: int, key: str = KEY, seed: int = 42) -> DataFrame:
    """At most ``n`` rows in hashed order of their keys: the same sample on every run."""
    h = F.xxhash64(key, F.lit(seed))
    return lowest_hashes(df, h, n).orderBy(h, key).limit(n)


def sorted_table(df: DataFrame, column: str, descending: bool = True, key: str = KEY) -> DataFrame:
    return df.orderBy(F.desc(column) if descending else F.asc(column), F.asc(key))


def display_columns(df: DataFrame) -> DataFrame:
    """The five columns of the detail table with the amount as currency text."""
    return df.select(
        COMPANY, PLACE, STATE, SUBSTANCE, currency(F.col(AMOUNT)).alias("CFEM_Formatado")
    )


def currency(amount: Column) -> Column:
    return F.concat(F.lit("R$ "), F.format_number(amount, 2))


def report_facts(df: DataFrame) -> DataFrame:
    """Leading company, state and substance and the company HHI."""
    companies = totals_by(df, COMPANY)
    return df.sparkSession.range(1).select(
        first_group(companies, COMPANY, "total").alias("maior_empresa"),
        first_group(totals_by(df, STATE), STATE, "total").alias("maior_estado"),
        first_group(totals_by(df, SUBSTANCE), SUBSTANCE, "total").alias("principal_substancia"),
        hhi_of(companies).select("hhi").scalar().alias("hhi_empresas"),
    )
