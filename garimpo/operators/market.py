"""Market structure: concentration, efficiency, positioning, benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import labels
from garimpo.functions.numbers import mean, ratio, total
from garimpo.operators import dims
from garimpo.operators.kpi import hhi_of, top_k, totals_by
from garimpo.operators.rank import global_rank, quantile_columns
from garimpo.schema import AMOUNT, COMPANY, REGION, STATE, SUBSTANCE, scalar_of, stage


def gini_of(ranked: DataFrame):
    """Gini from ranked totals: ``(n + 1 - 2 * sum(x * (n - rank + 1)) / sum(x)) / n``."""
    n = F.count("*")
    weighted = F.sum(F.col("total") * F.col("row_rank"))
    spread = F.try_divide((n + 1) * F.sum("total") - weighted, F.sum("total"))
    return F.coalesce(F.try_divide(n + 1 - 2 * spread, n), F.lit(0.0)).alias("gini_coefficient")


def concentration(
    df: DataFrame, group: str = COMPANY, ks: tuple[int, ...] = (4, 8), eps: float = 1e-10
) -> DataFrame:
    """One row: HHI, CR(k), Shannon entropy (historically called Theil index), Gini, label.

    ``eps=0`` gives the entropy without the guard term. All shares are null for a zero market.
    """
    totals = stage(totals_by(df, group).select(group, "total"))
    market = totals.agg(F.sum("total").alias("total")).select("total").scalar()
    share = F.try_divide(F.col("total"), market)
    shares = totals.select(share.alias("share"))
    hhi = hhi_of(totals).select("hhi").scalar()
    row = {"hhi": hhi}
    for k in ks:
        top = totals.orderBy(F.desc("total"), F.asc(group)).limit(k)
        row[f"cr{k}"] = F.try_divide(top.agg(F.sum("total").alias("t")).scalar(), market)
    entropy = shares.agg((-F.sum(F.col("share") * F.ln(F.col("share") + eps))).alias("e"))
    row["theil_index"] = entropy.scalar()
    row["shannon_entropy"] = entropy.scalar()
    ranked = global_rank(totals, "total", group)
    row["gini_coefficient"] = ranked.agg(gini_of(ranked)).scalar()
    row["market_interpretation"] = F.when(hhi.isNotNull(), labels.market_concentration(hhi))
    return df.sparkSession.range(1).select(*[c.alias(name) for name, c in row.items()])


def competition_level(concentration_row: DataFrame) -> DataFrame:
    return concentration_row.select(
        "hhi", "cr4", labels.competition(F.col("hhi"), F.col("cr4")).alias("competitive_assessment")
    )


def company_efficiency(df: DataFrame) -> DataFrame:
    """Per company: total, operations, mean, distinct substances and states, three ratios."""
    return (
        df.where(F.col(COMPANY).isNotNull())
        .groupBy(F.col(COMPANY).alias("EMPRESA"))
        .agg(
            F.coalesce(total(AMOUNT), F.lit(0.0)).alias("CFEM_TOTAL"),
            F.count(AMOUNT).alias("NUM_OPERACOES"),
            mean(AMOUNT).alias("CFEM_MEDIO"),
            F.countDistinct(SUBSTANCE).alias("NUM_SUBSTANCIAS"),
            F.countDistinct(STATE).alias("NUM_ESTADOS"),
        )
        .withColumns(
            {
                "EFICIENCIA_OPERACIONAL": ratio("CFEM_TOTAL", "NUM_OPERACOES"),
                "DIVERSIFICACAO_GEOGRAFICA": ratio("NUM_ESTADOS", "NUM_OPERACOES"),
                "DIVERSIFICACAO_SUBSTANCIAS": ratio("NUM_SUBSTANCIAS", "NUM_OPERACOES"),
            }
        )
    )


def efficiency_top(df: DataFrame, measure: str, k: int = 10) -> DataFrame:
    return top_k(company_efficiency(df), measure, "EMPRESA", k)


def efficiency_summary(df: DataFrame) -> DataFrame:
    companies = stage(company_efficiency(df).select("EFICIENCIA_OPERACIONAL"))
    median = quantile_columns(companies, "EFICIENCIA_OPERACIONAL", {"m": 0.5})
    return companies.agg(
        F.avg("EFICIENCIA_OPERACIONAL").alias("avg_efficiency"),
        F.stddev_samp("EFICIENCIA_OPERACIONAL").alias("efficiency_std"),
    ).select("*", median.scalar().alias("median_efficiency"))


def distinct_lists(df: DataFrame, key: str, column: str, alias: str) -> DataFrame:
    """Sorted distinct values of ``column`` per key.

    Pairs are made distinct first, so the list of a key is built from its distinct values only.
    """
    pairs = df.select(key, column).where(F.col(key).isNotNull() & F.col(column).isNotNull())
    return pairs.distinct().groupBy(key).agg(F.sort_array(F.collect_list(column)).alias(alias))


def positioning(df: DataFrame) -> DataFrame:
    """Company table with lists of substances and states, market share and class."""
    companies = (
        df.where(F.col(COMPANY).isNotNull())
        .groupBy(COMPANY)
        .agg(
            F.coalesce(total(AMOUNT), F.lit(0.0)).alias("CFEM_TOTAL"),
            F.count(AMOUNT).alias("NUM_OPERACOES"),
            mean(AMOUNT).alias("CFEM_MEDIO"),
        )
    )
    market = df.where(F.col(COMPANY).isNotNull()).agg(total(AMOUNT).alias("t")).scalar()
    empty = F.array().cast("array<string>")
    return (
        companies.join(distinct_lists(df, COMPANY, SUBSTANCE, "SUBSTANCIAS"), COMPANY, "left")
        .join(distinct_lists(df, COMPANY, STATE, "ESTADOS"), COMPANY, "left")
        .withColumns(
            {
                "SUBSTANCIAS": F.coalesce("SUBSTANCIAS", empty),
                "ESTADOS": F.coalesce("ESTADOS", empty),
                "MARKET_SHARE": F.try_divide(F.col("CFEM_TOTAL"), market) * 100,
            }
        )
        .withColumns(
            {
                "NUM_SUBSTANCIAS": F.size("SUBSTANCIAS").cast("bigint"),
                "NUM_ESTADOS": F.size("ESTADOS").cast("bigint"),
                "CATEGORIA_PORTE": labels.market_share_class(F.col("MARKET_SHARE")),
            }
        )
        .withColumnRenamed(COMPANY, "EMPRESA")
    )


# Market-share class -> position in the competitive matrix.
POSITIONS = {"Líder": "leaders", "Grande": "challengers", "Média": "followers", "Pequena": "nichers"}


def share_classes(df: DataFrame) -> DataFrame:
    """Per company its share, class and position; no lists."""
    totals = totals_by(df, COMPANY).select(COMPANY, "total")
    market = df.where(F.col(COMPANY).isNotNull()).agg(total(AMOUNT).alias("t")).scalar()
    share = F.try_divide(F.col("total"), market) * 100
    position = F.lit(None).cast("string")
    for label, name in POSITIONS.items():
        position = F.when(F.col("CATEGORIA_PORTE") == label, name).otherwise(position)
    return (
        totals.withColumn("MARKET_SHARE", share)
        .withColumn("CATEGORIA_PORTE", labels.market_share_class(F.col("MARKET_SHARE")))
        .withColumn("position", position)
    )


def market_structure(df: DataFrame) -> DataFrame:
    """Companies per position of the competitive matrix, empty positions included."""
    counts = share_classes(df).groupBy("position").agg(F.count("*").alias("companies"))
    names = dims.labels(df.sparkSession, "position", list(POSITIONS.values()))
    return names.join(counts, "position", "left").select(
        "position", F.coalesce("companies", F.lit(0)).alias("companies")
    )


def _spread(df: DataFrame, column: str, names: tuple[str, str, str]) -> DataFrame:
    per = (
        df.where(F.col(COMPANY).isNotNull())
        .groupBy(COMPANY)
        .agg(F.countDistinct(column).alias("n"))
    )
    return per.agg(
        F.avg("n").alias(names[0]),
        F.count_if(F.col("n") == 1).alias(names[1]),
        F.count_if(F.col("n") > 1).alias(names[2]),
    )


def sustainability(df: DataFrame) -> DataFrame:
    """One row: how widely companies spread over states and substances."""
    states = _spread(
        df, STATE, ("avg_states_per_company", "companies_single_state", "companies_multi_state")
    )
    substances = _spread(
        df,
        SUBSTANCE,
        ("avg_substances_per_company", "companies_single_substance", "companies_multi_substance"),
    )
    s = scalar_of(substances)
    return states.select("*", *[s[c].alias(c) for c in substances.columns])


def regional_risk(df: DataFrame) -> DataFrame:
    """HHI over regions (over states where no region column exists) and its risk level."""
    group = REGION if REGION in df.columns else STATE
    return hhi_of(totals_by(df, group)).select(
        F.col("hhi").alias("concentration_index"),
        labels.regional_risk(F.col("hhi")).alias("risk_level"),
    )


def _company_profile(df: DataFrame) -> DataFrame:
    return company_efficiency(df).select(
        "EMPRESA", "CFEM_TOTAL", "NUM_OPERACOES", "CFEM_MEDIO", "NUM_ESTADOS", "NUM_SUBSTANCIAS"
    )


def _market_means(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.sum("CFEM_TOTAL").alias("market_total"),
        F.avg("CFEM_TOTAL").alias("avg_cfem_per_company"),
        F.avg("NUM_OPERACOES").alias("avg_operations_per_company"),
        F.avg("NUM_ESTADOS").alias("avg_states_per_company"),
        F.avg("NUM_SUBSTANCIAS").alias("avg_substances_per_company"),
        F.count("*").alias("companies"),
    )


def _versus(row: DataFrame, m) -> DataFrame:
    return row.withColumns(
        {
            **{c: m[c] for c in (
                "market_total", "avg_cfem_per_company", "avg_operations_per_company",
                "avg_states_per_company", "avg_substances_per_company",
            )},
            "cfem_vs_avg": F.coalesce(ratio(F.col("CFEM_TOTAL"), m["avg_cfem_per_company"]), F.lit(0.0)),
            "operations_vs_avg": F.coalesce(
                ratio(F.col("NUM_OPERACOES"), m["avg_operations_per_company"]), F.lit(0.0)
            ),
        }
    )


def benchmark(df: DataFrame, company: str) -> DataFrame:
    """One company against the market; no row if the company does not occur."""
    profile = stage(_company_profile(df))
    target = profile.where(F.col("EMPRESA") == company)
    value = target.select("CFEM_TOTAL").scalar()
    below = profile.agg(
        (F.avg((F.col("CFEM_TOTAL") < value).cast("double")) * 100).alias("p")
    ).scalar()
    return _versus(target, scalar_of(_market_means(profile))).withColumn("cfem_percentile", below)


def benchmark_all(df: DataFrame) -> DataFrame:
    """The same figures for every company at once, percentiles from global ranks."""
    profile = stage(_company_profile(df))
    m = scalar_of(_market_means(profile))
    ranked = global_rank(profile, "CFEM_TOTAL", "EMPRESA")
    return _versus(ranked, m).withColumn(
        "cfem_percentile", (F.col("value_rank") - 1) / m["companies"] * 100
    ).drop("row_rank", "value_rank")


def lorenz(df: DataFrame, group: str = COMPANY) -> DataFrame:
    """Share, running share and rank of every group, largest first."""
    totals = stage(totals_by(df, group).select(group, "total"))
    market = totals.agg(F.sum("total").alias("t")).scalar()
    return global_rank(totals, "total", group, descending=True, running="total").select(
        group,
        (F.try_divide(F.col("total"), market) * 100).alias("share_pct"),
        (F.try_divide(F.col("running_total"), market) * 100).alias("cumulative_pct"),
        F.col("row_rank").alias("rank"),
    )


def lorenz_top(df: DataFrame, k: int = 20, group: str = COMPANY) -> DataFrame:
    """Bars of the largest groups; needs no global rank."""
    totals = totals_by(df, group).select(group, "total")
    market = df.where(F.col(group).isNotNull()).agg(total(AMOUNT).alias("t")).scalar()
    return top_k(totals, "total", group, k).select(
        group, (F.try_divide(F.col("total"), market) * 100).alias("share_pct")
    )


def equality_line(df: DataFrame, group: str = COMPANY) -> DataFrame:
    """The two end points of the uniform distribution."""
    row = df.agg(F.countDistinct(group).alias("n"))
    return row.selectExpr("stack(2, 1L, 0.0D, n, 100.0D) AS (rank, cumulative_pct)")


def hhi_by_substance(df: DataFrame) -> DataFrame:
    """HHI of the companies inside every substance."""
    totals = totals_by(df, SUBSTANCE, COMPANY)
    return hhi_of(totals, by=(SUBSTANCE,)).select(SUBSTANCE, F.col("hhi").alias("HHI"))


def top_companies_per_substance(df: DataFrame, k: int = 10) -> DataFrame:
    """Largest companies of every substance.

    Company totals are split over salted parts of each substance, each part keeps its own
    ``k`` best, and only those meet in the final rank: a substance that holds most companies is
    never sorted in one task.
    """
    totals = totals_by(df, SUBSTANCE, COMPANY).select(SUBSTANCE, COMPANY, "total")
    order = [F.desc("total"), F.asc(COMPANY)]
    part = Window.partitionBy(SUBSTANCE, "_salt").orderBy(*order)
    whole = Window.partitionBy(SUBSTANCE).orderBy(*order)
    return (
        totals.withColumn("_salt", F.pmod(F.xxhash64(COMPANY), F.lit(64)))
        .withColumn("_r", F.row_number().over(part))
        .where(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(whole))
        .where(F.col("rank") <= k)
        .drop("_salt", "_r")
    )


def top_companies_in_leading_substance(df: DataFrame, k: int = 10) -> DataFrame:
    from garimpo.operators.kpi import first_group, top_groups

    leader = first_group(totals_by(df, SUBSTANCE), SUBSTANCE, "total")
    return top_groups(df.where(F.col(SUBSTANCE) == leader), COMPANY, k)
