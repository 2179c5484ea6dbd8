"""Chart-ready tables: their size depends on categories and bins, not on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import labels
from garimpo.functions.numbers import exact_and_rest, total
from garimpo.operators.kpi import totals_by
from garimpo.operators.market import company_efficiency, distinct_lists
from garimpo.operators.rank import exact_quantiles, quantile_columns
from garimpo.operators.territory import profile
from garimpo.schema import (
    AMOUNT, COMPANY, KEY, LAT, LON, PLACE, REGION, STATE, SUBSTANCE, scalar_of, stage,
)


def substance_table(df: DataFrame) -> DataFrame:
    return profile(df, [SUBSTANCE], {"NUM_EMPRESAS": COMPANY}).withColumnRenamed(
        SUBSTANCE, "SUBSTANCIA"
    )


def region_state_tree(df: DataFrame) -> DataFrame:
    """Treemap nodes: (region, state), region subtotals and the grand total."""
    amount, rest = exact_and_rest(AMOUNT)
    # folded to states first: a rollup lists its rows once per level
    states = df.na.drop(subset=[REGION, STATE]).groupBy(REGION, STATE).agg(
        F.sum(amount).alias("s"), F.sum(rest).alias("r"), F.count(AMOUNT).alias("n")
    )
    return (
        states.rollup(REGION, STATE)
        .agg(
            (F.coalesce(F.sum("s").cast("double"), F.lit(0.0)) + F.sum("r")).alias("CFEM_TOTAL"),
            F.sum("n").alias("NUM_OPERACOES"),
        )
        .select(REGION, STATE, "CFEM_TOTAL", "NUM_OPERACOES")
    )


def region_chart(df: DataFrame) -> DataFrame:
    return profile(df, [REGION], {"NUM_EMPRESAS": COMPANY, "NUM_SUBSTANCIAS": SUBSTANCE})


def efficiency_chart(df: DataFrame) -> DataFrame:
    return company_efficiency(df).select(
        "EMPRESA", "CFEM_TOTAL", "CFEM_MEDIO", "NUM_OPERACOES", "NUM_SUBSTANCIAS", "NUM_ESTADOS",
        F.col("EFICIENCIA_OPERACIONAL").alias("EFICIENCIA"),
    )


def portfolio(df: DataFrame) -> DataFrame:
    """Company portfolio with its substances and diversification level."""
    companies = (
        df.where(F.col(COMPANY).isNotNull())
        .groupBy(COMPANY)
        .agg(
            F.coalesce(total(AMOUNT), F.lit(0.0)).alias("CFEM_TOTAL"),
            F.countDistinct(STATE).alias("NUM_ESTADOS"),
        )
    )
    return (
        companies.join(distinct_lists(df, COMPANY, SUBSTANCE, "SUBSTANCIAS"), COMPANY, "left")
        .withColumn("SUBSTANCIAS", F.coalesce("SUBSTANCIAS", F.array().cast("array<string>")))
        .withColumn("DIVERSIFICACAO", F.size("SUBSTANCIAS").cast("bigint"))
        .withColumn("NIVEL_DIVERSIFICACAO", labels.diversification(F.col("DIVERSIFICACAO")))
        .withColumnRenamed(COMPANY, "EMPRESA")
    )


def portfolio_tree(df: DataFrame) -> DataFrame:
    """Sunburst nodes: (level, company), level subtotals and the grand total."""
    level = labels.diversification(F.countDistinct(SUBSTANCE)).alias("NIVEL_DIVERSIFICACAO")
    companies = (
        df.where(F.col(COMPANY).isNotNull())
        .groupBy(F.col(COMPANY).alias("EMPRESA"))
        .agg(level, F.sum(F.col(AMOUNT).cast("decimal(24,6)")).alias("t"))
        .na.drop(subset=["NIVEL_DIVERSIFICACAO"])
    )
    return companies.rollup("NIVEL_DIVERSIFICACAO", "EMPRESA").agg(
        F.sum("t").cast("double").alias("CFEM_TOTAL"), F.count("*").alias("NUM_EMPRESAS")
    )


def state_density(df: DataFrame) -> DataFrame:
    return (
        df.na.drop(subset=[STATE, REGION])
        .groupBy(STATE, REGION)
        .agg(
            F.coalesce(total(AMOUNT), F.lit(0.0)).alias("CFEM_TOTAL"),
            F.countDistinct(COMPANY).alias("NUM_EMPRESAS"),
            F.count(LON).alias("NUM_OPERACOES"),
        )
    )


def group_totals(df: DataFrame, key: str) -> DataFrame:
    """Sum and count per key (bar and pie charts)."""
    return totals_by(df, key).select(
        key, F.col("total").alias("CFEM_TOTAL"), F.col("operations").alias("NUM_OPERACOES")
    )


def histogram(df: DataFrame, value: str = AMOUNT, bins: int = 30, log: bool = False) -> DataFrame:
    """Equal-width histogram; ``log`` bins ``log10(value + 1)``. Empty bins do not appear."""
    x = F.col(value).cast("double")
    x = F.log10(x + 1) if log else x
    values = df.where(F.col(value).isNotNull()).select(x.alias("x"))
    r = scalar_of(values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    width = F.col("width")
    placed = values.select("x", r["lo"].alias("lo"), ((r["hi"] - r["lo"]) / bins).alias("width"))
    index = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)))
    return (
        placed.withColumn("bin", F.coalesce(index, F.lit(0)).cast("bigint"))
        .groupBy("bin", "lo", "width")
        .agg(F.count("*").alias("count"))
        .select(
            "bin", "count",
            (F.col("lo") + F.col("bin") * width).alias("left"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
        )
    )


def box_rows(rows: DataFrame) -> DataFrame:
    """Five-number summaries of ``x`` per (dimension, category) with 1.5 IQR fences."""
    by = ("dimension", "category")
    q = quantile_columns(rows, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    ends = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return ends.join(q, list(by)).select(
        *by, "n", "min", "q1", "median", "q3", "max",
        (F.col("q1") - reach).alias("lower_fence"), (F.col("q3") + reach).alias("upper_fence"),
    )


def box_summary(df: DataFrame, value: str = AMOUNT, by: str | None = None) -> DataFrame:
    """Box summary per category of ``by``, or over all rows."""
    category = F.col(by) if by else F.lit("all")
    return box_rows(
        df.select(
            F.lit(by or "all").alias("dimension"), category.cast("string").alias("category"),
            F.col(value).cast("double").alias("x"),
        ).na.drop()
    )


def most_frequent(df: DataFrame, key: str, k: int) -> DataFrame:
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(k).select(key)


def only_top(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys`` (a top-k table, so its broadcast is bounded by k)."""
    return df.join(F.broadcast(keys), key, "left_semi")


def category_boxes(df: DataFrame, states: int = 10, substances: int = 8) -> DataFrame:
    """Box summaries for the busiest states, the first substances by name, regions and sizes.

    Every row is listed once per dimension and all boxes are computed together.
    """
    busiest = most_frequent(df, STATE, states).withColumn("_state", F.col(STATE))
    first = (
        df.select(SUBSTANCE).where(F.col(SUBSTANCE).isNotNull()).distinct()
        .orderBy(SUBSTANCE).limit(substances).withColumn("_substance", F.col(SUBSTANCE))
    )
    # both tables are bounded by their limits; written, else every pass of the quantiles counts them anew
    rows = df.join(F.broadcast(stage(busiest)), STATE, "left").join(F.broadcast(stage(first)), SUBSTANCE, "left")
    dimensions = {STATE: "_state", SUBSTANCE: "_substance"}
    dimensions |= {c: c for c in (REGION, "PORTE_EMPRESA") if c in df.columns}
    listed = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(c).alias("category"))
            for name, c in dimensions.items()
        ]
    )
    return box_rows(
        rows.select(F.inline(listed), F.col(AMOUNT).cast("double").alias("x")).na.drop()
    )


def quantile_plot(df: DataFrame, value: str = AMOUNT, points: int = 101) -> DataFrame:
    """Empirical quantiles with the matching standard normal quantiles (null at both ends)."""
    from garimpo.operators.stats import normal_quantile

    probs = [i / (points - 1) for i in range(points)]
    inside = (F.col("prob") > 0) & (F.col("prob") < 1)
    return exact_quantiles(df, value, probs).withColumn(
        "normal_quantile", F.when(inside, normal_quantile(F.col("prob")))
    )


def heat_cells(df: DataFrame, cell_degrees: float = 0.5) -> DataFrame:
    """Heat-map input: one weighted point per grid cell instead of one per operation."""
    rows = df.na.drop(subset=[LAT, LON])
    return rows.groupBy(
        F.floor(F.col(LAT) / cell_degrees).alias("cell_y"),
        F.floor(F.col(LON) / cell_degrees).alias("cell_x"),
    ).agg(F.coalesce(total(AMOUNT), F.lit(0.0)).alias("weight"), F.count("*").alias("points"))


def marker_tiles(df: DataFrame, zooms: tuple[int, ...] = (4, 6, 8)) -> DataFrame:
    """Marker clusters at several zoom levels: cells of ``360 / 2^zoom`` degrees.

    The finest level is counted from the rows; every coarser one from the level below.
    """
    rows = df.na.drop(subset=[LAT, LON])
    size = 360.0 / 2 ** max(zooms)
    finest = rows.groupBy(
        F.floor((F.col(LAT) + 90) / size).alias("tile_y"),
        F.floor((F.col(LON) + 180) / size).alias("tile_x"),
    ).agg(F.count("*").alias("n"), F.sum(F.col(AMOUNT).cast("decimal(24,6)")).alias("s"))
    out = None
    for zoom in sorted(zooms, reverse=True):
        shift = max(zooms) - zoom
        level = (
            finest.groupBy(
                F.shiftright("tile_y", shift).alias("tile_y"),
                F.shiftright("tile_x", shift).alias("tile_x"),
            )
            .agg(F.sum("n").alias("markers"), F.sum("s").cast("double").alias("total"))
            .select(F.lit(zoom).alias("zoom"), "tile_y", "tile_x", "markers", "total")
        )
        out = level if out is None else out.unionByName(level)
    return out


def marker_sizes(df: DataFrame, key: str = KEY) -> DataFrame:
    """Min-max scaled amount and marker size ``max(5, 50 * scaled)`` per operation."""
    r = scalar_of(df.agg(F.min(AMOUNT).alias("lo"), F.max(AMOUNT).alias("hi")))
    scaled = F.try_divide(F.col(AMOUNT) - r["lo"], r["hi"] - r["lo"])
    return df.select(
        key, scaled.alias("normalized"), F.greatest(F.lit(5.0), 50 * scaled).alias("marker_size")
    )


def value_tiers(df: DataFrame, key: str = KEY) -> DataFrame:
    """Operations marked by the 0.9 and 0.7 quantiles of the amount (all computed once)."""
    q = scalar_of(quantile_columns(df, AMOUNT, {"q9": 0.9, "q7": 0.7}))
    amount = F.col(AMOUNT)
    rows = df.na.drop(subset=[LAT, LON])
    # Tier colours and marker sizes.
    return rows.select(
        key,
        F.when(amount > q["q9"], "red").when(amount > q["q7"], "orange").otherwise("blue").alias("tier"),
        F.when(amount > q["q9"], 10).when(amount > q["q7"], 8).otherwise(6).alias("size"),
    )


def scatter(
    df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None
) -> DataFrame:
    """Columns of a scatter chart plus the hover columns."""
    columns = [x, y, color, size, COMPANY, PLACE, STATE, AMOUNT]
    return df.select(*dict.fromkeys(c for c in columns if c))
