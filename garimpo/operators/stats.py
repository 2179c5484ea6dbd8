"""Statistical tests on distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import labels, tails
from garimpo.functions.numbers import ratio
from garimpo.operators.rank import average_ranks, global_rank
from garimpo.schema import AMOUNT, KEY, STATE, SUBSTANCE, scalar_of, sized_broadcast

SMALL_SAMPLE = 5000


def _polynomial(x: Column, *coefficients: float) -> Column:
    """Value of a polynomial, constant term first."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution (Wichura 1988, exact to about 1e-16)."""
    # Coefficients of algorithm AS 241 (PPND16).
    a = (
        3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
        1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
        3.3430575583588128105e4, 2.5090809287301226727e3,
    )
    b = (
        1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
        2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
        5.2264952788528545610e3,
    )
    c = (
        1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
        3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
        2.27238449892691845833e-2, 7.74545014278341407640e-4,
    )
    d = (
        1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
        1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
        1.05075007164441684324e-9,
    )
    e = (
        6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
        2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
        2.71155556874348757815e-5, 2.01033439929228813265e-7,
    )
    f = (
        1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
        7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
        2.04426310338993978564e-15,
    )
    q = p - 0.5
    centre = 0.180625 - q * q
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    near, far = r - 1.6, r - 5.0
    tail = F.when(r <= 5, _polynomial(near, *c) / _polynomial(near, *d)).otherwise(
        _polynomial(far, *e) / _polynomial(far, *f)
    )
    return F.when(
        F.abs(q) <= 0.425, q * _polynomial(centre, *a) / _polynomial(centre, *b)
    ).otherwise(F.when(q < 0, -tail).otherwise(tail))


def shapiro_wilk(df: DataFrame, value: str = AMOUNT, key: str = KEY) -> DataFrame:
    """Shapiro-Wilk test (Royston 1995) for 3 to 4999 values: one row ``(statistic, p_value)``."""
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    stats = scalar_of(rows.agg(F.count("*").alias("n"), F.avg("x").alias("mean")))
    n = stats["n"]
    scored = global_rank(rows, "x", key).select(
        "x", F.col("row_rank").alias("i"), n.alias("n"), (F.col("x") - stats["mean"]).alias("dx")
    ).withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))

    # Sums needed for the weights; the two outermost scores at each end are treated apart.
    def at(position: Column, column: str) -> Column:
        return F.max(F.when(F.col("i") == position, F.col(column)))

    size = F.col("n")
    sums = scored.agg(
        F.max("n").alias("n"),
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum(F.col("dx") * F.col("dx")).alias("ss"),
        F.sum(F.col("m") * F.col("x")).alias("mx"),
        at(size, "m").alias("m_last"), at(size - 1, "m").alias("m_next"),
        at(size, "x").alias("x_last"), at(size - 1, "x").alias("x_next"),
        at(F.lit(1), "x").alias("x_first"), at(F.lit(2), "x").alias("x_second"),
    )
    root = 1 / F.sqrt("n")
    norm = F.sqrt("mm")
    # Royston's polynomials for the outer weights.
    outer = F.col("m_last") / norm + _polynomial(
        root, 0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056
    )
    second = F.col("m_next") / norm + _polynomial(
        root, 0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633
    )
    weights = sums.withColumns({"a1": F.when(F.col("n") == 3, F.sqrt(F.lit(0.5))).otherwise(outer),
                                "a2": F.when(F.col("n") > 5, second)})
    big = F.col("n") > 5
    left = F.col("mm") - 2 * F.pow("m_last", 2.0) - F.when(big, 2 * F.pow("m_next", 2.0)).otherwise(0.0)
    right = 1 - 2 * F.pow("a1", 2.0) - F.when(big, 2 * F.pow("a2", 2.0)).otherwise(0.0)
    scale = F.when(right > 1e-12, F.sqrt(F.greatest(left, F.lit(0.0)) / right))
    ends = F.col("m_last") * (F.col("x_last") - F.col("x_first"))
    nexts = F.when(big, F.col("m_next") * (F.col("x_next") - F.col("x_second"))).otherwise(0.0)
    inner = F.coalesce(F.try_divide(F.col("mx") - ends - nexts, scale), F.lit(0.0))
    linear = (
        F.col("a1") * (F.col("x_last") - F.col("x_first"))
        + F.when(big, F.col("a2") * (F.col("x_next") - F.col("x_second"))).otherwise(0.0)
        + F.when(F.col("n") > 3, inner).otherwise(0.0)
    )
    w = F.coalesce(F.try_divide(linear * linear, F.col("ss")), F.lit(1.0))
    out = weights.select("n", F.least(w, F.lit(1.0)).alias("statistic"))
    # Royston's normalising polynomials (n <= 11 and above).
    ln_n, w1 = F.ln("n"), F.ln(F.greatest(1 - F.col("statistic"), F.lit(1e-99)))
    gamma = _polynomial(F.col("n"), -2.273, 0.459)
    small_z = (
        -F.ln(F.greatest(gamma - w1, F.lit(1e-99)))
        - _polynomial(F.col("n"), 0.5440, -0.39978, 0.025054, -0.0006714)
    ) / F.exp(_polynomial(F.col("n"), 1.3822, -0.77857, 0.062767, -0.0020322))
    large_z = (w1 - _polynomial(ln_n, -1.5861, -0.31082, -0.083751, 0.0038915)) / F.exp(
        _polynomial(ln_n, -0.4803, -0.082676, 0.0030302)
    )
    z = F.when(F.col("n") <= 11, small_z).otherwise(large_z)
    # n = 3 has a closed form
    exact3 = 6 / F.lit(3.141592653589793) * (
        F.asin(F.sqrt("statistic")) - F.asin(F.sqrt(F.lit(0.75)))
    )
    return out.select(
        "statistic",
        F.when(F.col("n") == 3, F.greatest(exact3, F.lit(0.0)))
        .otherwise(tails.normal_p(z))
        .alias("p_value"),
    )


def dagostino(df: DataFrame, value: str = AMOUNT) -> DataFrame:
    """D'Agostino-Pearson K2 from count, skewness and kurtosis: one row."""
    x = F.col(value).cast("double")
    row = df.agg(
        F.count(x).cast("double").alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k")
    )
    n = F.col("n")
    # skewness score
    y = F.col("s") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = (
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
        / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.ln(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    ratio_ = y / alpha
    zs = delta * F.ln(ratio_ + F.sqrt(ratio_ * ratio_ + 1))
    # kurtosis score; Spark's kurtosis is the excess
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x_k = (F.col("k") + 3 - expected) / F.sqrt(variance)
    root_beta1 = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / root_beta1 * (2 / root_beta1 + F.sqrt(1 + 4 / (root_beta1 * root_beta1)))
    denominator = 1 + x_k * F.sqrt(2 / (a - 4))
    term = F.signum(denominator) * F.pow((1 - 2 / a) / F.abs(denominator), 1 / 3)
    zk = (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))
    k2 = zs * zs + zk * zk
    # both scores need a spread; fewer than 8 values give no test
    return row.select(F.when((n >= 8) & F.col("s").isNotNull(), k2).alias("statistic")).withColumn(
        "p_value", F.exp(-F.col("statistic") / 2)
    )


def normality(df: DataFrame, value: str = AMOUNT, key: str = KEY) -> DataFrame:
    """Shapiro-Wilk below 5000 values, D'Agostino from there; too few values give a status."""
    n = df.where(F.col(value).isNotNull()).limit(SMALL_SAMPLE).count()
    if n < 3:
        return df.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("test"),
            F.lit(None).cast("double").alias("statistic"),
            F.lit(None).cast("double").alias("p_value"),
            F.lit(None).cast("boolean").alias("is_normal"),
            F.lit("Dados insuficientes para testes estatísticos").alias("status"),
        )
    small = n < SMALL_SAMPLE
    result = shapiro_wilk(df, value, key) if small else dagostino(df, value)
    return result.select(
        F.lit("Shapiro-Wilk" if small else "D'Agostino").alias("test"),
        "statistic",
        "p_value",
        (F.col("p_value") > 0.05).alias("is_normal"),
        F.lit("ok").alias("status"),
    )


def anova(df: DataFrame, value: str = AMOUNT, by: str = STATE) -> DataFrame:
    """One-way ANOVA over groups of more than one row: one row with F and its p-value.

    Within-group squares come from merged central moments (``var_pop``), which stay accurate
    where plain sums of squares would cancel.
    """
    x = F.col(value).cast("double")
    groups = (
        df.where(F.col(by).isNotNull() & x.isNotNull())
        .groupBy(by)
        .agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
        .where(F.col("n") > 1)
    )
    grand = groups.agg(ratio(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("g")).scalar()
    parts = groups.select("n", "m", "v", grand.alias("g")).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2.0)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f_value = ratio(ratio("between", d1), ratio("within", d2))
    return (
        parts.select(F.when(F.col("k") > 1, f_value).alias("f_statistic"), d1.alias("d1"), d2.alias("d2"))
        .withColumn("p_value", tails.f_p(F.col("f_statistic"), F.col("d1"), F.col("d2")))
        .select("f_statistic", "p_value", (F.col("p_value") < 0.05).alias("significant_difference"))
    )


def kruskal_wallis(df: DataFrame, value: str = AMOUNT, by: str = SUBSTANCE) -> DataFrame:
    """Kruskal-Wallis H with tie correction over groups of more than one row."""
    rows = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).select(by, value)
    sizes = rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    ranks = average_ranks(rows.join(sized_broadcast(sizes.select(by)), by, "left_semi"), value, by)
    parts = ranks.agg(
        F.count("*").alias("k"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("r"),
        F.sum("tie_term").alias("t"),
    )
    n = F.col("n")
    h = 12 / (n * (n + 1)) * F.col("r") - 3 * (n + 1)
    correction = 1 - F.col("t") / (n * n * n - n)
    return (
        parts.select(
            F.when(F.col("k") > 1, F.try_divide(h, correction)).alias("h_statistic"),
            (F.col("k") - 1).alias("dof"),
        )
        .withColumn("p_value", tails.chi2_p(F.col("h_statistic"), F.col("dof")))
        .select("h_statistic", "p_value", (F.col("p_value") < 0.05).alias("significant_difference"))
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every pair of numeric columns as rows ``(x, y, r)``, one scan.

    Rows with a null in either column of a pair do not count for that pair.
    """
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    columns = columns or [c for c, t in df.dtypes if t.startswith(numeric)]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(
        *[
            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")))
    return row.select(F.inline(F.array(*cells)))


def correlation_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r, two-sided p-value and strength label."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    row = both.agg(F.corr(x, y).alias("pearson_r"), (F.count("*") - 2).alias("dof"))
    r = F.col("pearson_r")
    t = r * F.sqrt(F.try_divide(F.col("dof"), F.greatest(1 - r * r, F.lit(1e-300))))
    return row.withColumn("p_value", tails.t_p(t, F.col("dof"))).select(
        "pearson_r", "p_value", labels.correlation(r).alias("interpretation")
    )
