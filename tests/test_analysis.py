"""Tests of statistics, market measures and models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.functions import tails
from garimpo.operators import anomaly, charts, cluster, insights, kpi, market, predict, stats, territory, timeseries
from garimpo.sources import tables


def amounts(spark, values, group="MG"):
    rows = [(i, group if isinstance(group, str) else group[i], float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "op_id long, ESTADO string, CFEM double")


# --- tails and tests -----------------------------------------------------------------------

def test_tail_probabilities_match_tables():
    # table values of the usual distributions
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert tails.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-8)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-8)
    assert tails.normal_tail(1.959963984540054) == pytest.approx(0.025, rel=1e-9)
    assert tails.chi2_tail(2.0, 2) == pytest.approx(math.exp(-1), rel=1e-12)
    assert tails.f_tail(0.0, 3, 4) == 1.0


def test_normal_quantile(spark):
    probs = [1e-10, 0.001, 0.025, 0.3, 0.5, 0.841344746068543, 0.999999]
    df = spark.createDataFrame([(p,) for p in probs], "p double")
    for r in df.select("p", stats.normal_quantile(F.col("p")).alias("z")).collect():
        assert 0.5 * math.erfc(-r.z / math.sqrt(2)) == pytest.approx(r.p, rel=1e-9)


def test_shapiro_on_the_published_example(spark):
    # weights of eleven men (Shapiro and Wilk 1965): W = 0.79
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = stats.shapiro_wilk(amounts(spark, men)).first()
    assert row.statistic == pytest.approx(0.79, abs=0.005)
    assert 0.005 < row.p_value < 0.01
    rng = np.random.default_rng(0)
    assert stats.normality(amounts(spark, rng.normal(size=400))).first().p_value > 0.05
    skewed = stats.normality(amounts(spark, rng.lognormal(0, 1, 400))).first()
    assert skewed.test == "Shapiro-Wilk" and not skewed.is_normal and skewed.p_value < 1e-6
    assert stats.normality(amounts(spark, [1, 2])).first().status != "ok"


def test_shapiro_of_three_values(spark):
    row = stats.shapiro_wilk(amounts(spark, [1.0, 2.0, 4.0])).first()
    # W = (x3 - x1)^2 / 2 / SS
    assert row.statistic == pytest.approx(4.5 / (14 / 3), rel=1e-9)
    assert 0 < row.p_value < 1


def test_dagostino_from_5000(spark):
    rng = np.random.default_rng(3)
    row = stats.normality(amounts(spark, rng.normal(size=6000))).first()
    assert row.test == "D'Agostino" and row.p_value > 0.01
    assert stats.normality(amounts(spark, rng.exponential(size=6000))).first().p_value < 1e-10


def test_anova_and_kruskal_by_hand(spark):
    values = [1, 2, 3, 4, 5, 9, 8, 7, 100]
    group = ["a", "a", "a", "b", "b", "b", "c", "c", "d"]  # d has a single row and drops out
    df = amounts(spark, values, group)
    groups = [np.array([1, 2, 3.0]), np.array([4, 5, 9.0]), np.array([8, 7.0])]
    everything = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - everything.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    row = stats.anova(df, by="ESTADO").first()
    assert row.f_statistic == pytest.approx((between / 2) / (within / 5), rel=1e-10)
    assert row.p_value == pytest.approx(tails.f_tail(row.f_statistic, 2, 5), rel=1e-12)
    # ranks: a 1,2,3; b 4,5,8; c 7,6
    h = 12 / (8 * 9) * (6**2 / 3 + 17**2 / 3 + 13**2 / 2) - 3 * 9
    assert stats.kruskal_wallis(df, by="ESTADO").first().h_statistic == pytest.approx(h, rel=1e-10)


def test_correlation_skips_null_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 100.0)], "a double, b double")
    row = stats.correlation_test(df, "a", "b").first()
    assert row.pearson_r == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1], rel=1e-12)
    assert row.interpretation == "Correlação positiva muito forte"


# --- market --------------------------------------------------------------------------------

def market_rows(spark, totals):
    rows = [(i, f"C{i:03d}", "MG", "FERRO", float(v)) for i, v in enumerate(totals)]
    return spark.createDataFrame(rows, "op_id long, TITULAR string, ESTADO string, PRIMEIRODESUBS string, CFEM double")


def test_concentration_of_equal_firms_and_of_one(spark):
    row = market.concentration(market_rows(spark, [10.0] * 5)).first()
    assert row.hhi == pytest.approx(0.2) and row.cr4 == pytest.approx(0.8) and row.cr8 == pytest.approx(1.0)
    assert row.gini_coefficient == pytest.approx(0.0, abs=1e-12) and row.theil_index == pytest.approx(math.log(5))
    alone = market.concentration(market_rows(spark, [3.0])).first()
    assert (alone.hhi, alone.cr4, alone.gini_coefficient) == (1.0, 1.0, 0.0)
    assert alone.market_interpretation == "Mercado altamente concentrado"


def test_zero_market_has_no_shares(spark):
    row = market.concentration(market_rows(spark, [0.0, 0.0])).first()
    assert row.hhi is None and row.cr4 is None and row.gini_coefficient == 0.0 and row.market_interpretation is None


def test_scale_does_not_matter(spark):
    values = [1.0, 5.0, 9.5, 40.0]
    a = market.concentration(market_rows(spark, values)).first()
    b = market.concentration(market_rows(spark, [v * 1000 for v in values])).first()
    for c in ("hhi", "cr4", "gini_coefficient", "theil_index"):
        assert a[c] == pytest.approx(b[c], rel=1e-12)


def test_benchmark_percentiles_with_ties(spark):
    df = market_rows(spark, [5.0, 5.0, 1.0, 9.0])
    got = {r.EMPRESA: r.cfem_percentile for r in market.benchmark_all(df).collect()}
    assert got == {"C000": 25.0, "C001": 25.0, "C002": 0.0, "C003": 75.0}
    assert market.benchmark(df, "C001").first().cfem_percentile == 25.0
    assert market.benchmark(df, "nobody").count() == 0


def test_ties_take_the_smallest_key(spark):
    df = market_rows(spark, [5.0, 5.0, 5.0])
    assert [r.TITULAR for r in kpi.top_groups(df, "TITULAR", 2).collect()] == ["C000", "C001"]
    assert kpi.report_facts(df).first().maior_empresa == "C000"


def test_top_per_substance_is_whole(spark):
    df = spark.range(3000).select(
        F.col("id").alias("op_id"), F.format_string("C%04d", F.col("id")).alias("TITULAR"),
        F.when(F.col("id") % 3 == 0, "B").otherwise("A").alias("PRIMEIRODESUBS"), F.col("id").cast("double").alias("CFEM"),
    )
    got = {(r.PRIMEIRODESUBS, r["rank"]): r.TITULAR for r in market.top_companies_per_substance(df, 3).collect()}
    assert got == {("A", 1): "C2999", ("A", 2): "C2998", ("A", 3): "C2996", ("B", 1): "C2997", ("B", 2): "C2994", ("B", 3): "C2991"}


# --- time ----------------------------------------------------------------------------------

def test_missing_months_and_zero_growth_base(spark):
    df = spark.createDataFrame(
        [("2020-01-15", 10.0), ("2020-03-01", 30.0), ("2020-03-02", None), ("2020-04-01", 0.0), ("2020-05-01", 20.0)],
        "d string, CFEM double",
    ).withColumn("DATA", F.to_date("d"))
    rows = timeseries.monthly_growth(df).orderBy("month").collect()
    assert [r.period for r in rows] == ["2020-01", "2020-03", "2020-04", "2020-05"]
    assert [r.growth_rate for r in rows] == [None, 200.0, -100.0, None]
    assert timeseries.trend(df).first().trend_slope == pytest.approx(np.polyfit(range(4), [10, 30, 0, 20], 1)[0])
    single = timeseries.trend(df.limit(1)).first()
    assert single.trend_slope == 0.0 and single.status != "ok"


# --- models --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sample(spark):
    from garimpo.schema import stage

    return stage(tables.sample_operations(spark, 400))


def test_kmeans_finds_planted_groups(spark):
    rng = np.random.default_rng(0)
    centres = [(0.0, -60.0, -30.0), (50.0, -40.0, 0.0), (100.0, -50.0, -15.0)]
    rows = [
        (i, "C", "MG", "FERRO", *map(float, np.array(centres[i % 3]) + rng.normal(0, 0.1, 3))) for i in range(150)
    ]
    df = spark.createDataFrame(rows, "op_id long, TITULAR string, ESTADO string, PRIMEIRODESUBS string, CFEM double, LONGITUDE double, LATITUDE double")
    out = cluster.kmeans(df, k_max=5, restarts=2)
    assert out["optimal_k"] == 3
    inertia = [r.inertia for r in out["search"].orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)
    groups = out["labelled"].select((F.col("op_id") % 3).alias("g"), "Cluster_KMeans").distinct().count()
    assert groups == 3
    assert sum(r["size"] for r in cluster.cluster_profile(out["labelled"]).collect()) == 150


def test_kmeans_search_against_brute_force(sample, monkeypatch):
    scans = []
    scan = cluster._scan
    monkeypatch.setattr(cluster, "_scan", lambda *a: scans.append(len(a[2])) or scan(*a))
    out = cluster.kmeans(sample, k_max=5, restarts=3)
    # all twelve models are fitted by the same passes, and drop out when they settle
    assert scans[0] == scans[-1] == 12 and scans[-2] < 12 and len(scans) < 102
    z = out["labelled"].select("z_CFEM", "z_LONGITUDE", "z_LATITUDE").toPandas().to_numpy()
    assert sorted(out["models"]) == [2, 3, 4, 5]
    for r in out["search"].collect():
        centres = out["models"][r.k].centres
        away = ((z[:, None, :] - centres[None]) ** 2).sum(2)
        near = away.argmin(1)
        assert r.inertia == pytest.approx(away.min(1).sum(), rel=1e-9)
        for c in range(r.k):  # every centre is the mean of its rows
            assert centres[c] == pytest.approx(z[near == c].mean(0), abs=2e-2)
        apart = ((z[:, None, :] - z[None]) ** 2).sum(2)
        scores = []
        for i in range(len(z)):
            means = [apart[i, near == c].sum() / max(1, (near == c).sum() - (near[i] == c)) for c in range(r.k)]
            a, b = means[near[i]], min(m for c, m in enumerate(means) if c != near[i])
            scores.append((b - a) / max(a, b) if (near == near[i]).sum() > 1 else 0.0)
        assert r.silhouette == pytest.approx(np.mean(scores), rel=1e-6)
    labels = {r.Cluster_KMeans for r in out["labelled"].select("Cluster_KMeans").distinct().collect()}
    assert len(labels) == out["optimal_k"]


def test_kmeans_leaves_out_rows_without_a_company(spark):
    rows = [(i, None if i == 7 else "C", "MG", "FERRO", float(i % 5), float(i), 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "op_id long, TITULAR string, ESTADO string, PRIMEIRODESUBS string, CFEM double, LONGITUDE double, LATITUDE double")
    out = cluster.kmeans(df, restarts=1)
    assert out["labelled"].count() == 8 and max(out["models"]) == 7
    assert max(cluster.kmeans(df, restarts=1, half_range=True)["models"]) == 3
    with pytest.raises(ValueError):
        cluster.kmeans(df.limit(2), restarts=1)


def test_elbow_rules(spark):
    curve = spark.createDataFrame([(2, 100.0), (3, 40.0), (4, 30.0), (5, 25.0)], "k int, inertia double")
    assert cluster.elbow(curve).first().optimal_k == 3
    assert cluster.elbow(curve.limit(2)).first().optimal_k == 2


def test_pca(sample):
    out = cluster.principal_components(sample)
    rows = out["variance"].orderBy("component").collect()
    assert sum(r.ratio for r in rows) == pytest.approx(1.0)
    z = cluster.scaled(sample).select("z_CFEM", "z_LONGITUDE", "z_LATITUDE").toPandas().to_numpy()
    eigen = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert [r.ratio for r in rows] == pytest.approx(list(eigen / eigen.sum()), rel=1e-9)
    biggest = out["loadings"].groupBy("component").agg(F.max_by("loading", F.abs("loading")).alias("l")).collect()
    assert all(r.l > 0 for r in biggest)


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0)], "a double, b double")
    got = [tuple(r) for r in cluster.scaled(df, ("a", "b")).select("z_a", "z_b").collect()]
    a = np.array([1, 2, 4.0])
    assert [g[0] for g in got] == pytest.approx(list((a - a.mean()) / a.std()))
    assert all(g[1] == 0.0 for g in got)


def test_isolation_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "C", float(a), float(x), float(y)) for i, (a, x, y) in enumerate(rng.normal(size=(500, 3)))]
    rows += [(1000 + i, "ODD", 30.0 + i, 30.0, -30.0) for i in range(5)]
    df = spark.createDataFrame(rows, "op_id long, TITULAR string, CFEM double, LONGITUDE double, LATITUDE double")
    out = anomaly.detect(df)
    worst = {r.op_id for r in out.orderBy("Anomaly_Score").limit(5).collect()}
    assert worst == {1000 + i for i in range(5)}
    row = anomaly.summary(out).first()
    assert row.total_anomalies == pytest.approx(min(0.1, 50 / 505) * 505, abs=2)
    again = anomaly.detect(df.repartition(13))
    a = {r.op_id: r.Anomaly_Score for r in out.collect()}
    assert a == {r.op_id: r.Anomaly_Score for r in again.collect()}
    assert {r.TITULAR for r in anomaly.top_companies(out).collect()} == {"ODD"}


def test_average_path_length():
    assert [anomaly.mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert anomaly.mean_path(256) == pytest.approx(10.244770920, rel=1e-6)


def test_random_forest_learns_and_encodes_alphabetically(spark):
    df = spark.range(600).select(
        F.col("id").alias("op_id"), F.when(F.col("id") % 2 == 0, "PA").otherwise("MG").alias("ESTADO"),
        F.lit("FERRO").alias("PRIMEIRODESUBS"), (F.col("id") % 40 - 70).cast("double").alias("LONGITUDE"),
        (F.col("id") % 30 - 30).cast("double").alias("LATITUDE"),
    ).withColumn("CFEM", F.when(F.col("ESTADO") == "PA", 1000.0).otherwise(10.0) + F.col("LONGITUDE"))
    assert {r.ESTADO: r.code for r in predict.codes(df, "ESTADO").collect()} == {"MG": 0, "PA": 1}
    out = predict.random_forest(df, trees=10, max_depth=6)
    row = out["metrics"].first()
    assert row.test_r2 > 0.95 and row.prediction_reliability == "Alta confiabilidade"
    assert row.train_size + row.test_size == 600 and 0.2 < row.test_size / 600 < 0.4
    importance = out["importance"].collect()
    assert importance[0].feature == "ESTADO" and sum(r.importance for r in importance) == pytest.approx(1.0)


def test_search_for_a_noise_free_radius(spark):
    rows = [(i, float(i % 2) * 100 + (i // 2) * 0.1, -50.0, -10.0) for i in range(20)]
    df = spark.createDataFrame(rows, "op_id long, CFEM double, LONGITUDE double, LATITUDE double")
    row = cluster.dbscan_search(df, radii=(0.1, 0.2, 1.9))["summary"].first()
    assert (row.n_clusters, row.n_noise, row.eps) == (2, 0, 0.1) and row.silhouette_score > 0.9


# --- charts and reports --------------------------------------------------------------------

def test_histogram_counts_every_row_once(sample):
    rows = charts.histogram(sample).collect()
    assert sum(r["count"] for r in rows) == 400 and max(r.bin for r in rows) == 29
    flat = charts.histogram(sample.withColumn("CFEM", F.lit(5.0))).collect()
    assert [(r.bin, r["count"]) for r in flat] == [(0, 400)]


def test_tiles_add_up(sample):
    rows = charts.marker_tiles(sample).groupBy("zoom").agg(F.sum("markers").alias("n")).collect()
    assert {r.n for r in rows} == {400}


def test_recommendations(spark):
    facts = spark.createDataFrame(
        [("Mercado altamente concentrado", 11.0, 0.6, 6), ("x", 10.0, 0.5, 5)],
        "concentration_level string, anomaly_rate double, regional_dominance double, optimal_clusters int",
    )
    assert [len(r.recommendations) for r in insights.recommendations(facts).collect()] == [4, 0]


def test_territory_of_regions(spark):
    df = spark.createDataFrame(
        [("A", "M1", "MG", "F", 75.0), ("A", "M2", "PA", "O", 25.0), ("B", "M3", "ZZ", "O", 100.0)],
        "TITULAR string, `MUNICIPIO(S)` string, ESTADO string, PRIMEIRODESUBS string, CFEM double",
    )
    got = {r.level: r.hhi for r in territory.territorial_hhi(df).collect()}
    assert got == {"state": pytest.approx(0.75**2 / 4 + 0.25**2 / 4 + 0.25), "region": pytest.approx(0.625)}
    assert {r.REGIAO for r in territory.region_table(df).collect()} == {"Sudeste", "Norte"}
