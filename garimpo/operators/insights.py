"""Rule-based insights and the assembled reports.

Reports are dictionaries of DataFrames, evaluated only when read or written.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import labels
from garimpo.operators import anomaly, charts, cluster, geo, kpi, market, predict, stats, territory, timeseries
from garimpo.operators.runner import Part, run_plan
from garimpo.schema import AMOUNT, CLUSTER_MIN_SAMPLES, COMPANY, DATE, KEY, LAT, LON, PLACE, STATE, SUBSTANCE, scalar_of, stage
from garimpo.sources.export import flat
from garimpo.sources.tables import write_csv, write_json


def recommendations(facts: DataFrame, *keys: str) -> DataFrame:
    """Texts of the rules that apply to a row of facts, as an array, with the row's ``keys``."""
    # Rule thresholds and texts.
    rules = [
        (F.col("concentration_level") == "Mercado altamente concentrado",
         "Considerar políticas antitruste para promover maior competição"),
        (F.col("anomaly_rate") > 10, "Investigar operações anômalas para garantir compliance"),
        (F.col("regional_dominance") > 0.5,
         "Diversificar geograficamente para reduzir dependência regional"),
        (F.col("optimal_clusters") > 5, "Segmentar estratégias por clusters identificados"),
    ]
    texts = F.array(*[F.when(condition, text) for condition, text in rules])
    return facts.select(*keys, F.filter(texts, lambda t: t.isNotNull()).alias("recommendations"))


def insight_facts(
    df: DataFrame, clusters: dict | None, detected: DataFrame | None, model: dict | None, structure: DataFrame | None
) -> DataFrame:
    """One row that brings the findings of the other analyses together; those of one that is None are null."""

    def none(kind: str):
        return F.lit(None).cast(kind)

    facts = {
        "optimal_clusters": none("int"), "dominant_cluster": none("int"), "anomaly_rate": none("double"),
        "high_value_anomalies": none("array<string>"), "anomaly_impact": none("string"), "model_accuracy": none("double"),
        "most_important_features": none("array<string>"), "prediction_reliability": none("string"),
        "concentration_level": none("string"), "top_player_dominance": none("double"),
        "market_inequality": none("double"), "competitive_assessment": none("string"),
    }
    if clusters is not None:
        largest = clusters["labelled"].groupBy("Cluster_KMeans").agg(F.count("*").alias("n")).agg(
            F.min(F.struct((-F.col("n")).alias("n"), F.col("Cluster_KMeans").alias("c"))).alias("b")
        )
        facts |= {"optimal_clusters": F.lit(clusters["optimal_k"]), "dominant_cluster": largest.select("b.c").scalar()}
    if detected is not None:
        odd = scalar_of(anomaly.summary(detected))
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("CFEM")).alias("less"), "TITULAR")))
        names = anomaly.top_companies(detected).agg(F.transform(ranked, lambda x: x["TITULAR"]).alias("c"))
        facts |= {
            "anomaly_rate": odd["anomaly_percentage"], "high_value_anomalies": names.scalar(),
            "anomaly_impact": odd["anomaly_impact"],
        }
    if model is not None:
        m = scalar_of(model["metrics"])
        best = model["importance"].limit(3).agg(F.collect_list("feature").alias("f"))
        facts |= {
            "model_accuracy": m["test_r2"], "most_important_features": best.scalar(),
            "prediction_reliability": m["prediction_reliability"],
        }
    if structure is not None:
        s = scalar_of(structure)
        facts |= {
            "concentration_level": s["market_interpretation"], "top_player_dominance": s["cr4"],
            "market_inequality": s["gini_coefficient"], "competitive_assessment": labels.competition(s["hhi"], s["cr4"]),
        }
    g, b = scalar_of(territory.geographic_insights(df)), scalar_of(territory.substance_insights(df))
    row = df.sparkSession.range(1).select(
        *[value.alias(name) for name, value in facts.items()],
        *[g[c].alias(c) for c in ("leading_state", "most_diverse_state", "geographic_concentration", "regional_dominance")],
        *[b[c].alias(c) for c in ("most_valuable_substance", "highest_average_value", "substance_diversity", "concentration_by_substance")],
    )
    row = stage(row)
    return row.select("*", recommendations(row).scalar().alias("recommendations"))


def analysis_parts(restarts: int = 10, trees: int = 100, max_depth: int = 10) -> list[Part]:
    """The parts of the comprehensive analysis with their guards."""

    def clustering(df, got):
        found = cluster.kmeans(df, restarts=restarts)
        return {
            "_clusters": found, "kmeans_search": found["search"], "kmeans_profile": cluster.cluster_profile(found["labelled"]),
        }

    def components(df, got):
        found = cluster.principal_components(df)
        return {"pca_variance": found["variance"], "pca_loadings": found["loadings"]}

    def anomalies(df, got):
        detected = stage(anomaly.detect(df))
        return {
            "_detected": detected, "anomaly_summary": anomaly.summary(detected),
            "anomaly_companies": anomaly.top_companies(detected),
        }

    def predictions(df, got):
        model = predict.random_forest(df, trees=trees, max_depth=max_depth)
        return {"_model": model, "model_metrics": model["metrics"], "feature_importance": model["importance"]}

    def series(df, got):
        return {"time_series": timeseries.trend(df), "monthly": timeseries.monthly_growth(df), "seasonal": timeseries.seasonal(df)}

    def insights(df, got):
        return {
            "insights": insight_facts(
                df, got.get("_clusters"), got.get("_detected"), got.get("_model"), got.get("market_concentration")
            )
        }

    # The least numbers of rows.
    named = (AMOUNT, LON, LAT, COMPANY, STATE, SUBSTANCE)
    return [
        Part("clustering", clustering, named, 5),
        Part("density_clustering", lambda df, got: {"dbscan_summary": cluster.dbscan_search(df)["summary"]}, named, 5),
        Part("components", components, named, 5),
        Part("anomalies", anomalies, (AMOUNT, LON, LAT), 5, present=(KEY, COMPANY)),
        Part("predictions", predictions, (LON, LAT, STATE, SUBSTANCE, AMOUNT), 10),
        Part("market", lambda df, got: {"market_concentration": stage(market.concentration(df))}, (COMPANY, AMOUNT), 1),
        Part("normality", lambda df, got: {"normality": stats.normality(df)}, (AMOUNT,), 3),
        Part("anova", lambda df, got: {"anova_states": stats.anova(df)}, (STATE, AMOUNT), 2),
        Part("kruskal", lambda df, got: {"kruskal_substances": stats.kruskal_wallis(df)}, (SUBSTANCE, AMOUNT), 2),
        Part("correlation", lambda df, got: {"correlation": stats.correlation_matrix(df)}, (AMOUNT, LON, LAT), 2),
        Part("time_series", series, (DATE, AMOUNT), 1),
        Part(
            "insights", insights, (COMPANY, STATE, SUBSTANCE, AMOUNT), 1,
            ("clustering", "anomalies", "predictions", "market"), tolerant=True,
        ),
    ]


def analysis(df: DataFrame, workers: int = 4, **options) -> dict[str, DataFrame]:
    """All analyses that the table allows, and a ``status`` row for each: see ``runner.run_plan``.

    Too few complete rows, a missing column or an error in a part end that part alone; insights
    then lack its findings. ``comprehensive`` raises instead.
    """
    return run_plan(df, analysis_parts(**options), workers)


def comprehensive(df: DataFrame, **options) -> dict[str, DataFrame]:
    """All analyses of one table, lazily; errors are raised."""
    return build_all(df, [p for p in analysis_parts(**options) if p.name != "time_series" or DATE in df.columns])


def build_all(df: DataFrame, parts: list[Part], workers: int = 4) -> dict[str, DataFrame]:
    """The tables of all parts without guards. ``df`` is written once and read by every part.

    Up to ``workers`` parts are built at a time: most of their jobs are too small to fill a cluster.
    """
    df = stage(df)
    got: dict = {}
    ends: dict[str, Future] = {}

    def run(part: Part) -> dict:
        # earlier parts were begun earlier, so waiting for them cannot block all workers
        for name in part.after:
            ends[name].result()
        out = part.build(df, got)
        got.update(out)
        return out

    with ThreadPoolExecutor(workers) as pool:
        for p in parts:
            ends[p.name] = pool.submit(inheritable_thread_target(df.sparkSession)(run), p)
    # in the order of the parts, whichever ended first
    got = {name: table for end in ends.values() for name, table in end.result().items()}
    return {name: table for name, table in got.items() if not name.startswith("_")}


def spatial_parts(eps_km: float = 50.0, radius_km: float = 100.0) -> list[Part]:
    """The parts of the spatial report with their guards."""
    place = (LON, LAT)

    def basic(df, got):
        return {"dispersion": stage(geo.dispersion(df)), "density": geo.density(df), "quadrants": geo.quadrants(df)}

    def clustering(df, got):
        found = stage(cluster.spatial_dbscan(df, eps_km))
        return {
            "clustering": found, "cluster_counts": stage(cluster.dbscan_counts(found)), "cluster_profile": cluster.spatial_profile(found),
        }

    def hotspots(df, got):
        hot = stage(geo.hotspot_scores(df, radius_km=radius_km))
        return {"hotspots": hot, "hotspot_table": geo.hotspot_table(hot), "top_hotspots": geo.top_hotspots(hot)}

    def accessibility(df, got):
        return {
            "accessibility": geo.with_accessibility(df), "accessibility_table": geo.accessibility_table(df),
            "accessibility_correlation": geo.accessibility_correlation(df),
        }

    def regions(df, got):
        return {
            "states": territory.state_table(df), "regions": territory.region_table(df),
            "territorial_hhi": territory.territorial_hhi(df), "most_diversified": territory.most_diversified(df),
        }

    def autocorrelation(df, got):
        rows = geo.row_sums(df)
        return {"autocorrelation": geo.moran(df, rows=rows), "simple_autocorrelation": geo.simple_moran(df, rows=rows)}

    def summary(df, got):
        return {
            "executive_summary": executive_summary(
                got["dispersion"], got["cluster_counts"], got["hotspots"], geo.mean_accessibility(df)
            )
        }

    # The least numbers of rows.
    return [
        Part("distribution", basic, place, 1),
        Part("clustering", clustering, place, CLUSTER_MIN_SAMPLES, present=(KEY, AMOUNT, COMPANY, SUBSTANCE)),
        Part("hotspots", hotspots, (*place, AMOUNT), 5, present=(KEY, COMPANY, PLACE, STATE, SUBSTANCE)),
        Part("accessibility", accessibility, (*place, AMOUNT), 1, present=(COMPANY, STATE)),
        Part("territory", regions, (STATE, COMPANY, AMOUNT), 1, present=(SUBSTANCE,)),
        Part("autocorrelation", autocorrelation, (*place, AMOUNT), 5, present=(KEY,)),
        Part("executive_summary", summary, place, 1, ("distribution", "clustering", "hotspots", "accessibility")),
    ]


def spatial_analysis(df: DataFrame, workers: int = 4, **options) -> dict[str, DataFrame]:
    """All spatial analyses that the table allows, and a ``status`` row for each part."""
    return run_plan(df, spatial_parts(**options), workers)


def spatial_report(df: DataFrame, eps_km: float = 50.0, radius_km: float = 100.0) -> dict[str, DataFrame]:
    """All spatial analyses of one table and their executive summary; errors are raised."""
    return build_all(df, spatial_parts(eps_km, radius_km))


def executive_summary(basic: DataFrame, counts: DataFrame, hot: DataFrame, distance: DataFrame) -> DataFrame:
    """Four sentences, as one row, from one-row results and the hotspot categories."""
    share = hot.agg(
        F.coalesce(F.avg(F.col("Hotspot_Category").isin("Hot", "Very Hot").cast("double")) * 100, F.lit(0.0)).alias("pct")
    )
    return basic.sparkSession.range(1).select(
        labels.dispersion(basic.select("dispersion_index").scalar()).alias("distribuicao"),
        labels.cluster_count(counts.select("n_clusters").scalar()).alias("clustering"),
        F.format_string("%.1f%% das áreas são hotspots de alta atividade", share.scalar()).alias("hotspots"),
        labels.mean_distance(distance.scalar()).alias("acessibilidade"),
    )


def chart_bundles(df: DataFrame) -> dict[str, dict[str, DataFrame]]:
    """Which chart tables belong on which dashboard; expects an enriched table."""
    out = {
        "executive": {
            "kpis": kpi.kpi_cards(df), "top_companies": kpi.top_groups(df, "TITULAR", 15),
            "geography": charts.region_state_tree(df), "substances": charts.substance_table(df),
        },
        "geospatial": {
            "heatmap": charts.heat_cells(df), "clusters": charts.marker_tiles(df),
            "regional": charts.region_chart(df),
        },
        "statistical": {
            "histogram": charts.histogram(df), "log_histogram": charts.histogram(df, log=True),
            "boxplots": charts.category_boxes(df), "correlation": stats.correlation_matrix(df),
            "concentration": market.lorenz(df),
        },
        "advanced": {
            "efficiency": charts.efficiency_chart(df), "portfolio": charts.portfolio(df),
            "market_share": market.top_companies_per_substance(df),
            "hhi": market.hhi_by_substance(df), "density": charts.state_density(df),
        },
    }
    if DATE in df.columns:
        # on two dashboards, made once
        out["executive"]["timeline"] = out["advanced"]["timeline"] = stage(timeseries.timeline(df))
    return out


# --- export --------------------------------------------------------------------------------

ROW_LEVEL = ("clustering", "hotspots", "accessibility")


def export_spatial(report: dict[str, DataFrame], path: str) -> list[str]:
    """Row-level tables as CSV folders, everything else as JSON folders; returns the folders."""
    written = []
    for name, table in report.items():
        target = f"{path}/{name}"
        if name in ROW_LEVEL:
            write_csv(table, target)
        else:
            write_json(table, target)
        written.append(target)
    return written


def export_results(results: dict, path: str, workers: int = 4) -> list[str]:
    """Every DataFrame of a (nested) result as a JSON folder, up to ``workers`` at a time; models and scalars are left out."""
    tables = {f"{path}/{name}": table for name, table in flat(results).items()}
    if tables:
        spark = next(iter(tables.values())).sparkSession
        with ThreadPoolExecutor(workers) as pool:
            list(pool.map(inheritable_thread_target(spark)(lambda target: write_json(tables[target], target)), tables))
    return list(tables)
