"""Queries: clustering, anomalies, prediction, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from garimpo.functions import labels
from garimpo.functions.numbers import total
from garimpo.operators import anomaly, cluster, insights, predict, runner
from garimpo.plans.base import (
    MEAN, REGISTRY, TOTAL, enriched_rows, operations, ops, query, rounded, sites, sites_sql,
)
from garimpo.plans import reporting  # noqa: F401  (fills the registry)
from garimpo.plans.preparation import _scratch
from garimpo.schema import stage
from garimpo.sources import export, tables


@query("p25_z_scores", ops("""SELECT op_id, round((CFEM - mc) / sc, 6) AS "z_CFEM", round((LONGITUDE - mx) / sx, 6) AS "z_LONGITUDE",
  round((LATITUDE - my) / sy, 6) AS "z_LATITUDE" FROM operations, (SELECT avg(CFEM) AS mc, stddev_pop(CFEM) AS sc,
  avg(LONGITUDE) AS mx, stddev_pop(LONGITUDE) AS sx, avg(LATITUDE) AS my, stddev_pop(LATITUDE) AS sy FROM operations)"""))
def _(spark, sf):
    out = cluster.scaled(operations(spark, sf)).select("op_id", "z_CFEM", "z_LONGITUDE", "z_LATITUDE")
    return rounded(out, z_CFEM=6, z_LONGITUDE=6, z_LATITUDE=6)


@query("p26_label_codes", ops("""SELECT op_id, dense_rank() OVER (ORDER BY PRIMEIRODESUBS) - 1 AS "PRIMEIRODESUBS_code" FROM operations"""))
def _(spark, sf):
    return predict.encode(operations(spark, sf).select("op_id", "PRIMEIRODESUBS"), "PRIMEIRODESUBS").select(
        "op_id", "PRIMEIRODESUBS_code"
    )


# --- K-means and components ----------------------------------------------------------------

@query("m2_m4_kmeans_search")
def _(spark, sf):
    return cluster.kmeans(operations(spark, sf))["search"]


@query("m3_elbow", """SELECT CAST(k AS INTEGER) AS optimal_k FROM (
  SELECT k, lag(i) OVER (ORDER BY k) - 2 * i + lead(i) OVER (ORDER BY k) AS bend FROM (
    SELECT p_size AS k, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / (p_size * p_size) AS i FROM part
    GROUP BY 1)) WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1""")
def _(spark, sf):
    """The elbow rule on a falling curve derived from the part table."""
    size = F.col("p_size")
    curve = spark.read.parquet(f"{sf}/part.parquet").groupBy(size.alias("k")).agg(
        (F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double") / (F.first(size) * F.first(size))).alias("inertia")
    )
    return cluster.elbow(curve)


@query("m1_a31_cluster_profile")
def _(spark, sf):
    return cluster.cluster_profile(cluster.kmeans(sites(spark, sf))["labelled"])


@query("m2b_a31b_cluster_table")
def _(spark, sf):
    return cluster.cluster_table(cluster.kmeans(sites(spark, sf), half_range=True)["labelled"])


@query("m2b_centroids")
def _(spark, sf):
    return cluster.centroids(cluster.kmeans(sites(spark, sf), half_range=True)["model"], spark)


@query("m3_elbow_of_inertias")
def _(spark, sf):
    """The elbow rule on the inertias of the K-means search over all sites."""
    return cluster.elbow(cluster.kmeans(sites(spark, sf))["search"])


# the profile operators on a grouping both engines can state
PROFILE_SQL = sites_sql(f""", lab AS (SELECT *, op_id % 7 AS c FROM sites),
mode_state AS (SELECT c, ESTADO AS v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, ESTADO) AS r FROM lab GROUP BY 1, 2),
mode_sub AS (SELECT c, PRIMEIRODESUBS AS v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, PRIMEIRODESUBS) AS r FROM lab GROUP BY 1, 2)
""")


def _labelled(spark, sf):
    return sites(spark, sf).withColumn("c", F.col("op_id") % 7)


@query("a31_n9_profile_of_groups", PROFILE_SQL + f"""SELECT c, count(*) AS size, round({MEAN}, 4) AS avg_cfem, count(DISTINCT ESTADO) AS geographic_spread,
  (SELECT v FROM mode_state s WHERE s.c = lab.c AND r = 1) AS dominant_state,
  (SELECT v FROM mode_sub s WHERE s.c = lab.c AND r = 1) AS dominant_substance FROM lab GROUP BY c""")
def _(spark, sf):
    return rounded(cluster.cluster_profile(_labelled(spark, sf), "c"), avg_cfem=4)


@query("a31b_table_of_groups", PROFILE_SQL + f"""SELECT c, count(CFEM) AS count, round({MEAN}, 4) AS mean, round({TOTAL}, 2) AS sum,
  count(DISTINCT TITULAR) AS companies, count(DISTINCT ESTADO) AS states, count(DISTINCT PRIMEIRODESUBS) AS substances FROM lab GROUP BY c""")
def _(spark, sf):
    return rounded(cluster.cluster_table(_labelled(spark, sf), "c"), mean=4, sum=2)


@query("a32_spatial_profile_of_groups", PROFILE_SQL + f"""SELECT c, count(*) AS size, round({TOTAL}, 2) AS total_cfem, round({MEAN}, 4) AS avg_cfem,
  count(DISTINCT TITULAR) AS num_companies, round(avg(LATITUDE), 6) AS center_lat, round(avg(LONGITUDE), 6) AS center_lon,
  round(max(LATITUDE) - min(LATITUDE), 6) AS lat_range, round(max(LONGITUDE) - min(LONGITUDE), 6) AS lon_range,
  (SELECT v FROM mode_sub s WHERE s.c = lab.c AND r = 1) AS dominant_substance FROM lab GROUP BY c""")
def _(spark, sf):
    return rounded(
        cluster.spatial_profile(_labelled(spark, sf), "c"), total_cfem=2, avg_cfem=4, center_lat=6, center_lon=6,
        lat_range=6, lon_range=6,
    )


@query("m6_w9_pca_variance")
def _(spark, sf):
    return cluster.principal_components(operations(spark, sf))["variance"]


@query("m6_pca_loadings")
def _(spark, sf):
    return cluster.principal_components(operations(spark, sf))["loadings"]


@query("m6_pca_projection")
def _(spark, sf):
    return cluster.principal_components(operations(spark, sf))["projected"].select("op_id", "pc1", "pc2", "pc3")


# --- DBSCAN --------------------------------------------------------------------------------

@query("m5_dbscan_search")
def _(spark, sf):
    return cluster.dbscan_search(sites(spark, sf))["summary"]


@query("g1_j6_spatial_dbscan")
def _(spark, sf):
    return cluster.spatial_dbscan(sites(spark, sf)).select("op_id", "Spatial_Cluster", "Is_Noise")


@query("g1_strict_dbscan")
def _(spark, sf):
    return cluster.spatial_dbscan(sites(spark, sf), eps_km=10.0, strict=True).select("op_id", "Spatial_Cluster", "Is_Noise")


@query("g1_dbscan_of_operations")
def _(spark, sf):
    """Cluster counts over the whole fact table."""
    return cluster.dbscan_counts(cluster.spatial_dbscan(operations(spark, sf), eps_km=20.0, min_samples=10))


@query("a32_spatial_cluster_profile")
def _(spark, sf):
    return cluster.spatial_profile(cluster.spatial_dbscan(sites(spark, sf), eps_km=100.0))


# --- anomalies and prediction --------------------------------------------------------------

@query("m7_isolation_forest")
def _(spark, sf):
    return anomaly.detect(operations(spark, sf)).select("op_id", "Anomaly_Score", "Anomaly_Label", "Is_Anomaly")


@query("m8_r3_anomaly_summary")
def _(spark, sf):
    return anomaly.summary(anomaly.detect(operations(spark, sf)))


@query("m7_fixed_contamination")
def _(spark, sf):
    return anomaly.summary(anomaly.detect(operations(spark, sf), contamination=0.1))


@query("t5_anomalous_companies")
def _(spark, sf):
    return anomaly.top_companies(anomaly.detect(operations(spark, sf)))


@query("t12_train_test_split")
def _(spark, sf):
    return predict.split(operations(spark, sf)).groupBy("is_test").agg(F.count("*").alias("n"))


@query("m9_m10_r4_random_forest")
def _(spark, sf):
    return predict.random_forest(operations(spark, sf))["metrics"]


@query("m11_feature_importance")
def _(spark, sf):
    return predict.random_forest(sites(spark, sf))["importance"]


@query("m11_test_predictions")
def _(spark, sf):
    return predict.random_forest(sites(spark, sf))["predicted"].where("is_test").select("op_id", "CFEM", "prediction")


# --- reports -------------------------------------------------------------------------------

@query("g11_spatial_report")
def _(spark, sf):
    """Every table of the spatial report with its number of rows."""
    report = insights.spatial_report(sites(spark, sf))
    counts = None
    for name, table in report.items():
        part = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query("g12_executive_summary")
def _(spark, sf):
    return insights.spatial_report(sites(spark, sf))["executive_summary"]


@query("s7_s8_spatial_export")
def _(spark, sf):
    """Every table of the report written and read back, row-level tables as CSV, the others as JSON."""
    path = _scratch(spark, "spatial")
    counts = None
    for target in insights.export_spatial(insights.spatial_report(sites(spark, sf)), path):
        name = target.rsplit("/", 1)[1]
        if name in insights.ROW_LEVEL:
            table = tables.read_csv(spark, target, sep=",")
        else:
            table = spark.read.schema("row string").text(target)
        part = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    return counts


# facts of every municipality, spread so that each rule fires for some and not for others
@query("r7_recommendations", ops(f"""SELECT place,
  CASE WHEN h >= 0.25 THEN 'Considerar políticas antitruste para promover maior competição;' ELSE '' END
  || CASE WHEN a > 10 THEN 'Investigar operações anômalas para garantir compliance;' ELSE '' END
  || CASE WHEN d > 0.5 THEN 'Diversificar geograficamente para reduzir dependência regional;' ELSE '' END
  || CASE WHEN k > 5 THEN 'Segmentar estratégias por clusters identificados;' ELSE '' END AS recommendations
FROM (SELECT place, sum(t * t) / (sum(t) * sum(t)) AS h, max(t) / sum(t) AS d, sum(big) * 100.0 / sum(n) AS a, sum(n) % 11 AS k
  FROM (SELECT "MUNICIPIO(S)" AS place, TITULAR, {TOTAL} AS t, count(*) AS n, count(*) FILTER (WHERE CFEM > 4000000) AS big
        FROM operations GROUP BY 1, 2) GROUP BY 1)"""))
def _(spark, sf):
    shares = operations(spark, sf).groupBy(F.col("MUNICIPIO(S)").alias("place"), "TITULAR").agg(
        total("CFEM").alias("t"), F.count("*").alias("n"), F.count_if(F.col("CFEM") > 4_000_000).alias("big")
    )
    facts = shares.groupBy("place").agg(
        labels.market_concentration(F.sum(F.col("t") * F.col("t")) / (F.sum("t") * F.sum("t"))).alias("concentration_level"),
        (F.max("t") / F.sum("t")).alias("regional_dominance"),
        (F.sum("big") * 100.0 / F.sum("n")).alias("anomaly_rate"), (F.sum("n") % 11).alias("optimal_clusters"),
    )
    return insights.recommendations(facts, "place").select(
        "place", F.concat_ws("", F.transform("recommendations", lambda t: F.concat(t, F.lit(";")))).alias("recommendations")
    )


@query("r8_r9_comprehensive_insights")
def _(spark, sf):
    report = insights.comprehensive(sites(spark, sf))
    return report["insights"]


def _least_sql(parts) -> str:
    """A row per municipality and part, from the counts of complete rows."""
    return "\nUNION ALL BY NAME ".join(
        f"""SELECT "MUNICIPIO(S)" AS place, '{p.name}' AS part, {p.least} AS needed, count(*) FILTER (WHERE {" AND ".join(
            f'"{c}" IS NOT NULL' for c in p.columns)}) AS rows FROM thinned GROUP BY 1""" for p in parts
    )


# amounts and places are blanked for some sites, so that guards hold in some municipalities only
R9_BLANK = (("CFEM", 3), ("LONGITUDE", 4), ("ESTADO", 2), ("TITULAR", 5))


@query("r9_part_guards", sites_sql(f""", thinned AS (SELECT * REPLACE ({", ".join(
    f"CASE WHEN op_id % 40 > 10 AND op_id % {m} > 0 THEN NULL ELSE {c} END AS {c}" for c, m in R9_BLANK)}) FROM sites)
SELECT place, part, rows, needed, CASE WHEN rows >= needed THEN 'ok' ELSE 'too few rows' END AS status
FROM ({_least_sql([p for p in insights.analysis_parts() + insights.spatial_parts() if "DATA" not in p.columns])})
UNION ALL BY NAME SELECT DISTINCT "MUNICIPIO(S)" AS place, 'time_series' AS part, 1 AS needed,
  'missing column' AS status FROM sites"""))
def _(spark, sf):
    """Which parts of both reports each municipality's sites allow."""
    thinned = sites(spark, sf).withColumns(
        {c: F.when(~((F.col("op_id") % 40 > 10) & (F.col("op_id") % m > 0)), F.col(c)) for c, m in R9_BLANK}
    )
    parts = insights.analysis_parts() + insights.spatial_parts()
    return runner.guard_status(thinned, parts, "MUNICIPIO(S)").withColumnRenamed("MUNICIPIO(S)", "place")


WITHOUT_STATES = ("hotspots", "accessibility", "territory")


@query("r9_spatial_status", sites_sql(f""" SELECT part, rows, needed, CASE WHEN part = 'executive_summary' THEN 'skipped'
  WHEN rows IS NULL THEN 'missing column' WHEN rows >= needed THEN 'ok' ELSE 'too few rows' END AS status
FROM (SELECT part, needed, CASE WHEN part NOT IN {WITHOUT_STATES} THEN (SELECT count(*) FROM sites) END AS rows
  FROM (VALUES {", ".join(f"('{p.name}', {p.least})" for p in insights.spatial_parts())}) AS parts(part, needed))"""))
def _(spark, sf):
    """The spatial report of all sites without their states: the parts that can run do."""
    return insights.spatial_analysis(sites(spark, sf).drop("ESTADO"))["status"].drop("message")


@query("s9_results_export", REGISTRY["a23_region_state_tree"].sql)
def _(spark, sf):
    """All chart bundles written as JSON and the treemap table read back."""
    path = _scratch(spark, "results")
    insights.export_results(insights.chart_bundles(stage(enriched_rows(spark, sf))), path)
    back = spark.read.schema("REGIAO string, ESTADO string, CFEM_TOTAL double, NUM_OPERACOES bigint").json(
        f"{path}/executive/geography"
    )
    return rounded(back, CFEM_TOTAL=2)


# exported table: the query whose SQL states its rows, its key columns (two), total and count
BUNDLED = {
    "executive/geography": ("a23_region_state_tree", "REGIAO", "ESTADO", "CFEM_TOTAL", "NUM_OPERACOES"),
    "executive/substances": ("a22_substance_table", "SUBSTANCIA", None, "CFEM_TOTAL", "NUM_EMPRESAS"),
    "geospatial/regional": ("a24_region_chart", "REGIAO", None, "CFEM_TOTAL", "NUM_SUBSTANCIAS"),
    "advanced/efficiency": ("a25_efficiency_chart", "EMPRESA", None, "CFEM_TOTAL", "NUM_ESTADOS"),
    "advanced/portfolio": ("a26_p18_portfolio", "EMPRESA", "NIVEL_DIVERSIFICACAO", "CFEM_TOTAL", "DIVERSIFICACAO"),
    "advanced/density": ("a28_state_density", "ESTADO", "REGIAO", "CFEM_TOTAL", "NUM_OPERACOES"),
}


@query("s9_export_tables", "\nUNION ALL ".join(
    f"""SELECT '{name}' AS "table", "{a}" AS first_key, {f'"{b}"' if b else "NULL"} AS second_key, "{t}" AS total, CAST("{n}" AS BIGINT) AS n
FROM ({REGISTRY[key].sql})""" for name, (key, a, b, t, n) in BUNDLED.items()
))
def _(spark, sf):
    """All chart bundles exported, verified against the manifest and read back; rows of the tables that SQL states."""
    path = _scratch(spark, "bundles")
    export.export_run(insights.chart_bundles(stage(enriched_rows(spark, sf))), path, csv=[n for n in BUNDLED if "portfolio" not in n])
    back, rows = export.read_export(spark, path), None
    for name, (_key, a, b, t, n) in BUNDLED.items():
        part = back[name].select(
            F.lit(name).alias("table"), F.col(a).alias("first_key"), (F.col(b) if b else F.lit(None).cast("string")).alias("second_key"),
            F.round(t, 2).alias("total"), F.col(n).cast("bigint").alias("n"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("s7_s8_export_rows", sites_sql("".join((
    """ SELECT "table", op_id, TITULAR, CFEM, round(LONGITUDE, 6) AS "LONGITUDE", round(LATITUDE, 6) AS "LATITUDE" FROM sites, (VALUES """,
    ", ".join(f"('{name}')" for name in insights.ROW_LEVEL), """) AS t("table")""",
))))
def _(spark, sf):
    """The spatial report exported, verified against the manifest and read back; rows of its three row-level tables."""
    path = _scratch(spark, "report")
    export.export_run(insights.spatial_report(sites(spark, sf)), path, csv=insights.ROW_LEVEL)
    back, rows = export.read_export(spark, path), None
    for name in insights.ROW_LEVEL:
        part = back[name].select(F.lit(name).alias("table"), "op_id", "TITULAR", "CFEM", "LONGITUDE", "LATITUDE")
        rows = part if rows is None else rows.unionByName(part)
    return rounded(rows, LONGITUDE=6, LATITUDE=6)


@query("r11_chart_bundles")
def _(spark, sf):
    """Every chart table of the four dashboards with its number of rows."""
    counts = None
    for bundle, tables in insights.chart_bundles(stage(enriched_rows(spark, sf))).items():
        for name, table in tables.items():
            part = table.agg(F.count("*").alias("rows")).select(
                F.lit(f"{bundle}.{name}").alias("table"), "rows"
            )
            counts = part if counts is None else counts.unionByName(part)
    return counts
