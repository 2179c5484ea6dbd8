"""Queries: figures, rankings, market, territory, time, tests, chart tables, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from garimpo.operators import (
    charts, clean, kpi, market, quality, rank, stats, territory, timeseries,
)
from garimpo.plans.base import (
    MEAN, OPERATIONS_SQL, TOTAL, enriched_rows, enriched_sql, operations, ops, query, raw_operations,
    raw_sql, rounded,
)
from garimpo.plans.preparation import OUTLIER_SQL, SPREAD_SQL, spread

COMPANY_SQL = f"""{OPERATIONS_SQL},
companies AS (
  SELECT TITULAR AS "EMPRESA", {TOTAL} AS total, count(CFEM) AS n,
         count(DISTINCT PRIMEIRODESUBS) AS subs, count(DISTINCT ESTADO) AS states
  FROM operations GROUP BY 1)"""


def companies_sql(body: str) -> str:
    return f"WITH {COMPANY_SQL}\n{body}"


# --- headline figures ----------------------------------------------------------------------

@query("a1_statistics", ops(f"""SELECT count(*) AS total_registros, count(DISTINCT TITULAR) AS total_empresas,
  count(DISTINCT ESTADO) AS total_estados, count(DISTINCT "MUNICIPIO(S)") AS total_municipios,
  count(DISTINCT PRIMEIRODESUBS) AS total_substancias, round({TOTAL}, 2) AS cfem_total,
  round({MEAN}, 4) AS cfem_medio, round(quantile_cont(CFEM, 0.5), 4) AS cfem_mediano,
  round(stddev_samp(CFEM), 2) AS cfem_std, min(CFEM) AS cfem_min, max(CFEM) AS cfem_max,
  (SELECT round(sum(t * t) / (sum(t) * sum(t)), 9) FROM
     (SELECT {TOTAL} AS t FROM operations GROUP BY TITULAR)) AS hhi_empresas
FROM operations"""))
def _(spark, sf):
    return rounded(
        kpi.statistics(operations(spark, sf)),
        cfem_total=2, cfem_medio=4, cfem_mediano=4, cfem_std=2, hhi_empresas=9,
    )


@query("a2_basic_kpis", ops(f"""SELECT round({TOTAL}, 2) AS total_cfem, count(DISTINCT TITULAR) AS total_empresas,
  count(DISTINCT ESTADO) AS total_estados, count(DISTINCT "MUNICIPIO(S)") AS total_municipios,
  count(DISTINCT PRIMEIRODESUBS) AS total_substancias, round({MEAN}, 4) AS cfem_medio FROM operations"""))
def _(spark, sf):
    return rounded(kpi.basic_kpis(operations(spark, sf)), total_cfem=2, cfem_medio=4)


@query("a2b_kpi_cards", ops(f"""SELECT 'Total CFEM' AS kpi, round({TOTAL}, 2) AS value FROM operations
UNION ALL SELECT 'Empresas', count(DISTINCT TITULAR) FROM operations
UNION ALL SELECT 'Estados', count(DISTINCT ESTADO) FROM operations
UNION ALL SELECT 'Substâncias', count(DISTINCT PRIMEIRODESUBS) FROM operations"""))
def _(spark, sf):
    return rounded(kpi.kpi_cards(operations(spark, sf)), value=2)


@query("a3_selection_cards", ops(f"""SELECT count(*) AS registros, round({TOTAL}, 2) AS cfem_total,
  count(DISTINCT TITULAR) AS empresas, count(DISTINCT ESTADO) AS estados, round({MEAN}, 4) AS cfem_medio,
  max(CFEM) AS cfem_max, min(CFEM) AS cfem_min
FROM operations WHERE ESTADO IN ('MG', 'PA', 'BA', 'GO') AND CFEM BETWEEN 50000 AND 2000000"""))
def _(spark, sf):
    kept = kpi.select_rows(operations(spark, sf), ["MG", "PA", "BA", "GO"], low=50_000, high=2_000_000)
    return rounded(kpi.selection_cards(kept), cfem_total=2, cfem_medio=4)


@query("a4_company_hhi", companies_sql(
    "SELECT round(sum(total * total) / (sum(total) * sum(total)), 9) AS hhi, count(*) AS groups FROM companies"))
def _(spark, sf):
    return rounded(kpi.hhi_of(kpi.totals_by(operations(spark, sf), "TITULAR")), hhi=9)


def _concentration_sql(group: str, eps: str) -> str:
    return ops(f""", t AS (SELECT {group} AS g, {TOTAL} AS total FROM operations GROUP BY 1),
m AS (SELECT sum(total) AS market, count(*) AS n FROM t),
r AS (SELECT total, row_number() OVER (ORDER BY total, g) AS up, row_number() OVER (ORDER BY total DESC, g) AS down FROM t)
SELECT round(sum(total * total) / (max(market) * max(market)), 9) AS hhi,
  round(sum(total) FILTER (WHERE down <= 4) / max(market), 9) AS cr4,
  round(sum(total) FILTER (WHERE down <= 8) / max(market), 9) AS cr8,
  round(-sum(total / market * ln(total / market + {eps})), 7) AS theil_index,
  round(-sum(total / market * ln(total / market + {eps})), 7) AS shannon_entropy,
  round((max(n) + 1 - 2 * (sum(total * (n - up + 1)) / max(market))) / max(n), 7) AS gini_coefficient,
  CASE WHEN sum(total * total) / (max(market) * max(market)) < 0.15 THEN 'Mercado não concentrado'
       WHEN sum(total * total) / (max(market) * max(market)) < 0.25 THEN 'Mercado moderadamente concentrado'
       ELSE 'Mercado altamente concentrado' END AS market_interpretation
FROM r, m""")


CONCENTRATION_DIGITS = {
    "hhi": 9, "cr4": 9, "cr8": 9, "theil_index": 7, "shannon_entropy": 7, "gini_coefficient": 7,
}


@query("a5_market_concentration", _concentration_sql("TITULAR", "1e-10"))
def _(spark, sf):
    return rounded(market.concentration(operations(spark, sf)), **CONCENTRATION_DIGITS)


@query("a5_state_concentration", _concentration_sql("ESTADO", "1e-10"))
def _(spark, sf):
    return rounded(market.concentration(operations(spark, sf), "ESTADO"), **CONCENTRATION_DIGITS)


@query("a5b_concentration_plain_entropy", _concentration_sql("PRIMEIRODESUBS", "0"))
def _(spark, sf):
    return rounded(
        market.concentration(operations(spark, sf), "PRIMEIRODESUBS", eps=0.0), **CONCENTRATION_DIGITS
    )


@query("a6_gini", companies_sql("""SELECT round((max(n) + 1 - 2 * sum(running) / max(market)) / max(n), 7) AS gini_coefficient
FROM (SELECT sum(total) OVER (ORDER BY total, "EMPRESA") AS running, count(*) OVER () AS n, sum(total) OVER () AS market
      FROM companies)"""))
def _(spark, sf):
    totals = kpi.totals_by(operations(spark, sf), "TITULAR").select("TITULAR", "total")
    ranked = rank.global_rank(totals, "total", "TITULAR")
    return rounded(ranked.agg(market.gini_of(ranked)), gini_coefficient=7)


EFFICIENCY_SQL = """SELECT "EMPRESA", round(total, 2) AS "CFEM_TOTAL", n AS "NUM_OPERACOES", round(total / n, 4) AS "CFEM_MEDIO",
  subs AS "NUM_SUBSTANCIAS", states AS "NUM_ESTADOS", round(total / n, 4) AS "EFICIENCIA_OPERACIONAL",
  round(states / n, 8) AS "DIVERSIFICACAO_GEOGRAFICA", round(subs / n, 8) AS "DIVERSIFICACAO_SUBSTANCIAS" FROM companies"""
EFFICIENCY_DIGITS = {
    "CFEM_TOTAL": 2, "CFEM_MEDIO": 4, "EFICIENCIA_OPERACIONAL": 4, "DIVERSIFICACAO_GEOGRAFICA": 8,
    "DIVERSIFICACAO_SUBSTANCIAS": 8,
}


@query("a7_company_efficiency", companies_sql(EFFICIENCY_SQL))
def _(spark, sf):
    return rounded(market.company_efficiency(operations(spark, sf)), **EFFICIENCY_DIGITS)


@query("a8_efficiency_summary", companies_sql("""SELECT round(avg(total / n), 2) AS avg_efficiency,
  round(quantile_cont(total / n, 0.5), 4) AS median_efficiency, round(stddev_samp(total / n), 2) AS efficiency_std FROM companies"""))
def _(spark, sf):
    return rounded(
        market.efficiency_summary(operations(spark, sf)), avg_efficiency=2, median_efficiency=4, efficiency_std=2
    )


for _name, _measure, _expression in (
    ("t6_top_efficiency", "EFICIENCIA_OPERACIONAL", "total / n"),
    ("t6_top_geographic_diversity", "DIVERSIFICACAO_GEOGRAFICA", "states / n"),
    ("t6_top_substance_diversity", "DIVERSIFICACAO_SUBSTANCIAS", "subs / n"),
):
    def _run(spark, sf, measure=_measure):
        return rounded(market.efficiency_top(operations(spark, sf), measure), **EFFICIENCY_DIGITS)

    query(_name, companies_sql(f'{EFFICIENCY_SQL} ORDER BY {_expression} DESC, "EMPRESA" LIMIT 10'))(_run)


SHARE_CLASS_SQL = """CASE WHEN s >= 10 THEN 'Líder' WHEN s >= 5 THEN 'Grande' WHEN s >= 1 THEN 'Média' ELSE 'Pequena' END"""


@query("a9_p17_positioning", companies_sql(f"""SELECT "EMPRESA", round(total, 2) AS "CFEM_TOTAL", n AS "NUM_OPERACOES",
  round(total / n, 4) AS "CFEM_MEDIO", subs AS "NUM_SUBSTANCIAS", sl AS "SUBSTANCIAS", states AS "NUM_ESTADOS", el AS "ESTADOS",
  round(s, 7) AS "MARKET_SHARE", {SHARE_CLASS_SQL} AS "CATEGORIA_PORTE"
FROM (SELECT *, total / (SELECT {TOTAL} FROM operations) * 100 AS s FROM companies)
JOIN (SELECT TITULAR, string_agg(DISTINCT PRIMEIRODESUBS, ',' ORDER BY PRIMEIRODESUBS) AS sl,
             string_agg(DISTINCT ESTADO, ',' ORDER BY ESTADO) AS el FROM operations GROUP BY 1) ON TITULAR = "EMPRESA" """))
def _(spark, sf):
    out = market.positioning(operations(spark, sf))
    out = out.withColumns({c: F.array_join(c, ",") for c in ("SUBSTANCIAS", "ESTADOS")})
    return rounded(out, CFEM_TOTAL=2, CFEM_MEDIO=4, MARKET_SHARE=7)


@query("a10_market_structure", companies_sql(f"""SELECT position, count("EMPRESA") AS companies
FROM (VALUES ('leaders', 'Líder'), ('challengers', 'Grande'), ('followers', 'Média'), ('nichers', 'Pequena')) v(position, label)
LEFT JOIN (SELECT "EMPRESA", {SHARE_CLASS_SQL} AS c FROM
   (SELECT "EMPRESA", total / (SELECT sum(total) FROM companies) * 100 AS s FROM companies)) ON c = label GROUP BY 1"""))
def _(spark, sf):
    return market.market_structure(operations(spark, sf))


@query("a11_sustainability", companies_sql("""SELECT round(avg(states), 8) AS avg_states_per_company,
  count(*) FILTER (WHERE states = 1) AS companies_single_state, count(*) FILTER (WHERE states > 1) AS companies_multi_state,
  round(avg(subs), 8) AS avg_substances_per_company, count(*) FILTER (WHERE subs = 1) AS companies_single_substance,
  count(*) FILTER (WHERE subs > 1) AS companies_multi_substance FROM companies"""))
def _(spark, sf):
    return rounded(
        market.sustainability(operations(spark, sf)), avg_states_per_company=8, avg_substances_per_company=8
    )


@query("a12_regional_risk", enriched_sql(f"""SELECT round(h, 9) AS concentration_index,
  CASE WHEN h > 0.5 THEN 'Alto' WHEN h > 0.25 THEN 'Médio' ELSE 'Baixo' END AS risk_level
FROM (SELECT sum(t * t) / (sum(t) * sum(t)) AS h FROM (SELECT {TOTAL} AS t FROM enriched GROUP BY REGIAO))"""))
def _(spark, sf):
    return rounded(market.regional_risk(enriched_rows(spark, sf)), concentration_index=9)


BENCHMARK_SQL = """SELECT "EMPRESA", round(total, 2) AS "CFEM_TOTAL", n AS "NUM_OPERACOES", round(total / n, 4) AS "CFEM_MEDIO",
  states AS "NUM_ESTADOS", subs AS "NUM_SUBSTANCIAS", round(m.t, 2) AS market_total, round(m.at, 2) AS avg_cfem_per_company,
  round(m.an, 6) AS avg_operations_per_company, round(m.ast, 6) AS avg_states_per_company,
  round(m.asu, 6) AS avg_substances_per_company, round(total / m.at, 8) AS cfem_vs_avg, round(n / m.an, 8) AS operations_vs_avg,
  round((SELECT avg(CASE WHEN o.total < c.total THEN 1.0 ELSE 0.0 END) FROM companies o) * 100, 6) AS cfem_percentile
FROM companies c, (SELECT sum(total) AS t, avg(total) AS at, avg(n) AS an, avg(states) AS ast, avg(subs) AS asu FROM companies) m"""
BENCHMARK_DIGITS = {
    "CFEM_TOTAL": 2, "CFEM_MEDIO": 4, "market_total": 2, "avg_cfem_per_company": 2, "avg_operations_per_company": 6,
    "avg_states_per_company": 6, "avg_substances_per_company": 6, "cfem_vs_avg": 8, "operations_vs_avg": 8,
    "cfem_percentile": 6,
}


@query("a13_benchmark", companies_sql(f"""{BENCHMARK_SQL} WHERE "EMPRESA" = 'Supplier#000000003'"""))
def _(spark, sf):
    return rounded(market.benchmark(operations(spark, sf), "Supplier#000000003"), **BENCHMARK_DIGITS)


@query("a13_benchmark_all", companies_sql(BENCHMARK_SQL))
def _(spark, sf):
    return rounded(market.benchmark_all(operations(spark, sf)), **BENCHMARK_DIGITS)


# --- territory -----------------------------------------------------------------------------

@query("a14_state_table", ops(f"""SELECT ESTADO, count(CFEM) AS "NUM_OPERACOES", round({TOTAL}, 2) AS "CFEM_TOTAL",
  round({MEAN}, 4) AS "CFEM_MEDIO", count(DISTINCT TITULAR) AS "NUM_EMPRESAS",
  count(DISTINCT PRIMEIRODESUBS) AS "NUM_SUBSTANCIAS", count(DISTINCT "MUNICIPIO(S)") AS "NUM_MUNICIPIOS"
FROM operations GROUP BY 1"""))
def _(spark, sf):
    return rounded(territory.state_table(operations(spark, sf)), CFEM_TOTAL=2, CFEM_MEDIO=4)


@query("a15_region_table", enriched_sql(f"""SELECT REGIAO, count(CFEM) AS "NUM_OPERACOES", round({TOTAL}, 2) AS "CFEM_TOTAL",
  round({MEAN}, 4) AS "CFEM_MEDIO", count(DISTINCT TITULAR) AS "NUM_EMPRESAS", count(DISTINCT ESTADO) AS "NUM_ESTADOS"
FROM enriched GROUP BY 1"""))
def _(spark, sf):
    return rounded(territory.region_table(operations(spark, sf)), CFEM_TOTAL=2, CFEM_MEDIO=4)


@query("a16_territorial_hhi", enriched_sql(f"""SELECT level, round(h, 9) AS hhi,
  CASE WHEN h < 0.15 THEN 'Baixa concentração' WHEN h < 0.25 THEN 'Concentração moderada' ELSE 'Alta concentração' END AS interpretation
FROM (SELECT 'state' AS level, sum(t * t) / (sum(t) * sum(t)) AS h FROM (SELECT {TOTAL} AS t FROM enriched GROUP BY ESTADO)
      UNION ALL SELECT 'region', sum(t * t) / (sum(t) * sum(t)) FROM (SELECT {TOTAL} AS t FROM enriched GROUP BY REGIAO))"""))
def _(spark, sf):
    return rounded(territory.territorial_hhi(operations(spark, sf)), hhi=9)


@query("a17_states_per_company", companies_sql('SELECT "EMPRESA" AS "TITULAR", states AS "NUM_ESTADOS_ATUACAO" FROM companies'))
def _(spark, sf):
    return territory.states_per_company(operations(spark, sf))


@query("a17_mean_states", companies_sql("SELECT round(avg(states), 8) AS avg_territorial_diversification FROM companies"))
def _(spark, sf):
    return rounded(
        territory.mean_states_per_company(operations(spark, sf)), avg_territorial_diversification=8
    )


@query("a17_most_diversified", companies_sql("""SELECT "EMPRESA" AS "TITULAR", states AS "NUM_ESTADOS_ATUACAO" FROM companies
ORDER BY states DESC, "EMPRESA" LIMIT 10"""))
def _(spark, sf):
    return territory.most_diversified(operations(spark, sf))


# --- data quality --------------------------------------------------------------------------

@query("a18_completeness", raw_sql("""UNPIVOT (SELECT round(count(r_company) * 100 / count(*), 6) AS "TITULAR",
  round(count(r_place) * 100 / count(*), 6) AS "MUNICIPIO(S)", round(count(r_state) * 100 / count(*), 6) AS "ESTADO",
  round(count(r_substance) * 100 / count(*), 6) AS "PRIMEIRODESUBS", round(count(amount) * 100 / count(*), 6) AS "CFEM",
  round(count(lon) * 100 / count(*), 6) AS "LONGITUDE", round(count(lat) * 100 / count(*), 6) AS "LATITUDE",
  round(count(day) * 100 / count(*), 6) AS "DATA" FROM raw POSITIONAL JOIN
  (SELECT amount, lon, lat, day FROM typed)) ON COLUMNS(*) INTO NAME "column" VALUE pct""").replace(
      "FROM raw POSITIONAL JOIN\n  (SELECT amount, lon, lat, day FROM typed)", "FROM (SELECT r.*, t.* FROM raw r POSITIONAL JOIN typed t)"))
def _(spark, sf):
    out = clean.parse_dates(clean.parse_numbers(clean.normalise_headers(raw_operations(spark, sf))))
    return rounded(quality.completeness(out), pct=6)


@query("a19_duplicates", f"""WITH {SPREAD_SQL} SELECT
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM spread)) AS BIGINT) AS total_duplicatas,
  CAST(count(*) - count(DISTINCT TITULAR) AS BIGINT) AS duplicatas_por_empresa,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT LONGITUDE, LATITUDE FROM spread)) AS BIGINT) AS duplicatas_por_localizacao
FROM spread""")
def _(spark, sf):
    return quality.duplicates(spread(spark, sf))


@query("a20_outlier_share", f"""WITH {OUTLIER_SQL}
SELECT count(*) FILTER (WHERE CFEM_OUTLIER) AS total_outliers,
  round(count(*) FILTER (WHERE CFEM_OUTLIER) * 100 / count(*), 6) AS percentual_outliers FROM flagged""")
def _(spark, sf):
    return rounded(quality.outlier_share(clean.flag_outliers(spread(spark, sf))), percentual_outliers=6)


REGION_BOX_SQL = ", ".join(
    f"('{r}', {b[0]}, {b[1]}, {b[2]}, {b[3]})" for r, b in quality.dims.REGION_BOXES.items()
)


@query("a21_geographic_consistency", enriched_sql(f"""SELECT count(*) FILTER (WHERE bad) AS inconsistencias_geograficas,
  count(*) AS total_com_coordenadas, round(count(*) FILTER (WHERE bad) * 100 / count(*), 6) AS percentual_inconsistencias
FROM (SELECT NOT (LATITUDE BETWEEN lat_min AND lat_max AND LONGITUDE BETWEEN lon_min AND lon_max) AS bad
      FROM enriched LEFT JOIN (VALUES {REGION_BOX_SQL}) b(region, lat_min, lat_max, lon_min, lon_max) ON region = REGIAO
      WHERE LONGITUDE IS NOT NULL AND LATITUDE IS NOT NULL)"""))
def _(spark, sf):
    return rounded(quality.geographic_consistency(operations(spark, sf)), percentual_inconsistencias=6)


def _status_sql(table: str) -> str:
    return f"""SELECT CASE WHEN count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) THEN 'Duplicatas Encontradas'
            ELSE 'Sem Duplicatas' END AS duplicatas,
  CASE WHEN count(*) FILTER (WHERE CFEM_OUTLIER) * 100.0 / count(*) > 5 THEN 'Outliers Detectados' ELSE 'Poucos Outliers' END AS outliers
FROM {table}"""


@query("r13_quality_status", f"""WITH {OUTLIER_SQL},
plain AS (SELECT o.*, CFEM < q1 - 3 * (q3 - q1) OR CFEM > q3 + 3 * (q3 - q1) AS CFEM_OUTLIER FROM operations o,
  (SELECT quantile_cont(CFEM, 0.25) AS q1, quantile_cont(CFEM, 0.75) AS q3 FROM operations))
{_status_sql('flagged')} UNION ALL {_status_sql('plain')}""")
def _(spark, sf):
    """The status of a table with repeated rows and outliers, and of one without."""
    return quality.quality_status(clean.flag_outliers(spread(spark, sf))).unionByName(
        quality.quality_status(clean.flag_outliers(operations(spark, sf)))
    )


# --- rankings and previews -----------------------------------------------------------------

for _name, _key, _k in (
    ("t1_top_companies", "TITULAR", 10), ("t1_top_states", "ESTADO", 10), ("t1_top_substances", "PRIMEIRODESUBS", 10),
    ("t2_top15_companies", "TITULAR", 15),
):
    def _run(spark, sf, key=_key, k=_k):
        return rounded(kpi.top_groups(operations(spark, sf), key, k), total=2)

    query(_name, ops(f"""SELECT {_key}, round({TOTAL}, 2) AS total FROM operations GROUP BY 1
ORDER BY {TOTAL} DESC, 1 LIMIT {_k}"""))(_run)

for _k in (10, 5):
    def _run(spark, sf, k=_k):
        return kpi.top_rows(operations(spark, sf), k).select("op_id", "TITULAR", "CFEM")

    query(f"t3_top{_k}_rows", ops(f"SELECT op_id, TITULAR, CFEM FROM operations ORDER BY CFEM DESC, op_id LIMIT {_k}"))(_run)


@query("t7_top_companies_in_leading_substance", ops(f"""SELECT TITULAR, round({TOTAL}, 2) AS total FROM operations
WHERE PRIMEIRODESUBS = (SELECT PRIMEIRODESUBS FROM operations GROUP BY 1 ORDER BY {TOTAL} DESC, 1 LIMIT 1)
GROUP BY 1 ORDER BY {TOTAL} DESC, 1 LIMIT 10"""))
def _(spark, sf):
    return rounded(market.top_companies_in_leading_substance(operations(spark, sf)), total=2)


@query("t7_top_companies_per_substance", ops(f"""SELECT PRIMEIRODESUBS, TITULAR, round(total, 2) AS total, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY PRIMEIRODESUBS ORDER BY total DESC, TITULAR) AS r
  FROM (SELECT PRIMEIRODESUBS, TITULAR, {TOTAL} AS total FROM operations GROUP BY 1, 2)) WHERE r <= 10"""))
def _(spark, sf):
    return rounded(market.top_companies_per_substance(operations(spark, sf)), total=2)


@query("t8_sorted_table", ops("SELECT op_id, TITULAR, ESTADO, CFEM FROM operations ORDER BY CFEM DESC, op_id"))
def _(spark, sf):
    return kpi.sorted_table(operations(spark, sf).select("op_id", "TITULAR", "ESTADO", "CFEM"), "CFEM")


@query("t9_preview", ops("SELECT op_id, TITULAR, CFEM FROM operations ORDER BY op_id LIMIT 25"))
def _(spark, sf):
    return kpi.preview(operations(spark, sf).select("op_id", "TITULAR", "CFEM"), 25)


@query("t11_sample")
def _(spark, sf):
    return kpi.sample_rows(operations(spark, sf).select("op_id", "CFEM"), 5000)


# --- ordered tables ------------------------------------------------------------------------

@query("w3_lorenz", companies_sql("""SELECT "EMPRESA" AS "TITULAR", round(total / m * 100, 7) AS share_pct,
  round(sum(CAST(total AS DECIMAL(24,6))) OVER (ORDER BY total DESC, "EMPRESA" ROWS UNBOUNDED PRECEDING) / m * 100, 7) AS cumulative_pct,
  row_number() OVER (ORDER BY total DESC, "EMPRESA") AS rank FROM companies, (SELECT sum(total) AS m FROM companies)"""))
def _(spark, sf):
    return rounded(market.lorenz(operations(spark, sf)), share_pct=7, cumulative_pct=7)


@query("w3_lorenz_top20", companies_sql("""SELECT "EMPRESA" AS "TITULAR", round(total / m * 100, 7) AS share_pct
FROM companies, (SELECT sum(total) AS m FROM companies) ORDER BY total DESC, 1 LIMIT 20"""))
def _(spark, sf):
    return rounded(market.lorenz_top(operations(spark, sf)), share_pct=7)


@query("w4_equality_line", companies_sql("""SELECT CAST(1 AS BIGINT) AS rank, CAST(0 AS DOUBLE) AS cumulative_pct
UNION ALL SELECT count(*), 100 FROM companies"""))
def _(spark, sf):
    return market.equality_line(operations(spark, sf))


@query("w7_quantile_plot", ops("""SELECT p / CAST(100 AS DOUBLE) AS prob, round(q[CAST(p AS INTEGER) + 1], 4) AS quantile
FROM (SELECT quantile_cont(CFEM, [i / CAST(100 AS DOUBLE) FOR i IN range(0, 101)]) AS q FROM operations), range(0, 101) t(p)""".replace(
    "[i / CAST(100 AS DOUBLE) FOR i IN range(0, 101)]", "[" + ", ".join(str(i / 100) for i in range(101)) + "]")))
def _(spark, sf):
    return rounded(charts.quantile_plot(operations(spark, sf)).select("prob", "quantile"), quantile=4)


@query("w8_average_ranks", ops("""SELECT PRIMEIRODESUBS, count(*) AS n, sum(r) AS rank_sum FROM (
  SELECT PRIMEIRODESUBS, rank() OVER (ORDER BY CFEM) + (count(*) OVER (PARTITION BY CFEM) - 1) / 2 AS r FROM operations)
GROUP BY 1"""))
def _(spark, sf):
    return rank.average_ranks(operations(spark, sf), "CFEM", "PRIMEIRODESUBS").select(
        "PRIMEIRODESUBS", "n", "rank_sum"
    )


# --- time ----------------------------------------------------------------------------------

MONTHLY_SQL = f"""{OPERATIONS_SQL},
monthly AS (SELECT CAST(date_trunc('month', DATA) AS DATE) AS month, {TOTAL} AS total, count(*) AS operations, {MEAN} AS mean
            FROM operations GROUP BY 1)"""


@query("d1_t10_monthly", f"""WITH {MONTHLY_SQL} SELECT month, round(total, 2) AS total, operations, round(mean, 4) AS mean,
  strftime(month, '%Y-%m') AS period FROM monthly ORDER BY month""")
def _(spark, sf):
    return rounded(timeseries.monthly(operations(spark, sf)), total=2, mean=4).orderBy("month")


@query("d2_d4_d5_trend", f"""WITH {MONTHLY_SQL} SELECT round(regr_slope(total, i), 2) AS trend_slope,
  round(avg(g), 6) AS average_growth_rate, round(stddev_samp(total) / avg(total), 8) AS volatility, 'ok' AS status
FROM (SELECT total, row_number() OVER (ORDER BY month) - 1 AS i,
             (total - lag(total) OVER (ORDER BY month)) / lag(total) OVER (ORDER BY month) * 100 AS g FROM monthly)""")
def _(spark, sf):
    return rounded(
        timeseries.trend(operations(spark, sf)), trend_slope=2, average_growth_rate=6, volatility=8
    )


@query("d3_seasonal", ops(f"SELECT CAST(month(DATA) AS INTEGER) AS month_of_year, round({MEAN}, 4) AS mean FROM operations GROUP BY 1"))
def _(spark, sf):
    return rounded(timeseries.seasonal(operations(spark, sf)), mean=4)


@query("w5_w6_growth", f"""WITH {MONTHLY_SQL} SELECT month, row_number() OVER (ORDER BY month) - 1 AS month_index,
  round((total - lag(total) OVER (ORDER BY month)) / lag(total) OVER (ORDER BY month) * 100, 6) AS growth_rate FROM monthly""")
def _(spark, sf):
    return rounded(
        timeseries.monthly_growth(operations(spark, sf)).select("month", "month_index", "growth_rate"), growth_rate=6
    )


@query("d6_timeline", f"""WITH {MONTHLY_SQL} SELECT strftime(month, '%Y-%m') AS "PERIODO", round(total, 2) AS "CFEM_TOTAL",
  operations AS "NUM_OPERACOES", round(mean, 4) AS "CFEM_MEDIO" FROM monthly""")
def _(spark, sf):
    return rounded(timeseries.timeline(operations(spark, sf)), CFEM_TOTAL=2, CFEM_MEDIO=4)


# --- statistical tests ---------------------------------------------------------------------

@query("st2_dagostino", ops("""SELECT round(zs * zs + zk * zk, 3) AS statistic FROM (
 SELECT d * ln(y / al + sqrt((y / al) * (y / al) + 1)) AS zs,
        (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * pow((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk
 FROM (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS d, sqrt(2 / (w2 - 1)) AS al,
        6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a
 FROM (SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2 FROM (SELECT
   s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
   3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
   (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
   6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb
 FROM (SELECT max(n) AS n, avg(pow(CFEM - m, 3)) / pow(avg(pow(CFEM - m, 2)), 1.5) AS s,
              avg(pow(CFEM - m, 4)) / pow(avg(pow(CFEM - m, 2)), 2) AS k
       FROM operations, (SELECT avg(CFEM) AS m, CAST(count(*) AS DOUBLE) AS n FROM operations))))))"""))
def _(spark, sf):
    return rounded(stats.dagostino(operations(spark, sf)).select("statistic"), statistic=3)


@query("st1_normality")
def _(spark, sf):
    return stats.normality(operations(spark, sf))


@query("st1_shapiro_customers")
def _(spark, sf):
    from garimpo.plans.base import sites

    return stats.normality(sites(spark, sf))


@query("st3_st7_anova", ops("""SELECT round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f_statistic
FROM (SELECT ESTADO, count(*) AS n, avg(CFEM) AS m, var_pop(CFEM) AS v FROM operations GROUP BY 1 HAVING count(*) > 1),
     (SELECT avg(CFEM) AS g FROM operations)"""))
def _(spark, sf):
    return rounded(stats.anova(operations(spark, sf)).select("f_statistic"), f_statistic=6)


@query("st4_kruskal_wallis", ops("""SELECT round((12 / (n * (n + 1)) * r - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 5) AS h_statistic
FROM (SELECT sum(s * s / k) AS r, CAST(sum(k) AS DOUBLE) AS n FROM (
   SELECT PRIMEIRODESUBS, sum(rk) AS s, count(*) AS k FROM (
     SELECT PRIMEIRODESUBS, rank() OVER (ORDER BY CFEM) + (count(*) OVER (PARTITION BY CFEM) - 1) / 2 AS rk FROM operations)
   GROUP BY 1)), (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS t FROM (SELECT count(*) AS c FROM operations GROUP BY CFEM))"""))
def _(spark, sf):
    return rounded(stats.kruskal_wallis(operations(spark, sf)).select("h_statistic"), h_statistic=5)


@query("st5_correlation_matrix", ops("""SELECT x, y, round(r, 8) AS r FROM (
  SELECT corr(CFEM, LONGITUDE) AS cl, corr(CFEM, LATITUDE) AS ca, corr(LONGITUDE, LATITUDE) AS la,
    corr(CFEM, CFEM) AS cc, corr(LONGITUDE, LONGITUDE) AS ll, corr(LATITUDE, LATITUDE) AS aa FROM operations),
LATERAL (VALUES ('CFEM', 'LONGITUDE', cl), ('LONGITUDE', 'CFEM', cl), ('CFEM', 'LATITUDE', ca), ('LATITUDE', 'CFEM', ca),
  ('LONGITUDE', 'LATITUDE', la), ('LATITUDE', 'LONGITUDE', la), ('CFEM', 'CFEM', cc), ('LONGITUDE', 'LONGITUDE', ll),
  ('LATITUDE', 'LATITUDE', aa)) v(x, y, r)"""))
def _(spark, sf):
    return rounded(stats.correlation_matrix(operations(spark, sf)), r=8)


@query("statistical_tests")
def _(spark, sf):
    df = operations(spark, sf)
    anova = stats.anova(df).select(F.lit("anova_estados").alias("test"), F.col("f_statistic").alias("statistic"), "p_value")
    kruskal = stats.kruskal_wallis(df).select(
        F.lit("kruskal_substancias").alias("test"), F.col("h_statistic").alias("statistic"), "p_value"
    )
    return stats.normality(df).select("test", "statistic", "p_value").unionByName(anova).unionByName(kruskal)


# --- chart tables --------------------------------------------------------------------------

@query("a22_substance_table", ops(f"""SELECT PRIMEIRODESUBS AS "SUBSTANCIA", count(CFEM) AS "NUM_OPERACOES", round({TOTAL}, 2) AS "CFEM_TOTAL",
  round({MEAN}, 4) AS "CFEM_MEDIO", count(DISTINCT TITULAR) AS "NUM_EMPRESAS" FROM operations GROUP BY 1"""))
def _(spark, sf):
    return rounded(charts.substance_table(operations(spark, sf)), CFEM_TOTAL=2, CFEM_MEDIO=4)


@query("a23_region_state_tree", enriched_sql(f"""SELECT REGIAO, ESTADO, round({TOTAL}, 2) AS "CFEM_TOTAL", count(CFEM) AS "NUM_OPERACOES"
FROM enriched WHERE REGIAO IS NOT NULL GROUP BY ROLLUP (REGIAO, ESTADO)"""))
def _(spark, sf):
    return rounded(charts.region_state_tree(enriched_rows(spark, sf)), CFEM_TOTAL=2)


@query("a24_region_chart", enriched_sql(f"""SELECT REGIAO, round({TOTAL}, 2) AS "CFEM_TOTAL", round({MEAN}, 4) AS "CFEM_MEDIO",
  count(CFEM) AS "NUM_OPERACOES", count(DISTINCT TITULAR) AS "NUM_EMPRESAS", count(DISTINCT PRIMEIRODESUBS) AS "NUM_SUBSTANCIAS"
FROM enriched GROUP BY 1"""))
def _(spark, sf):
    return rounded(charts.region_chart(enriched_rows(spark, sf)), CFEM_TOTAL=2, CFEM_MEDIO=4)


@query("a25_efficiency_chart", companies_sql("""SELECT "EMPRESA", round(total, 2) AS "CFEM_TOTAL", round(total / n, 4) AS "CFEM_MEDIO",
  n AS "NUM_OPERACOES", subs AS "NUM_SUBSTANCIAS", states AS "NUM_ESTADOS", round(total / n, 4) AS "EFICIENCIA" FROM companies"""))
def _(spark, sf):
    return rounded(charts.efficiency_chart(operations(spark, sf)), CFEM_TOTAL=2, CFEM_MEDIO=4, EFICIENCIA=4)


LEVEL_SQL = """CASE WHEN subs <= 1 THEN 'Especializada' WHEN subs <= 3 THEN 'Pouco Diversificada'
  WHEN subs <= 5 THEN 'Diversificada' ELSE 'Muito Diversificada' END"""


@query("a26_p18_portfolio", companies_sql(f"""SELECT "EMPRESA", round(total, 2) AS "CFEM_TOTAL", states AS "NUM_ESTADOS", sl AS "SUBSTANCIAS",
  subs AS "DIVERSIFICACAO", {LEVEL_SQL} AS "NIVEL_DIVERSIFICACAO" FROM companies
JOIN (SELECT TITULAR, string_agg(DISTINCT PRIMEIRODESUBS, ',' ORDER BY PRIMEIRODESUBS) AS sl FROM operations GROUP BY 1) ON TITULAR = "EMPRESA" """))
def _(spark, sf):
    out = charts.portfolio(operations(spark, sf)).withColumn("SUBSTANCIAS", F.array_join("SUBSTANCIAS", ","))
    return rounded(out, CFEM_TOTAL=2)


@query("a26_portfolio_tree", companies_sql(f"""SELECT l AS "NIVEL_DIVERSIFICACAO", "EMPRESA",
  round(CAST(sum(CAST(total AS DECIMAL(24,6))) AS DOUBLE), 2) AS "CFEM_TOTAL", count(*) AS "NUM_EMPRESAS"
FROM (SELECT *, {LEVEL_SQL} AS l FROM companies) GROUP BY ROLLUP (l, "EMPRESA")"""))
def _(spark, sf):
    return rounded(charts.portfolio_tree(operations(spark, sf)), CFEM_TOTAL=2)


@query("a27_hhi_by_substance", ops(f"""SELECT PRIMEIRODESUBS, round(sum(t * t) / (sum(t) * sum(t)), 9) AS "HHI"
FROM (SELECT PRIMEIRODESUBS, TITULAR, {TOTAL} AS t FROM operations GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, sf):
    return rounded(market.hhi_by_substance(operations(spark, sf)), HHI=9)


@query("a28_state_density", enriched_sql(f"""SELECT ESTADO, REGIAO, round({TOTAL}, 2) AS "CFEM_TOTAL",
  count(DISTINCT TITULAR) AS "NUM_EMPRESAS", count(LONGITUDE) AS "NUM_OPERACOES" FROM enriched GROUP BY 1, 2"""))
def _(spark, sf):
    return rounded(charts.state_density(enriched_rows(spark, sf)), CFEM_TOTAL=2)


for _name, _key in (("a29_state_bars", "ESTADO"), ("a29_substance_pie", "PRIMEIRODESUBS")):
    def _run(spark, sf, key=_key):
        return rounded(charts.group_totals(operations(spark, sf), key), CFEM_TOTAL=2)

    query(_name, ops(f"""SELECT {_key}, round({TOTAL}, 2) AS "CFEM_TOTAL", count(CFEM) AS "NUM_OPERACOES" FROM operations GROUP BY 1"""))(_run)

POINTS_SQL = ", ".join(f"('{s}', {p[0]}, {p[1]})" for s, p in quality.dims.STATE_POINTS.items())


@query("a33_p22_state_bubbles", ops(f"""SELECT ESTADO, round(t, 2) AS "CFEM_TOTAL", c AS "NUM_EMPRESAS", CAST(lat AS DOUBLE) AS point_lat,
  CAST(lon AS DOUBLE) AS point_lon, round(10 + t / (max(t) OVER ()) * 40, 7) AS radius
FROM (SELECT ESTADO, {TOTAL} AS t, count(DISTINCT TITULAR) AS c FROM operations GROUP BY 1)
JOIN (VALUES {POINTS_SQL}) v(code, lat, lon) ON code = ESTADO"""))
def _(spark, sf):
    return rounded(territory.state_bubbles(operations(spark, sf)), CFEM_TOTAL=2, radius=7)


def _histogram_sql(x: str) -> str:
    return ops(f"""SELECT bin, count(*) AS count, round(min(lo) + bin * min(w), 5) AS "left", round(min(lo) + (bin + 1) * min(w), 5) AS "right"
FROM (SELECT lo, (hi - lo) / 30 AS w, CAST(least(floor(({x} - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin
      FROM operations, (SELECT min({x}) AS lo, max({x}) AS hi FROM operations)) GROUP BY bin""")


@query("a34_histogram", _histogram_sql("CFEM"))
def _(spark, sf):
    return rounded(charts.histogram(operations(spark, sf)), left=5, right=5)


@query("a34_log_histogram", _histogram_sql("log10(CFEM + 1)"))
def _(spark, sf):
    return rounded(charts.histogram(operations(spark, sf), log=True), left=5, right=5)


def _box_sql(dimension: str, category: str, source: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, CAST({category} AS VARCHAR) AS category, count(*) AS n, min(CFEM) AS min,
  round(quantile_cont(CFEM, 0.25), 4) AS q1, round(quantile_cont(CFEM, 0.5), 4) AS median, round(quantile_cont(CFEM, 0.75), 4) AS q3, max(CFEM) AS max,
  round(quantile_cont(CFEM, 0.25) - 1.5 * (quantile_cont(CFEM, 0.75) - quantile_cont(CFEM, 0.25)), 6) AS lower_fence,
  round(quantile_cont(CFEM, 0.75) + 1.5 * (quantile_cont(CFEM, 0.75) - quantile_cont(CFEM, 0.25)), 6) AS upper_fence
FROM {source} GROUP BY 2"""


BOX_DIGITS = {"q1": 4, "median": 4, "q3": 4, "lower_fence": 6, "upper_fence": 6}


@query("a35_box_overall", ops(_box_sql("all", "'all'", "operations")))
def _(spark, sf):
    return rounded(charts.box_summary(operations(spark, sf)), **BOX_DIGITS)


@query("a35_j3_category_boxes", enriched_sql(" UNION ALL ".join([
    _box_sql("ESTADO", "ESTADO", "(SELECT * FROM enriched WHERE ESTADO IN (SELECT ESTADO FROM enriched GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10))"),
    _box_sql("PRIMEIRODESUBS", "PRIMEIRODESUBS", "(SELECT * FROM enriched WHERE PRIMEIRODESUBS IN (SELECT DISTINCT PRIMEIRODESUBS FROM enriched ORDER BY 1 LIMIT 8))"),
    _box_sql("REGIAO", "REGIAO", "enriched"), _box_sql("PORTE_EMPRESA", "PORTE_EMPRESA", "enriched"),
])))
def _(spark, sf):
    return rounded(charts.category_boxes(enriched_rows(spark, sf)), **BOX_DIGITS)


@query("a36_heat_cells", ops(f"""SELECT CAST(floor(LATITUDE / 0.5) AS BIGINT) AS cell_y, CAST(floor(LONGITUDE / 0.5) AS BIGINT) AS cell_x,
  round({TOTAL}, 2) AS weight, count(*) AS points FROM operations GROUP BY 1, 2"""))
def _(spark, sf):
    return rounded(charts.heat_cells(operations(spark, sf)), weight=2)


@query("a37_marker_tiles", ops(" UNION ALL ".join(f"""SELECT {z} AS zoom, CAST(floor((LATITUDE + 90) / (360.0 / {2 ** z})) AS BIGINT) AS tile_y,
  CAST(floor((LONGITUDE + 180) / (360.0 / {2 ** z})) AS BIGINT) AS tile_x, count(*) AS markers, round({TOTAL}, 2) AS total
FROM operations GROUP BY 2, 3""" for z in (4, 6, 8))))
def _(spark, sf):
    return rounded(charts.marker_tiles(operations(spark, sf)), total=2)


@query("r12_scatter", ops('SELECT LONGITUDE, LATITUDE, PRIMEIRODESUBS, CFEM, TITULAR, "MUNICIPIO(S)", ESTADO FROM operations'))
def _(spark, sf):
    return charts.scatter(operations(spark, sf), "LONGITUDE", "LATITUDE", "PRIMEIRODESUBS", "CFEM")


# --- insights ------------------------------------------------------------------------------

@query("r5_geographic_insights", ops(f"""SELECT
  (SELECT ESTADO FROM operations GROUP BY 1 ORDER BY {TOTAL} DESC, 1 LIMIT 1) AS leading_state,
  (SELECT ESTADO FROM operations GROUP BY 1 ORDER BY count(DISTINCT PRIMEIRODESUBS) DESC, 1 LIMIT 1) AS most_diverse_state,
  count(*) AS geographic_concentration, round(max(t) / sum(t), 8) AS regional_dominance
FROM (SELECT {TOTAL} AS t FROM operations GROUP BY ESTADO)"""))
def _(spark, sf):
    return rounded(territory.geographic_insights(operations(spark, sf)), regional_dominance=8)


@query("r6_substance_insights", ops(f"""SELECT
  (SELECT PRIMEIRODESUBS FROM operations GROUP BY 1 ORDER BY {TOTAL} DESC, 1 LIMIT 1) AS most_valuable_substance,
  (SELECT PRIMEIRODESUBS FROM operations GROUP BY 1 ORDER BY {MEAN} DESC, 1 LIMIT 1) AS highest_average_value,
  count(*) AS substance_diversity, round(max(t) / sum(t), 8) AS concentration_by_substance
FROM (SELECT {TOTAL} AS t FROM operations GROUP BY PRIMEIRODESUBS)"""))
def _(spark, sf):
    return rounded(territory.substance_insights(operations(spark, sf)), concentration_by_substance=8)


@query("r1_r2_competition", ops(f""", t AS (SELECT ESTADO, {TOTAL} AS total FROM operations GROUP BY 1),
h AS (SELECT sum(total * total) / (sum(total) * sum(total)) AS hhi,
  (SELECT sum(total) FROM (SELECT total FROM t ORDER BY total DESC LIMIT 4)) / sum(total) AS cr4 FROM t)
SELECT round(hhi, 9) AS hhi, round(cr4, 9) AS cr4,
 CASE WHEN hhi > 0.25 AND cr4 > 0.6 THEN 'Mercado oligopolizado - poucas empresas dominam'
      WHEN hhi > 0.15 OR cr4 > 0.4 THEN 'Mercado moderadamente concentrado'
      ELSE 'Mercado competitivo com boa distribuição' END AS competitive_assessment FROM h"""))
def _(spark, sf):
    row = market.concentration(operations(spark, sf), "ESTADO")
    return rounded(market.competition_level(row), hhi=9, cr4=9)


@query("r10_report_facts", ops(f"""SELECT
  (SELECT TITULAR FROM operations GROUP BY 1 ORDER BY {TOTAL} DESC, 1 LIMIT 1) AS maior_empresa,
  (SELECT ESTADO FROM operations GROUP BY 1 ORDER BY {TOTAL} DESC, 1 LIMIT 1) AS maior_estado,
  (SELECT PRIMEIRODESUBS FROM operations GROUP BY 1 ORDER BY {TOTAL} DESC, 1 LIMIT 1) AS principal_substancia,
  round(sum(t * t) / (sum(t) * sum(t)), 9) AS hhi_empresas
FROM (SELECT {TOTAL} AS t FROM operations GROUP BY TITULAR)"""))
def _(spark, sf):
    return rounded(kpi.report_facts(operations(spark, sf)), hhi_empresas=9)
