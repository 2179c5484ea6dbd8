"""Queries: geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from garimpo.functions.geo import haversine_km
from garimpo.operators import geo
from garimpo.plans.base import TOTAL, MEAN, operations, ops, query, rounded, sites, sites_sql
from garimpo.plans.reporting import POINTS_SQL


def distance_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"""(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2)
  + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"""


CENTRE_SQL = "(SELECT avg(LATITUDE) AS cy, avg(LONGITUDE) AS cx FROM operations)"
TO_CENTRE = distance_sql("LATITUDE", "LONGITUDE", "cy", "cx")


@query("p13_haversine", ops(f"""SELECT op_id, round({distance_sql('LATITUDE', 'LONGITUDE', '-15.0', '-50.0')}, 5) AS km FROM operations"""))
def _(spark, sf):
    km = haversine_km(F.col("LATITUDE"), F.col("LONGITUDE"), F.lit(-15.0), F.lit(-50.0))
    return operations(spark, sf).select("op_id", F.round(km, 5).alias("km"))


@query("p14_g4_quadrants", ops(f"""SELECT q AS quadrant, count(o.LATITUDE) AS operations FROM (VALUES ('NE'), ('NW'), ('SE'), ('SW')) v(q)
LEFT JOIN (SELECT *, CASE WHEN LATITUDE >= cy AND LONGITUDE >= cx THEN 'NE' WHEN LATITUDE >= cy THEN 'NW'
  WHEN LONGITUDE >= cx THEN 'SE' ELSE 'SW' END AS quad FROM operations, {CENTRE_SQL}) o ON quad = q GROUP BY 1"""))
def _(spark, sf):
    return geo.quadrants(operations(spark, sf))


@query("g2_dispersion", ops(f"""SELECT round(min(cy), 6) AS latitude, round(min(cx), 6) AS longitude,
  round(avg({TO_CENTRE}), 5) AS mean_distance_to_center, round(stddev_pop({TO_CENTRE}), 5) AS std_distance_to_center,
  round(max({TO_CENTRE}), 5) AS max_distance_to_center, round(stddev_pop({TO_CENTRE}) / avg({TO_CENTRE}), 7) AS dispersion_index
FROM operations, {CENTRE_SQL}"""))
def _(spark, sf):
    return rounded(
        geo.dispersion(operations(spark, sf)), latitude=6, longitude=6, mean_distance_to_center=5,
        std_distance_to_center=5, max_distance_to_center=5, dispersion_index=7,
    )


@query("g3_hull_density")
def _(spark, sf):
    return geo.density(operations(spark, sf))


# --- neighbours and hotspots ---------------------------------------------------------------

PAIR_KM = distance_sql("a.LATITUDE", "a.LONGITUDE", "b.LATITUDE", "b.LONGITUDE")


@query("j4_neighbour_totals", sites_sql(f"""
SELECT a.op_id, count(*) AS neighbours, round(CAST(sum(CAST(b.CFEM AS DECIMAL(24,6))) AS DOUBLE), 2) AS local_sum
FROM sites a JOIN sites b ON {PAIR_KM} <= 300 GROUP BY 1"""))
def _(spark, sf):
    df = sites(spark, sf)
    near = geo.neighbour_totals(df, radius_km=300.0)
    return rounded(
        df.join(near, (F.col("LATITUDE") == F.col("lat")) & (F.col("LONGITUDE") == F.col("lon"))).select(
            "op_id", "neighbours", "local_sum"
        ),
        local_sum=2,
    )


HOTSPOT_SQL = sites_sql(f""",
near AS (SELECT a.op_id, count(*) AS n, CAST(sum(CAST(b.CFEM AS DECIMAL(24,6))) AS DOUBLE) AS s
         FROM sites a JOIN sites b ON {PAIR_KM} <= 100 GROUP BY 1),
scored AS (SELECT sites.*, n, CASE WHEN n > 1 THEN s * ln(n + 1) ELSE 0 END AS score FROM sites JOIN near USING (op_id)),
p AS (SELECT quantile_cont(score, 0.7) AS p70, quantile_cont(score, 0.85) AS p85, quantile_cont(score, 0.95) AS p95 FROM scored),
hot AS (SELECT scored.*, CASE WHEN score >= p95 THEN 'Very Hot' WHEN score >= p85 THEN 'Hot' WHEN score >= p70 THEN 'Warm' ELSE 'Cold' END AS c
        FROM scored, p)
""")


@query("g8_p15_hotspot_scores", HOTSPOT_SQL + """SELECT op_id, n AS neighbours, round(score, 4) AS "Hotspot_Score", c AS "Hotspot_Category" FROM hot""")
def _(spark, sf):
    out = geo.hotspot_scores(sites(spark, sf))
    return rounded(out.select("op_id", "neighbours", "Hotspot_Score", "Hotspot_Category"), Hotspot_Score=4)


@query("g8_a30_hotspot_table", HOTSPOT_SQL + f"""SELECT c AS "Hotspot_Category", count(CFEM) AS count, round({TOTAL}, 2) AS sum, round({MEAN}, 4) AS mean,
  count(DISTINCT TITULAR) AS companies, count(DISTINCT PRIMEIRODESUBS) AS substances FROM hot GROUP BY 1""")
def _(spark, sf):
    return rounded(geo.hotspot_table(geo.hotspot_scores(sites(spark, sf))), sum=2, mean=4)


@query("t4_top_hotspots", HOTSPOT_SQL + """SELECT TITULAR, "MUNICIPIO(S)", ESTADO, round(score, 4) AS "Hotspot_Score", CFEM FROM hot
ORDER BY score DESC, op_id LIMIT 10""")
def _(spark, sf):
    return rounded(geo.top_hotspots(geo.hotspot_scores(sites(spark, sf))), Hotspot_Score=4)


@query("g8_hotspots_of_operations")
def _(spark, sf):
    """Hotspots over the whole fact table, not only over sites."""
    return geo.hotspot_table(geo.hotspot_scores(operations(spark, sf)))


# --- accessibility -------------------------------------------------------------------------

ACCESS_SQL = f""", near AS (SELECT o.*, {distance_sql('LATITUDE', 'LONGITUDE', 'CAST(lat AS DOUBLE)', 'CAST(lon AS DOUBLE)')} AS km
  FROM operations o LEFT JOIN (VALUES {POINTS_SQL}) v(code, lat, lon) ON code = ESTADO),
access AS (SELECT *, CASE WHEN km < 100 THEN 'Muito Acessível' WHEN km < 300 THEN 'Acessível' WHEN km < 600 THEN 'Moderadamente Acessível'
  ELSE 'Remoto' END AS c FROM near)
"""


@query("p27_p16_accessibility", ops(ACCESS_SQL + """SELECT op_id, round(km, 5) AS "Distance_to_Capital", c AS "Accessibility_Category" FROM access"""))
def _(spark, sf):
    out = geo.with_accessibility(operations(spark, sf))
    return rounded(out.select("op_id", "Distance_to_Capital", "Accessibility_Category"), Distance_to_Capital=5)


@query("g9_a30_accessibility_table", ops(ACCESS_SQL + f"""SELECT c AS "Accessibility_Category", count(CFEM) AS count, round({TOTAL}, 2) AS sum,
  round({MEAN}, 4) AS mean, count(DISTINCT TITULAR) AS companies FROM access GROUP BY 1"""))
def _(spark, sf):
    return rounded(geo.accessibility_table(operations(spark, sf)), sum=2, mean=4)


@query("st6_st8_accessibility_correlation", ops(ACCESS_SQL + """SELECT round(r, 8) AS pearson_r, concat('Correlação ', CASE WHEN r > 0 THEN 'positiva' ELSE 'negativa' END, ' ',
  CASE WHEN abs(r) < 0.1 THEN 'muito fraca' WHEN abs(r) < 0.3 THEN 'fraca' WHEN abs(r) < 0.5 THEN 'moderada' WHEN abs(r) < 0.7 THEN 'forte'
  ELSE 'muito forte' END) AS interpretation FROM (SELECT corr(km, CFEM) AS r FROM access)"""))
def _(spark, sf):
    return rounded(
        geo.accessibility_correlation(operations(spark, sf)).select("pearson_r", "interpretation"), pearson_r=8
    )


@query("g9_mean_distance", ops(ACCESS_SQL + "SELECT round(avg(km), 6) AS average_distance_to_capital FROM access"))
def _(spark, sf):
    return rounded(geo.mean_accessibility(operations(spark, sf)), average_distance_to_capital=6)


# --- autocorrelation -----------------------------------------------------------------------

WEIGHTS_SQL = sites_sql(""",
z AS (SELECT op_id AS id, LATITUDE AS y, LONGITUDE AS x, CFEM - m AS z FROM sites, (SELECT avg(CFEM) AS m FROM sites)),
d AS (SELECT a.id AS i, b.id AS j, a.z AS zi, b.z AS zj, 1 / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS v
      FROM z a JOIN z b ON a.x <> b.x OR a.y <> b.y),
r AS (SELECT i, sum(v) AS r FROM d GROUP BY 1),
w AS (SELECT d.i, d.j, zi, zj, v / a.r AS w, v / b.r AS back FROM d JOIN r a ON a.i = d.i JOIN r b ON b.i = d.j),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(z * z) AS m2, sum(z * z * z * z) AS m4 FROM z)
""")


@query("g5_j5_simple_moran", WEIGHTS_SQL + """SELECT round(i, 7) AS morans_i, CASE WHEN i > 0.1 THEN 'Autocorrelação espacial positiva (clustering)'
  WHEN i < -0.1 THEN 'Autocorrelação espacial negativa (dispersão)' ELSE 'Distribuição espacial aleatória' END AS interpretation
FROM (SELECT max(n) / sum(w) * sum(w * zi * zj) / max(m2) AS i FROM w, n)""")
def _(spark, sf):
    return rounded(geo.simple_moran(sites(spark, sf)), morans_i=7)


def _moran_sql(s2: str) -> str:
    return WEIGHTS_SQL + f""", s AS (SELECT max(n) AS n, max(m2) AS m2, max(m4) AS m4, sum(w) AS s0, sum(w * zi * zj) AS top,
  sum((w + back) * (w + back)) / 2 AS s1 FROM w, n),
t AS (SELECT sum({s2}) AS s2 FROM (SELECT i, sum(w) AS own, sum(back) AS col FROM w GROUP BY 1)),
v AS (SELECT n / s0 * top / m2 AS i, -1 / (n - 1) AS e,
  (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - n * m4 / (m2 * m2) * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0))
  / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS var FROM s, t)
SELECT round(i, 7) AS morans_i, round(e, 9) AS expected_i, round(var, 10) AS variance,
  round(CASE WHEN var > 0 THEN (i - e) / sqrt(var) ELSE 0 END, 5) AS z_score FROM v"""


MORAN_DIGITS = {"morans_i": 7, "expected_i": 9, "variance": 10, "z_score": 5}


@query("g6_moran", _moran_sql("(own + col) * (own + col)"))
def _(spark, sf):
    return rounded(geo.moran(sites(spark, sf)).drop("p_value", "interpretation"), **MORAN_DIGITS)


@query("g6_moran_strict", _moran_sql("own * own"))
def _(spark, sf):
    return rounded(geo.moran(sites(spark, sf), strict=True).drop("p_value", "interpretation"), **MORAN_DIGITS)


@query("g7_geary", WEIGHTS_SQL + """SELECT round(c, 7) AS gearys_c, CAST(1 AS DOUBLE) AS expected_c, CASE WHEN c < 1 THEN 'Autocorrelação espacial positiva'
  WHEN c > 1 THEN 'Autocorrelação espacial negativa' ELSE 'Sem autocorrelação espacial' END AS interpretation
FROM (SELECT (max(n) - 1) * sum(w * (zi - zj) * (zi - zj)) / (2 * sum(w) * max(m2)) AS c FROM w, n)""")
def _(spark, sf):
    return rounded(geo.autocorrelation(sites(spark, sf), "geary"), gearys_c=7)
