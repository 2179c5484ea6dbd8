"""Queries: sources, cleaning, derived columns, filters."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from garimpo.operators import charts, clean, enrich, kpi
from garimpo.plans.base import (
    OPERATIONS_SQL, STATE_CASE_SQL, TOTAL, VALID_STATES_SQL, company_sql, enriched_rows,
    enriched_sql, operations, ops, query, raw_operations, raw_sql, rounded,
)
from garimpo.schema import shared_folder
from garimpo.sources import tables


def _scratch(spark, name: str) -> str:
    """A new folder for a round trip, in the shared folder of the session."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------

# some names with separators, quotes and line breaks, in both dialects
ODD_NAME_SQL = """CASE WHEN op_id LIKE '%7' THEN concat('"', TITULAR, '"; , filial', chr(10), 'B') ELSE TITULAR END"""


def _odd_name():
    odd = F.concat(F.lit('"'), F.col("TITULAR"), F.lit('"; , filial\nB'))
    return F.when(F.col("op_id").like("%7"), odd).otherwise(F.col("TITULAR")).alias("TITULAR")


@query("s1_csv_scan", ops(f"""SELECT op_id, {ODD_NAME_SQL} AS TITULAR, ESTADO, CAST(CAST(CFEM AS DECIMAL(18,2)) AS VARCHAR) AS CFEM
FROM operations"""))
def _(spark, sf):
    path = _scratch(spark, "csv")
    out = operations(spark, sf).select(
        "op_id", _odd_name(), "ESTADO", F.col("CFEM").cast("decimal(18,2)").alias("CFEM")
    )
    # two folders whose columns come in a different order
    for name, part in (("a", out.where("ESTADO < 'N'")), ("b", out.where("ESTADO >= 'N'").select(*out.columns[::-1]))):
        part.write.option("header", True).option("sep", ";").option("escape", '"').csv(f"{path}/{name}")
    return tables.read_csv_files(spark, [f"{path}/a", f"{path}/b"])


@query("s1_split_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf):
    # texts with line breaks, quotes and separators, read back in pieces
    path = _scratch(spark, "csv")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    plain = {"header": True, "sep": ";", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(**plain).csv(path)
    back = tables.read_csv(spark, path)
    return back.select(*[F.col(name).cast(kind).alias(name) for name, kind in docs.dtypes])


@query("s2_parquet_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    return tables.read_parquet(spark, f"{sf}/supplier.parquet")


@query("s5_contract_check")
def _(spark, sf):
    return tables.check_contract(operations(spark, sf)).withColumn(
        "missing", F.array_join("missing", ",")
    )


@query("s6_csv_sink", ops(f"""SELECT op_id, {ODD_NAME_SQL} AS TITULAR, ESTADO, PRIMEIRODESUBS, round(CFEM, 2) AS CFEM
FROM operations WHERE ESTADO IN ('MG', 'PA', 'BA')"""))
def _(spark, sf):
    path = _scratch(spark, "filtered")
    kept = kpi.select_rows(operations(spark, sf), states=["MG", "PA", "BA"])
    tables.write_csv(kept.select("op_id", _odd_name(), "ESTADO", "PRIMEIRODESUBS", "CFEM"), path)
    return tables.read_csv(spark, path, sep=",").withColumn("CFEM", F.col("CFEM").cast("double"))


# --- cleaning ------------------------------------------------------------------------------

@query("p1_p2_headers", raw_sql("""SELECT r_company AS "TITULAR", r_place AS "MUNICIPIO(S)", r_state AS "ESTADO",
r_substance AS "PRIMEIRODESUBS", r_amount AS "CFEM", r_lon AS "LONGITUDE", r_lat AS "LATITUDE", r_date AS "DATA"
FROM raw"""))
def _(spark, sf):
    return clean.normalise_headers(raw_operations(spark, sf))


@query("p3_key_text", raw_sql("""SELECT company AS "TITULAR", place AS "MUNICIPIO(S)", state AS "ESTADO",
substance AS "PRIMEIRODESUBS" FROM typed"""))
def _(spark, sf):
    keys = clean.normalise_keys(clean.normalise_headers(raw_operations(spark, sf)))
    return keys.select("TITULAR", "MUNICIPIO(S)", "ESTADO", "PRIMEIRODESUBS")


@query("p4_locale_numbers", raw_sql("SELECT amount AS CFEM, lon AS LONGITUDE, lat AS LATITUDE FROM typed"))
def _(spark, sf):
    out = clean.parse_numbers(clean.normalise_headers(raw_operations(spark, sf)))
    return out.select("CFEM", "LONGITUDE", "LATITUDE")


@query("p5_dates", raw_sql("SELECT day AS DATA, count(*) AS n FROM typed GROUP BY 1"))
def _(spark, sf):
    out = clean.parse_dates(clean.normalise_headers(raw_operations(spark, sf)))
    return out.groupBy(F.col("DATA").cast("date").alias("DATA")).agg(F.count("*").alias("n"))


@query("p6_f3_state_codes", raw_sql(f"""SELECT ESTADO, count(*) AS n
FROM (SELECT {STATE_CASE_SQL} AS ESTADO FROM typed) WHERE ESTADO IN ({VALID_STATES_SQL}) GROUP BY 1"""))
def _(spark, sf):
    out = clean.normalise_keys(clean.normalise_headers(raw_operations(spark, sf)))
    return clean.state_codes(out).groupBy("ESTADO").agg(F.count("*").alias("n"))


@query("p7_p8_company_names", raw_sql(f"""SELECT DISTINCT {company_sql('company')} AS "TITULAR" FROM typed"""))
def _(spark, sf):
    out = clean.normalise_keys(clean.normalise_headers(raw_operations(spark, sf)))
    return clean.company_names(out).select("TITULAR").distinct()


CLEAN_SQL = raw_sql(f""", positive AS (
  SELECT * FROM typed WHERE lon BETWEEN -74 AND -32 AND lat BETWEEN -34 AND 6 AND amount > 0),
q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM positive),
cleaned AS (
  SELECT {company_sql('company')} AS "TITULAR", place AS "MUNICIPIO(S)", {STATE_CASE_SQL} AS "ESTADO",
         substance AS "PRIMEIRODESUBS", amount AS "CFEM", lon AS "LONGITUDE", lat AS "LATITUDE",
         day AS "DATA",
         amount < q1 - 3 * (q3 - q1) OR amount > q3 + 3 * (q3 - q1) AS "CFEM_OUTLIER"
  FROM positive, q)
SELECT * FROM cleaned WHERE ESTADO IN ({VALID_STATES_SQL})""")


@query("clean_table", CLEAN_SQL)
def _(spark, sf):
    return clean.clean(raw_operations(spark, sf)).withColumn("DATA", F.col("DATA").cast("date"))


# --- derived columns -----------------------------------------------------------------------

@query("p9_amount_band", enriched_sql("SELECT CFEM_FAIXA, count(*) AS n FROM enriched GROUP BY 1"))
def _(spark, sf):
    return enriched_rows(spark, sf).groupBy("CFEM_FAIXA").agg(F.count("*").alias("n"))


@query("p10_j1_region", enriched_sql("SELECT ESTADO, REGIAO, count(*) AS n FROM enriched GROUP BY 1, 2"))
def _(spark, sf):
    return enriched_rows(spark, sf).groupBy("ESTADO", "REGIAO").agg(F.count("*").alias("n"))


@query("p11_operation_size", enriched_sql("SELECT PORTE_EMPRESA, count(*) AS n FROM enriched GROUP BY 1"))
def _(spark, sf):
    return enriched_rows(spark, sf).groupBy("PORTE_EMPRESA").agg(F.count("*").alias("n"))


@query("enriched_table", enriched_sql("""SELECT e.op_id, e.TITULAR, e.CFEM_FAIXA, e.PORTE_EMPRESA, e.REGIAO,
  d.n AS DENSIDADE_ESTADO, v.n AS DIVERSIFICACAO_EMPRESA
FROM enriched e
JOIN (SELECT ESTADO, count(*) AS n FROM operations GROUP BY 1) d USING (ESTADO)
JOIN (SELECT TITULAR, count(DISTINCT PRIMEIRODESUBS) AS n FROM operations GROUP BY 1) v ON v.TITULAR = e.TITULAR"""))
def _(spark, sf):
    return enrich.enrich(operations(spark, sf)).select(
        "op_id", "TITULAR", "CFEM_FAIXA", "PORTE_EMPRESA", "REGIAO", "DENSIDADE_ESTADO",
        "DIVERSIFICACAO_EMPRESA",
    )


@query("w1_state_density", ops("""SELECT op_id, count(*) OVER (PARTITION BY ESTADO) AS DENSIDADE_ESTADO
FROM operations"""))
def _(spark, sf):
    return enrich.with_state_density(operations(spark, sf)).select("op_id", "DENSIDADE_ESTADO")


@query("w2_j2_company_diversity", ops("""SELECT op_id, n AS DIVERSIFICACAO_EMPRESA FROM operations
JOIN (SELECT TITULAR, count(DISTINCT PRIMEIRODESUBS) AS n FROM operations GROUP BY 1) USING (TITULAR)"""))
def _(spark, sf):
    return enrich.with_company_diversity(operations(spark, sf)).select("op_id", "DIVERSIFICACAO_EMPRESA")


# a tenth of the amounts is far above the others and some rows occur twice, in both dialects
SPREAD_SQL = f"""{OPERATIONS_SQL},
once AS (SELECT * REPLACE (CASE WHEN op_id LIKE '%3' THEN CFEM * 1000 ELSE CFEM END AS CFEM) FROM operations),
spread AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE op_id LIKE '%7')"""


def spread(spark, sf):
    big = F.when(F.col("op_id").like("%3"), F.col("CFEM") * 1000).otherwise(F.col("CFEM"))
    once = operations(spark, sf).withColumn("CFEM", big)
    return once.unionByName(once.where(F.col("op_id").like("%7")))


OUTLIER_SQL = f"""{SPREAD_SQL},
q AS (SELECT quantile_cont(CFEM, 0.25) AS q1, quantile_cont(CFEM, 0.75) AS q3 FROM spread),
flagged AS (SELECT o.*, CFEM < q1 - 3 * (q3 - q1) OR CFEM > q3 + 3 * (q3 - q1) AS CFEM_OUTLIER
            FROM spread o, q)"""


@query("p12_outlier_flag", f"WITH {OUTLIER_SQL} SELECT op_id, CFEM_OUTLIER FROM flagged")
def _(spark, sf):
    return clean.flag_outliers(spread(spark, sf)).select("op_id", "CFEM_OUTLIER")


@query("p19_log_amount", ops("SELECT op_id, round(log10(CFEM + 1), 6) AS log_cfem FROM operations"))
def _(spark, sf):
    return operations(spark, sf).select(
        "op_id", F.round(F.log10(F.col("CFEM") + 1), 6).alias("log_cfem")
    )


@query("p20_marker_size", ops("""SELECT op_id, round(n, 6) AS normalized, round(greatest(5, 50 * n), 6) AS marker_size
FROM (SELECT op_id, (CFEM - lo) / nullif(hi - lo, 0) AS n
      FROM operations, (SELECT min(CFEM) AS lo, max(CFEM) AS hi FROM operations))"""))
def _(spark, sf):
    return rounded(charts.marker_sizes(operations(spark, sf)), normalized=6, marker_size=6)


@query("p21_value_tier", ops("""SELECT op_id, CASE WHEN CFEM > q9 THEN 'red' WHEN CFEM > q7 THEN 'orange' ELSE 'blue' END AS tier,
  CASE WHEN CFEM > q9 THEN 10 WHEN CFEM > q7 THEN 8 ELSE 6 END AS size
FROM operations, (SELECT quantile_cont(CFEM, 0.9) AS q9, quantile_cont(CFEM, 0.7) AS q7 FROM operations)"""))
def _(spark, sf):
    return charts.value_tiers(operations(spark, sf))


@query("p23_currency", ops("""SELECT op_id, concat('R$ ', format('{:,.2f}', CFEM)) AS "CFEM_Formatado" FROM operations"""))
def _(spark, sf):
    return operations(spark, sf).select("op_id", kpi.currency(F.col("CFEM")).alias("CFEM_Formatado"))


@query("p24_display_columns", ops("""SELECT TITULAR, "MUNICIPIO(S)", ESTADO, PRIMEIRODESUBS,
  concat('R$ ', format('{:,.2f}', CFEM)) AS "CFEM_Formatado" FROM operations"""))
def _(spark, sf):
    return kpi.display_columns(operations(spark, sf))


# --- filters -------------------------------------------------------------------------------

@query("f1_bounding_box", raw_sql("""SELECT count(*) AS n, round(sum(lon), 2) AS lon_sum FROM typed
WHERE lon BETWEEN -74 AND -32 AND lat BETWEEN -34 AND 6"""))
def _(spark, sf):
    out = clean.valid_coordinates(clean.parse_numbers(clean.normalise_headers(raw_operations(spark, sf))))
    return out.agg(F.count("*").alias("n"), F.round(F.sum("LONGITUDE"), 2).alias("lon_sum"))


@query("f2_positive_amount", raw_sql("SELECT count(*) AS n, min(amount) AS low FROM typed WHERE amount > 0"))
def _(spark, sf):
    out = clean.positive_amounts(clean.parse_numbers(clean.normalise_headers(raw_operations(spark, sf))))
    return out.agg(F.count("*").alias("n"), F.min("CFEM").alias("low"))


@query("f4_dashboard_filter", ops("""SELECT op_id, TITULAR, ESTADO, PRIMEIRODESUBS, CFEM FROM operations
WHERE ESTADO IN ('MG', 'PA', 'BA', 'GO') AND PRIMEIRODESUBS IN ('Brand#1', 'Brand#2', 'Brand#3')
AND CFEM >= 50000 AND CFEM <= 2000000"""))
def _(spark, sf):
    return kpi.select_rows(
        operations(spark, sf), ["MG", "PA", "BA", "GO"], ["Brand#1", "Brand#2", "Brand#3"], 50_000, 2_000_000
    ).select("op_id", "TITULAR", "ESTADO", "PRIMEIRODESUBS", "CFEM")


@query("f4b_filter_options", ops("SELECT DISTINCT PRIMEIRODESUBS FROM operations"))
def _(spark, sf):
    return kpi.filter_options(operations(spark, sf), "PRIMEIRODESUBS")


@query("f4b_default_substances", ops("SELECT DISTINCT PRIMEIRODESUBS FROM operations ORDER BY 1 LIMIT 10"))
def _(spark, sf):
    return kpi.filter_options(operations(spark, sf), "PRIMEIRODESUBS").limit(10)


@query("f4b_amount_limits", ops("SELECT min(CFEM) AS low, max(CFEM) AS high FROM operations"))
def _(spark, sf):
    return kpi.amount_limits(operations(spark, sf))


@query("f5_complete_rows", raw_sql("""SELECT count(*) AS n FROM typed
WHERE company IS NOT NULL AND amount IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL"""))
def _(spark, sf):
    out = clean.parse_numbers(clean.normalise_headers(raw_operations(spark, sf)))
    return out.na.drop(subset=["TITULAR", "CFEM", "LONGITUDE", "LATITUDE"]).agg(F.count("*").alias("n"))


@query("f7_region_size_filter", enriched_sql(f"""SELECT REGIAO, PORTE_EMPRESA, count(*) AS n, round({TOTAL}, 2) AS total
FROM enriched WHERE REGIAO IN ('Sudeste', 'Norte') AND PORTE_EMPRESA IN ('Grande', 'Muito Grande') GROUP BY 1, 2"""))
def _(spark, sf):
    from garimpo.functions.numbers import total

    kept = kpi.select_rows(
        enriched_rows(spark, sf), regions=["Sudeste", "Norte"], sizes=["Grande", "Muito Grande"]
    )
    out = kept.groupBy("REGIAO", "PORTE_EMPRESA").agg(F.count("*").alias("n"), total("CFEM").alias("total"))
    return rounded(out, total=2)


@query("f8_one_company", ops("SELECT op_id, CFEM FROM operations WHERE TITULAR = 'Supplier#000000007'"))
def _(spark, sf):
    return kpi.select_rows(operations(spark, sf), company="Supplier#000000007").select("op_id", "CFEM")
