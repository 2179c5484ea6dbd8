"""Query registry and the views that map the star-schema tables onto operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.operators import dims


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, the SQL text it must agree with."""

    def register(run):
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round result columns, so the last bits of a double do not decide a comparison."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


CODES = list(dims.STATE_CODES.values())
NAMES = list(dims.STATE_CODES)


def _pick(words: list[str], index):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One operation per line item. Only the columns a query uses are read from the files."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    line, part, supplier = table("lineitem"), table("part"), table("supplier")
    nation = table("nation")
    joined = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
            F.col("l_shipdate").cast("date").cast("string"),
        ).alias("op_id"),
        F.col("s_name").alias("TITULAR"),
        F.concat("n_name", F.lit("-M"), (F.col("l_partkey") % 40).cast("string")).alias("MUNICIPIO(S)"),
        _pick(CODES, F.col("s_nationkey")).alias("ESTADO"),
        F.col("p_brand").alias("PRIMEIRODESUBS"),
        F.round(F.col("l_extendedprice") * (1 + F.col("l_partkey") % 97), 2).alias("CFEM"),
        F.col("l_shipdate").cast("date").alias("DATA"),
        (-74 + (F.col("l_suppkey") * 7919 + F.col("l_partkey") * 31) % 42000 / 1000.0).alias("LONGITUDE"),
        (-34 + (F.col("l_suppkey") * 6271 + F.col("l_partkey") * 17) % 40000 / 1000.0).alias("LATITUDE"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


OPERATIONS_SQL = f"""operations AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_shipdate AS DATE)) AS op_id,
         s_name AS TITULAR,
         concat(n_name, '-M', l_partkey % 40) AS "MUNICIPIO(S)",
         {_sql_list(CODES)}[s_nationkey + 1] AS ESTADO,
         p_brand AS PRIMEIRODESUBS,
         round(l_extendedprice * (1 + l_partkey % 97), 2) AS CFEM,
         CAST(l_shipdate AS DATE) AS DATA,
         -74 + ((l_suppkey * 7919 + l_partkey * 31) % 42000) / CAST(1000 AS DOUBLE) AS LONGITUDE,
         -34 + ((l_suppkey * 6271 + l_partkey * 17) % 40000) / CAST(1000 AS DOUBLE) AS LATITUDE
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""

REGION_SQL = "CASE " + " ".join(
    f"WHEN ESTADO IN ({', '.join(repr(s) for s in states)}) THEN '{region}'"
    for region, states in dims.REGION_STATES.items()
) + " END"

BAND_SQL = """CASE WHEN CFEM <= 0 THEN NULL WHEN CFEM <= 10000 THEN 'Até 10K'
  WHEN CFEM <= 100000 THEN '10K-100K' WHEN CFEM <= 1000000 THEN '100K-1M'
  WHEN CFEM <= 10000000 THEN '1M-10M' ELSE 'Acima 10M' END"""

SIZE_SQL = """CASE WHEN CFEM <= 50000 THEN 'Pequena' WHEN CFEM <= 500000 THEN 'Média'
  WHEN CFEM <= 5000000 THEN 'Grande' WHEN CFEM > 5000000 THEN 'Muito Grande'
  ELSE 'Não Classificada' END"""

ENRICHED_SQL = f"""{OPERATIONS_SQL},
enriched AS (
  SELECT *, {BAND_SQL} AS CFEM_FAIXA, {SIZE_SQL} AS PORTE_EMPRESA, {REGION_SQL} AS REGIAO
  FROM operations)"""

TOTAL = "CAST(sum(CAST(CFEM AS DECIMAL(24,6))) AS DOUBLE)"
MEAN = f"({TOTAL} / count(CFEM))"


def ops(body: str) -> str:
    return f"WITH {OPERATIONS_SQL}\n{body}"


def enriched_sql(body: str) -> str:
    return f"WITH {ENRICHED_SQL}\n{body}"


def enriched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with the row-wise derived columns (band, size, region)."""
    from garimpo.functions.labels import operation_size
    from garimpo.operators.enrich import amount_band, with_region

    amount = F.col("CFEM")
    return with_region(
        operations(spark, sf_dir).withColumns(
            {"CFEM_FAIXA": amount_band(amount), "PORTE_EMPRESA": operation_size(amount)}
        )
    )


def raw_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations as untidy text under untidy headers, as they arrive from a spreadsheet."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    joined = (
        table("lineitem")
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    suffix = (
        F.when(s % 4 == 0, " Ltda.").when(s % 4 == 1, " S.A.").when(s % 4 == 2, " & cia me")
        .otherwise(" s.a. ltda / epp")
    )

    def comma(c):
        return F.concat(F.lit(" "), F.replace(c.cast("string"), F.lit("."), F.lit(",")))

    amount = F.round(F.col("l_extendedprice") * (1 + p % 97), 2).cast("decimal(18,2)")
    lon = (-74 + (s * 7919 + p * 31) % 42000 / 1000.0).cast("decimal(9,3)")
    lat = (-34 + (s * 6271 + p * 17) % 40000 / 1000.0).cast("decimal(9,3)")
    return joined.select(
        F.when(p % 50 != 0, F.concat(F.lit("  "), F.lower("s_name"), suffix)).alias(" Titular "),
        F.concat(F.lower("n_name"), F.lit("-m"), (p % 40).cast("string"), F.lit("  ")).alias("Municipio"),
        F.when(p % 41 == 0, "xx")
        .when(s % 3 == 0, F.lower(_pick(NAMES, F.col("s_nationkey"))))
        .otherwise(F.concat(F.lit(" "), F.lower(_pick(CODES, F.col("s_nationkey")))))
        .alias("uf"),
        F.lower("p_brand").alias("substancia"),
        F.when(p % 37 == 0, "1.234,56").when(p % 53 == 0, "-5,0").otherwise(comma(amount)).alias("valor_cfem"),
        F.when(p % 29 == 0, "-80,5").otherwise(comma(lon)).alias("longitude"),
        comma(lat).alias("latitude"),
        F.when(p % 31 == 0, "13/13/2024").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("data"),
    )


RAW_SQL = f"""raw AS (
  SELECT CASE WHEN l_partkey % 50 <> 0 THEN concat('  ', lower(s_name),
           CASE l_suppkey % 4 WHEN 0 THEN ' Ltda.' WHEN 1 THEN ' S.A.' WHEN 2 THEN ' & cia me'
                ELSE ' s.a. ltda / epp' END) END AS r_company,
         concat(lower(n_name), '-m', l_partkey % 40, '  ') AS r_place,
         CASE WHEN l_partkey % 41 = 0 THEN 'xx'
              WHEN l_suppkey % 3 = 0 THEN lower({_sql_list(NAMES)}[s_nationkey + 1])
              ELSE concat(' ', lower({_sql_list(CODES)}[s_nationkey + 1])) END AS r_state,
         lower(p_brand) AS r_substance,
         CASE WHEN l_partkey % 37 = 0 THEN '1.234,56' WHEN l_partkey % 53 = 0 THEN '-5,0'
              ELSE concat(' ', replace(CAST(CAST(round(l_extendedprice * (1 + l_partkey % 97), 2)
                AS DECIMAL(18,2)) AS VARCHAR), '.', ',')) END AS r_amount,
         CASE WHEN l_partkey % 29 = 0 THEN '-80,5' ELSE concat(' ', replace(CAST(CAST(
            -74 + ((l_suppkey * 7919 + l_partkey * 31) % 42000) / CAST(1000 AS DOUBLE)
            AS DECIMAL(9,3)) AS VARCHAR), '.', ',')) END AS r_lon,
         concat(' ', replace(CAST(CAST(
            -34 + ((l_suppkey * 6271 + l_partkey * 17) % 40000) / CAST(1000 AS DOUBLE)
            AS DECIMAL(9,3)) AS VARCHAR), '.', ',')) AS r_lat,
         CASE WHEN l_partkey % 31 = 0 THEN '13/13/2024'
              ELSE strftime(l_shipdate, '%d/%m/%Y') END AS r_date
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey),
typed AS (
  SELECT upper(trim(r_company)) AS company, upper(trim(r_place)) AS place,
         upper(trim(r_state)) AS state, upper(trim(r_substance)) AS substance,
         TRY_CAST(replace(replace(r_amount, ' ', ''), ',', '.') AS DOUBLE) AS amount,
         TRY_CAST(replace(replace(r_lon, ' ', ''), ',', '.') AS DOUBLE) AS lon,
         TRY_CAST(replace(replace(r_lat, ' ', ''), ',', '.') AS DOUBLE) AS lat,
         CAST(try_strptime(r_date, '%d/%m/%Y') AS DATE) AS day
  FROM raw)"""

STATE_CASE_SQL = "CASE state " + " ".join(
    f"WHEN '{name}' THEN '{code}'" for name, code in dims.STATE_CODES.items()
) + " ELSE state END"

VALID_STATES_SQL = ", ".join(f"'{c}'" for c in CODES)


def company_sql(column: str) -> str:
    """Company standardisation in the oracle's regex dialect (default mode)."""
    out = f"regexp_replace({column}, '[^\\p{{L}}\\p{{N}}_\\s.-]', '', 'g')"
    for pattern, suffix in (
        (r"\bLTDA\.?\b", "LTDA"), (r"\bS\.?A\b\.?", "S.A."), (r"\bS\.?A\.?\s+LTDA\.?\b", "S.A."),
        (r"\bME\b", "ME"), (r"\bEPP\b", "EPP"), (r"\bEIRELI\b", "EIRELI"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{suffix}', 'g')"
    return out


def raw_sql(body: str) -> str:
    return f"WITH {RAW_SQL}\n{body}"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per customer, for the pairwise spatial operators: key, place and amount."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("op_id"),
        F.col("c_name").alias("TITULAR"),
        F.col("c_mktsegment").alias("PRIMEIRODESUBS"),
        _pick(CODES, F.col("c_nationkey")).alias("ESTADO"),
        F.concat(F.lit("MUN-"), (k % 40).cast("string")).alias("MUNICIPIO(S)"),
        F.abs("c_acctbal").alias("CFEM"),
        (-74 + (k * 7919 + F.col("c_nationkey") * 31) % 42000 / 1000.0).alias("LONGITUDE"),
        (-34 + (k * 6271 + F.col("c_nationkey") * 17) % 40000 / 1000.0).alias("LATITUDE"),
    )


SITES_SQL = f"""sites AS (
  SELECT c_custkey AS op_id, c_name AS TITULAR, c_mktsegment AS PRIMEIRODESUBS,
         {_sql_list(CODES)}[c_nationkey + 1] AS ESTADO,
         concat('MUN-', c_custkey % 40) AS "MUNICIPIO(S)", abs(c_acctbal) AS CFEM,
         -74 + ((c_custkey * 7919 + c_nationkey * 31) % 42000) / CAST(1000 AS DOUBLE) AS LONGITUDE,
         -34 + ((c_custkey * 6271 + c_nationkey * 17) % 40000) / CAST(1000 AS DOUBLE) AS LATITUDE
  FROM customer)"""


def sites_sql(body: str) -> str:
    return f"WITH {SITES_SQL}{body}"
