"""Small reference tables. All values in this module are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Alternative header -> canonical header.
HEADER_ALIASES = {
    "UF": "ESTADO",
    "ESTADO(S)": "ESTADO",
    "MUNICIPIO": "MUNICIPIO(S)",
    "MUNICÍPIO": "MUNICIPIO(S)",
    "MUNICÍPIO(S)": "MUNICIPIO(S)",
    "PRIMEIRO DE SUBS": "PRIMEIRODESUBS",
    "PRIMEIRODESUBS.1": "PRIMEIRODESUBS",
    "SUBSTÂNCIA": "PRIMEIRODESUBS",
    "SUBSTANCIA": "PRIMEIRODESUBS",
    "VALOR_CFEM": "CFEM",
    "RECEITA_CFEM": "CFEM",
}

# State name -> two-letter code.
STATE_CODES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPÁ": "AP", "AMAZONAS": "AM", "BAHIA": "BA",
    "CEARÁ": "CE", "DISTRITO FEDERAL": "DF", "ESPÍRITO SANTO": "ES", "GOIÁS": "GO",
    "MARANHÃO": "MA", "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS", "MINAS GERAIS": "MG",
    "PARÁ": "PA", "PARAÍBA": "PB", "PARANÁ": "PR", "PERNAMBUCO": "PE", "PIAUÍ": "PI",
    "RIO DE JANEIRO": "RJ", "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS",
    "RONDÔNIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC", "SÃO PAULO": "SP",
    "SERGIPE": "SE", "TOCANTINS": "TO",
}

# Region -> its states.
REGION_STATES = {
    "Norte": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "Nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Centro-Oeste": ["GO", "MT", "MS", "DF"],
    "Sudeste": ["ES", "MG", "RJ", "SP"],
    "Sul": ["PR", "RS", "SC"],
}

# State -> reference point (latitude, longitude).
STATE_POINTS = {
    "AC": (-9.0238, -70.8120), "AL": (-9.5713, -36.7820), "AP": (1.4050, -51.7700),
    "AM": (-3.4168, -65.8561), "BA": (-12.5797, -41.7007), "CE": (-5.4984, -39.3206),
    "DF": (-15.7998, -47.8645), "ES": (-19.1834, -40.3089), "GO": (-15.8270, -49.8362),
    "MA": (-4.9609, -45.2744), "MT": (-12.6819, -56.9211), "MS": (-20.7722, -54.7852),
    "MG": (-18.5122, -44.5550), "PA": (-3.9999, -51.9000), "PB": (-7.2399, -36.7820),
    "PR": (-24.8932, -51.4386), "PE": (-8.8137, -36.9541), "PI": (-8.5000, -42.9000),
    "RJ": (-22.3094, -42.4508), "RN": (-5.4026, -36.9541), "RS": (-30.0346, -51.2177),
    "RO": (-10.9472, -61.9857), "RR": (1.9981, -61.3300), "SC": (-27.2423, -50.2189),
    "SP": (-23.6821, -46.8755), "SE": (-10.5741, -37.3857), "TO": (-10.1753, -48.2982),
}

# Region -> (lat_min, lat_max, lon_min, lon_max).
REGION_BOXES = {
    "Norte": (-9, 5, -74, -44),
    "Nordeste": (-18, -1, -48, -35),
    "Centro-Oeste": (-24, -7, -61, -47),
    "Sudeste": (-25, -14, -50, -39),
    "Sul": (-34, -22, -58, -48),
}

# Bounding box of the country.
COUNTRY_BOX = {"lon_min": -74, "lon_max": -32, "lat_min": -34, "lat_max": 6}


def _values(spark: SparkSession, rows, columns: str) -> DataFrame:
    text = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)!r}D" for v in row) + ")"
        for row in rows
    )
    return spark.sql(f"SELECT * FROM VALUES {text} AS dim({columns})")


def state_names(spark: SparkSession) -> DataFrame:
    return _values(spark, STATE_CODES.items(), "state_name, state_code")


def state_points(spark: SparkSession) -> DataFrame:
    return _values(
        spark, [(s, *p) for s, p in STATE_POINTS.items()], "ESTADO, point_lat, point_lon"
    )


def region_boxes(spark: SparkSession) -> DataFrame:
    return _values(
        spark,
        [(r, *b) for r, b in REGION_BOXES.items()],
        "REGIAO, lat_min, lat_max, lon_min, lon_max",
    )


def labels(spark: SparkSession, column: str, values: list[str]) -> DataFrame:
    """A one-column table of labels, to keep empty classes in a result."""
    return _values(spark, [(v,) for v in values], column)


def region_of(state: Column) -> Column:
    """Region of a state code, as a CASE over the fixed lists; null for anything else."""
    out = None
    for region, states in REGION_STATES.items():
        out = (F if out is None else out).when(state.isin(states), region)
    return out
