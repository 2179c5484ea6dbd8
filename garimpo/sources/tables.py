"""Reading, writing and generating operation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.schema import AMOUNT, REQUIRED_COLUMNS
from garimpo.sources.split_csv import SPLITTABLE, read_split_csv


def read_csv(
    spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "utf-8", multiline: bool | None = None,
) -> DataFrame:
    """Delimited files as text columns; ``clean`` gives them their types.

    Every column is read as text, so no inference pass runs over the data. A quote inside a quoted
    text is doubled, and a quoted text may hold line breaks. Files are read in parallel pieces by
    ``split_csv`` where it knows the encoding, else whole. ``multiline=True`` reads each file whole, by one task,
    as stray quotes in plain texts require; ``False`` takes every line for a record. The header is taken from the
    files; a file whose header differs raises an error instead of being read by position: read
    such files by ``read_csv_files``.
    """
    if multiline is None and encoding.lower() in SPLITTABLE:
        return read_split_csv(spark, path, sep, encoding)
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", True)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multiline is not False)
    return reader.option("inferSchema", False).option("enforceSchema", False).csv(path)


def read_csv_files(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Files whose columns come in any order, matched by name; a missing column is null."""
    parts = [read_csv(spark, path, **options) for path in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table of a workbook or any other source once it has been landed as Parquet."""
    return spark.read.parquet(path)


#: Moments are written to the microsecond.
MOMENTS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV part files, written by all tasks in parallel; white space around texts is kept."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "timestampFormat": MOMENTS}
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', **kept).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One folder of JSON-lines part files; nulls are kept as explicit keys."""
    df.write.mode("overwrite").options(ignoreNullFields=False, timestampFormat=MOMENTS).json(path)


def check_contract(df: DataFrame) -> DataFrame:
    """One row ``(is_valid, missing)``; looks at column names only and runs no job on ``df``."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    return df.sparkSession.range(1).select(
        F.lit(not missing).alias("is_valid"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing"),
    )


# Vocabulary and distribution of the sample table.
SAMPLE_STATES = ["MG", "PA", "GO", "MT", "BA", "RS", "PR", "SP"]
SAMPLE_SUBSTANCES = ["FERRO", "OURO", "CALCÁRIO", "AREIA", "BAUXITA"]
SAMPLE_COMPANIES = ["EMPRESA A LTDA", "MINERADORA B S.A.", "COMPANHIA C", "EXTRATORA D"]


def sample_operations(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """Synthetic operations: uniform picks and coordinates, log-normal (10, 2) amounts."""

    def pick(words: list[str], salt: int):
        return F.element_at(
            F.array(*[F.lit(w) for w in words]),
            (F.floor(F.rand(seed + salt) * len(words)) + 1).cast("int"),
        )

    return spark.range(n).select(
        F.col("id").alias("op_id"),
        pick(SAMPLE_COMPANIES, 1).alias("TITULAR"),
        F.concat(F.lit("MUNICÍPIO "), F.col("id") + 1).alias("MUNICIPIO(S)"),
        pick(SAMPLE_STATES, 2).alias("ESTADO"),
        pick(SAMPLE_SUBSTANCES, 3).alias("PRIMEIRODESUBS"),
        F.exp(10 + 2 * F.randn(seed + 4)).alias(AMOUNT),
        (-74 + 42 * F.rand(seed + 5)).alias("LONGITUDE"),
        (-34 + 40 * F.rand(seed + 6)).alias("LATITUDE"),
    )


LITERAL_SCHEMA = T.StructType(
    [
        T.StructField("Titular", T.StringType()),
        T.StructField("Municipio", T.StringType()),
        T.StructField("Estado", T.StringType()),
        T.StructField("PrimeiroDeSUBS", T.StringType()),
        T.StructField("LONGITUDE", T.DoubleType()),
        T.StructField("LATITUDE", T.DoubleType()),
        T.StructField("CFEM", T.DoubleType()),
    ]
)

# The nine example operations.
LITERAL_ROWS = [
    ("Agrocity Mineração Ltda", "GOUVEIA", "MG", "QUARTZO", -43.733987, -18.442973, 19829.0),
    ("Alcoa World Alumina Brasil Ltda.", "JURUTI", "PA", "BAUXITA", -56.094998, -2.155253, 6620519.0),
    ("Almeida's Mineração e Terraplanagem Ltda", "NOVA SANTA HELENA", "MT", "OURO", -55.183686, -10.851, 6078.0),
    ("Alto Vale de Mineraçao Ltda Me", "TROMBUDO CENTRAL", "SC", "FOLHELHO", -49.792478, -27.30302, 8164.0),
    ("Amg Mineração S.a.", "BOM SUCESSO", "MG", "CASSITERITA", -51.764465, -23.707437, 343082.0),
    ("Anglo American Minério de Ferro Brasil S.a", "ALVORADA DE MINAS", "MG", "FERRO", -43.366084, -18.733593, 68370284.0),
    ("Anglo American Níquel Brasil Ltda.", "BARRO ALTO", "GO", "NÍQUEL", -48.915707, -14.973709, 4000860.0),
    ("Anglogold Ashanti Córrego do Sítio Mineração S.a.", "BARÃO DE COCAIS", "MG", "FERRO", -43.484882, -19.935847, 9066913.0),
    ("Aperam Inox América do Sul S.a.", "SENADOR MODESTINO GONÇALVES", "MG", "MANGANÊS", -43.222975, -17.946025, 28709.0),
]


def literal_operations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LITERAL_ROWS, LITERAL_SCHEMA)
