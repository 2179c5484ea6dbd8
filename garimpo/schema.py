"""Column names, defaults and the session helpers every operator shares."""

from __future__ import annotations

import math
import tempfile
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANY = "TITULAR"
PLACE = "MUNICIPIO(S)"
STATE = "ESTADO"
SUBSTANCE = "PRIMEIRODESUBS"
AMOUNT = "CFEM"
LON = "LONGITUDE"
LAT = "LATITUDE"
DATE = "DATA"
REGION = "REGIAO"
KEY = "op_id"

# The column contract of the input table.
REQUIRED_COLUMNS = [
    "TITULAR", "MUNICIPIO(S)", "ESTADO", "PRIMEIRODESUBS", "CFEM", "LONGITUDE", "LATITUDE",
]
OPTIONAL_COLUMNS = ["DATA", "SEGUNDODESUBS", "TERCEIRODESUBS"]
DERIVED_COLUMNS = [
    "CFEM_FAIXA", "REGIAO", "PORTE_EMPRESA", "DENSIDADE_ESTADO", "DIVERSIFICACAO_EMPRESA",
]

# Parameter defaults.
CLUSTER_EPS_KM = 50.0
CLUSTER_MIN_SAMPLES = 3
ANOMALY_CONTAMINATION = 0.1
HOTSPOT_RADIUS_KM = 100.0


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = tempfile.mkdtemp(prefix="garimpo-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/garimpo-{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from there.

    Used where one intermediate result feeds several jobs. The table survives lost executors,
    and later readers get column pruning, file statistics and plan reuse.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Local property: among how many jobs that run side by side the rows to broadcast are divided.
SHARERS = "garimpo.sharers"


@contextmanager
def sharing(spark: SparkSession, n: int):
    """Let what is started inside share the memory of broadcasts: each of ``n`` jobs may send 1/n of the rows."""
    before = spark.sparkContext.getLocalProperty(SHARERS)
    spark.sparkContext.setLocalProperty(SHARERS, str(n * int(before or 1)))
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty(SHARERS, before)


def sized_broadcast(dim: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``dim`` marked for broadcast if it holds at most ``max_rows`` rows, else as it is; fewer inside ``sharing``.

    ``dim`` is computed once and written; the check and the join read the written table. A
    larger ``dim`` is left to a shuffle join, where adaptive execution splits skewed partitions.
    """
    dim = stage(dim)
    max_rows //= int(dim.sparkSession.sparkContext.getLocalProperty(SHARERS) or 1)
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else dim


def range_count(df: DataFrame, least: int, most: int = 4096) -> int:
    """Ranges to cut an axis into: as many as the session has shuffle partitions, within bounds."""
    return min(most, max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def lowest_hashes(df: DataFrame, h: Column, k: int, n: int | None = None) -> DataFrame:
    """Rows of ``df`` among which the ``k`` with the smallest 64-bit hash ``h`` are, about ``k`` in number.

    A threshold from the row count ``n`` filters rows before any of them is sorted or sent on, so
    what reaches the last task does not grow with the number of partitions.
    """
    n = df.count() if n is None else n
    if n <= 2 * k:
        return df
    share = (k + 10 * math.sqrt(k) + 100) / n
    if share >= 1:
        return df
    # written, so that the rows are made once for the count and for what follows
    low = stage(df.where(h < F.lit(int(-(2**63) + share * 2**64))))
    return low if low.limit(k).count() == min(k, n) else df


def scalar_of(df: DataFrame, *columns: str):
    """The only row of ``df`` as a struct column usable in any other query."""
    return df.select(F.struct(*(columns or df.columns)).alias("row")).scalar()
