"""Exact dedup by a content sort.

Rows are range-partitioned by sampled splitters over ``(first bytes, SHA-256, key)`` of the
normalised text, sorted externally by the whole text, and each row is compared in full with its
neighbour. The key is part of the splitters, so a text that fills many partitions is spread over
them; runs that cross a border between partitions are joined again by full comparison of the texts
at the border. Only 64 characters, a digest and the key of a sampled row reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.llm.common import documents, texts_of
from garimpo.llm.registry import query
from garimpo.schema import stage

PREFIX_CHARACTERS = 64
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32())]
    + [(name, pa.int64()) for name in ("run", "run_size", "run_low", "run_high", "runs")]
    + [("first_text", pa.string()), ("last_text", pa.string())]
)
RUNS = (
    "doc_id bigint, text_sha256 string, part int, run bigint, run_size bigint, run_low bigint, "
    "run_high bigint, runs bigint, first_text string, last_text string"
)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours of a sorted partition, with size and extreme keys.

    The last row of a partition has no run number; it carries the number of runs and the texts
    at the two borders.
    """
    part, run, first, previous = TaskContext.get().partitionId(), -1, None, None
    ids: list = []
    digest = None
    out: list[list] = [[] for _ in SCHEMA]

    def close() -> None:
        n, known = len(ids), [i for i in ids if i is not None]
        values = (
            ids, [digest] * n, [part] * n, [run] * n, [n] * n, [min(known, default=None)] * n,
            [max(known, default=None)] * n, [None] * n, [None] * n, [None] * n,
        )
        for column, more in zip(out, values):
            column.extend(more)

    for batch in batches:
        text = batch.column("text")
        n = batch.num_rows
        if not n:
            continue
        # neighbouring full comparisons
        joins = [run >= 0 and text[0].as_py() == previous] + pc.equal(text.slice(1), text.slice(0, n - 1)).to_pylist()
        first = text[0].as_py() if run < 0 else first
        previous = text[n - 1].as_py()
        for doc_id, sha, join in zip(batch.column("doc_id").to_pylist(), batch.column("sha").to_pylist(), joins):
            if not join:
                close()
                run, ids, digest = run + 1, [], sha
            ids.append(doc_id)
        if len(out[0]) >= 4096:
            yield _batch(out)
            out = [[] for _ in SCHEMA]
    if run >= 0:
        close()
        yield _batch(out)
        yield _batch([[None], [None], [part], [None], [None], [None], [None], [run + 1], [first], [previous]])


def exact_groups(
    docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when ``normalise(text)`` is identical (default: no change). ``keep`` is
    ``smallest`` or ``largest``: which ``doc_id`` of a group stays. A null text counts as empty,
    the empty text is a text like any other. Repeated rows (same id and text) are one group and
    all carry the same answer. A null ``doc_id`` is kept only in a group without any id.
    An empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    rows = texts_of(docs)
    if normalise is not None:
        rows = rows.withColumn("text", normalise(F.col("text")))
    rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = F.substring("text", 1, PREFIX_CHARACTERS)
    ordered = rows.repartitionByRange(partitions, head, "sha", "doc_id").sortWithinPartitions(
        F.substring("text", 1, PREFIX_CHARACTERS), "sha", "text", "doc_id"
    )
    runs = stage(ordered.mapInArrow(_runs, RUNS))
    rows, borders = runs.where("run is not null").drop("runs", "first_text", "last_text"), runs.where("run is null")

    # one row per partition: does its first run continue the last run of the partition before?
    line = Window.orderBy("part")
    joined = borders.select(
        "part", "runs", (F.col("first_text") == F.lag("last_text").over(line)).alias("continues")
    )
    ends = rows.join(F.broadcast(joined.select("part", "runs")), "part").where(
        (F.col("run") == 0) | (F.col("run") == F.col("runs") - 1)
    ).groupBy("part", "run").agg(
        F.count("*").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    # a chain starts at every end run that does not continue; single-run partitions pass it on
    chain = ends.join(joined, "part").withColumn(
        "starts", F.when((F.col("run") == 0) & F.coalesce("continues", F.lit(False)), 0).otherwise(1)
    ).withColumn("chain", F.sum("starts").over(Window.orderBy("part", "run")))
    chain = stage(chain.select("part", "run", "size", "low", "high", "chain"))
    whole = chain.join(
        chain.groupBy("chain").agg(
            F.sum("size").alias("all_size"), F.min("low").alias("all_low"), F.max("high").alias("all_high")
        ), "chain",
    ).select("part", "run", "all_size", "all_low", "all_high")
    low, high = F.coalesce("all_low", "run_low"), F.coalesce("all_high", "run_high")
    keep_id = high if keep == "largest" else low
    return rows.join(F.broadcast(whole), ["part", "run"], "left").select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("all_size", "run_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query("op1_exact_dedup", SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")
