"""How filters act together: what every subset of them, and so every order, keeps and loses.

1. One pass over whole texts gives the counts that the filters' conditions use; only counts and a
   digest of the text leave it.
2. Copies: the smallest ``doc_id`` of every digest that occurs twice, joined back; digests that many
   rows hold are sent to all executors, so no text gathers its rows in one task.
3. Each document becomes a survival word of ``2 ** filters`` bits (32 for five): bit S is set if the
   document passes every filter of subset S. Carry-save adders count each bit position over all
   words of a part and label inside tasks; sums of those counts are all that is shuffled.
4. Every figure of every order follows from the survivors of subsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.llm.common import join_by_uses, positional_counts, small_batches
from garimpo.llm.registry import query
from garimpo.schema import stage

CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))
#: Most filters: their subsets are the bits of one 32-bit word.
MOST = 5

#: Letter to failure condition, in SQL over the columns of ``facts`` and ``copy``.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "n_marks > 0",
    "E": "copy",
}

FACTS = (
    "doc_id bigint, part string, digest binary, n_words bigint, n_distinct bigint, n_capitals bigint, "
    "n_chars bigint, n_marks bigint"
)


def facts(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id``, part, SHA-256 of the text, and its counts of words, distinct words, ``A-Z``, code points, marks.

    A word is a maximal ``[^\\x20\\x09-\\x0D]+``. A null text counts as empty, a null part as ``''``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words, n = text.split(), len(text)
                rows.append(
                    (
                        hashlib.sha256(text).digest(), len(words), len(set(words)), n - len(text.translate(None, CAPITALS)),
                        len(text.translate(None, CONTINUATION)), n - len(text.translate(None, MARKS)),
                    )
                )
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(columns[0], pa.binary())]
                + [pa.array(c, pa.int64()) for c in columns[1:]],
                names=["doc_id", "part", "digest", "n_words", "n_distinct", "n_capitals", "n_chars", "n_marks"],
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    ).mapInArrow(run, FACTS)


def with_copies(known: DataFrame) -> DataFrame:
    """``known`` (staged facts) with ``copy``: does a smaller ``doc_id`` have the identical text?

    A row without ``doc_id`` is no copy and has none.
    """
    copies = stage(
        known.groupBy("digest").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_id")).where("uses > 1")
    )
    return join_by_uses(known, copies, "digest", known.count()).withColumn(
        "copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    )


def survival_words(filters: int) -> np.ndarray:
    """The word of every set of failed filters: bit S is set if S holds none of them."""
    subsets = np.arange(1 << filters)
    alive = (subsets[:, None] & subsets[None, :]) == 0
    return (alive.astype(np.uint64) << subsets.astype(np.uint64)).sum(1).astype(np.uint32)


def subset_survivors(judged: DataFrame, filters: int) -> DataFrame:
    """``part, label, subset, n``: how many rows pass every filter of each subset.

    ``judged`` has ``part, failed`` (the bits of failed filters), ``good, toxic``. Label 0 counts all
    rows, 1 good ones, 2 toxic ones.
    """
    table, subsets = survival_words(filters), 1 << filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("part").dictionary_encode()
            of = names.indices.to_numpy()
            words = table[batch.column("failed").to_numpy()]
            labels = [np.ones(len(words), bool)] + [
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")
            ]
            keys = [(p, k) for p in range(len(names.dictionary)) for k in range(3)]
            counts = [positional_counts(words[(of == p) & labels[k]])[:subsets] for p, k in keys]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": names.dictionary.take(pa.array(np.repeat([p for p, _ in keys], subsets))),
                    "label": pa.array(np.repeat([k for _, k in keys], subsets), pa.int32()),
                    "subset": pa.array(np.tile(np.arange(subsets), len(keys)), pa.int32()),
                    "n": pa.array(np.concatenate(counts), pa.int64()),
                }
            )

    counted = judged.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, label int, subset int, n bigint")
    return counted.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, part: str = "lang"
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``filters``: up to five letters with their failure conditions in SQL (default ``FILTERS``). Counts within the
    part: ``kept`` after the step, ``removed`` by it, ``redundant`` (fails its filter but was removed
    before), ``unique_fails`` (fails no other filter), ``good_lost`` and ``toxic_lost`` (removed by it
    with ``quality = 1``, ``toxic = 1``), ``shapley`` (removed by its filter, summed over all orders).

    Every row of ``docs`` counts. A document that several rows of ``labels`` name is good or toxic if
    one of them says so; a null label is not 1. A condition that is null counts as passed. An empty
    table has no part and no row; further columns are ignored.
    """
    filters = FILTERS if filters is None else filters
    if not 0 < len(filters) <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    letters = list(filters)
    known = stage(facts(docs, part))
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    failed = sum(
        (F.when(F.expr(condition), 1 << i).otherwise(0) for i, condition in enumerate(filters.values())), F.lit(0)
    )
    judged = with_copies(known).join(flags, "doc_id", "left").select(
        "part", failed.cast("int").alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    survivors = subset_survivors(judged, len(letters))

    def line(label: int) -> Column:  # survivors of all subsets, in order
        of_label = F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("subset", "n"))))
        return F.transform(of_label, lambda x: x["n"])

    parts = survivors.groupBy("part").agg(line(0).alias("every"), line(1).alias("good"), line(2).alias("toxic"))
    steps = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            name = "".join(letters[k] for k in order)
            steps.append((len(steps), name, step, i, before, before | 1 << i))
            before |= 1 << i
    schema = "number int, filter_order string, step int, filter int, before int, after int"
    table = docs.sparkSession.createDataFrame(steps, schema)
    whole = (1 << len(letters)) - 1

    def alive(label: str, subset: Column) -> Column:
        return F.get(label, subset)

    def lost(label: str) -> Column:
        return alive(label, F.col("before")) - alive(label, F.col("after"))

    one = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    rows = (
        parts.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
        .join(F.broadcast(table), "number")  # 600 fixed rows for five filters
        .select(
            "part", "filter_order", "step", "filter", alive("every", F.col("after")).alias("kept"),
            lost("every").alias("removed"),
            (alive("every", F.lit(0)) - alive("every", one) - lost("every")).alias("redundant"),
            (alive("every", whole - one) - alive("every", F.lit(whole))).alias("unique_fails"),
            lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        )
    )
    # a filter has one row per part and order: 120 rows for five filters
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


SQL = """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM texts
),
judged AS (
  SELECT doc_id, part,
         (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS failed
  FROM worded
),
flags AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
classes AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM judged LEFT JOIN flags USING (doc_id) GROUP BY part, failed
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
counted AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE failed = filter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM (
    SELECT *, translate(failed, earlier, '') <> failed AS gone, contains(failed, filter) AS fails FROM classes, steps
  )
  GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM counted
"""


@query("op11_filter_audit", SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
