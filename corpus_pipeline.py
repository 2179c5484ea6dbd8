"""Corpus pipeline: language ID, exact dedup, near dedup, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import common, exact_dedup, language, near_dedup, packing, pii
from garimpo.schema import shared_folder, sized_broadcast, stage

#: A text this many standard deviations less fluent than its language's labelled texts is in none.
DEVIATIONS = 6.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a text or a letter, and those unlike every learned language."""
    import public_tokenizers

    model = language.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # without a labelled document no language can be learned, and none can be rejected
    return language.identified(docs, model, DEVIATIONS) if model.languages else docs


def without(docs: DataFrame, dropped: DataFrame, key: list[Column]) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in none of ``dropped`` (of as many columns, nulls compared too)."""
    # few keys are sent to all executors, else both sides are shuffled; texts stay in place
    keys = sized_broadcast(dropped, near_dedup.BROADCAST_IDS)
    names = [f"dropped_{i}_{uuid4().hex}" for i in range(len(key))]
    same = [k.eqNullSafe(F.col(name)) for k, name in zip(key, names)]
    return docs.join(keys.toDF(*names), reduce(and_, same), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, and of identical rows one.

    A verdict holds for an id and a text, so another text under the same id stays.
    """
    verdict = exact_dedup.exact_groups(docs, keep="smallest").where("group_size > 1")
    judged = stage(verdict.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("rows")))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    key = [F.col("doc_id"), digest]
    left = without(docs, judged.where(~F.col("kept")).select("doc_id", "text_sha256"), key)
    # rows that share id and text: few, and only they are shuffled whole
    again = judged.where("kept and rows > 1").select("text_sha256")
    if again.isEmpty():
        return left
    name = f"digest_{uuid4().hex}"
    twice = left.withColumn(name, digest).join(
        sized_broadcast(again.withColumnRenamed("text_sha256", name)), name, "left_semi"
    )
    once = twice.dropDuplicates(["doc_id", name]).drop(name)
    return without(left, again, [digest]).unionByName(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows that share an id take part under a number of their own, made of id and text, so that no
    text goes with another of the same id. Rows without an id stay.
    """
    same, own = f"same_{uuid4().hex}", f"own_{uuid4().hex}"
    shared = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(same)).count().where("count > 1")
    shared = sized_broadcast(shared.drop("count"))
    number = F.when(F.col(same).isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text"))
    numbered = docs.join(shared, docs["doc_id"] == F.col(same), "left").withColumn(own, number).drop(same)
    verdict = near_dedup.near_groups(numbered.select(F.col(own).alias("doc_id"), "text"))
    dropped = verdict.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return without(numbered, dropped, [F.col(own)]).drop(own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; ``n_chars`` follows the text."""
    cleaned = pii.redact(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return cleaned


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2,048 ids: one row per piece of a document, with its ids."""
    import public_tokenizers

    # an eighth of the usual memo: workers that served the stages before have less memory left
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, memo=common.MEMO_ENTRIES // 4)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near),
    ("personal_data", personal_data), ("packing", pack),
]

#: Language ID, near dedup and packing are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
