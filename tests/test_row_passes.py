"""How often the rows of a table are made: passes read what was written instead."""

import pytest
from pyspark.sql import functions as F

from garimpo.operators import anomaly, charts, clean, quality


def counted(df):
    """``df`` with an accumulator of the rows made from it."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema), made


def operations(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("op_id"),
        F.when(F.col("id") % 3 == 0, "MG").otherwise("PA").alias("ESTADO"), F.lit("FERRO").alias("PRIMEIRODESUBS"),
        (F.col("id") * 7 % 101 + F.when(F.col("id") % 50 == 0, 9000).otherwise(0)).cast("double").alias("CFEM"),
        (F.col("id") * 13 % 40 - 70).cast("double").alias("LONGITUDE"), (F.col("id") * 17 % 30 - 30).cast("double").alias("LATITUDE"),
    )


def test_outliers_make_the_rows_twice(spark):
    rows, made = counted(operations(spark))
    assert clean.flag_outliers(rows).where("CFEM_OUTLIER").count() == 8
    assert made.value <= 800


def test_quality_status_makes_the_rows_once(spark):
    rows = operations(spark).select("ESTADO", "CFEM").withColumn("CFEM_OUTLIER", F.col("CFEM") >= 50)
    rows, made = counted(rows.unionByName(rows.limit(1)))
    assert [tuple(r) for r in quality.quality_status(rows).collect()] == [("Duplicatas Encontradas", "Outliers Detectados")]
    assert made.value <= 401


@pytest.mark.parametrize("flags,want", [([], "Poucos Outliers"), ([None, None], "Poucos Outliers"), ([True, None], "Outliers Detectados")])
def test_quality_status_of_no_rows_and_nulls(spark, flags, want):
    rows = spark.createDataFrame(list(enumerate(flags)), "id long, CFEM_OUTLIER boolean")
    assert [tuple(r) for r in quality.quality_status(rows).collect()] == [("Sem Duplicatas", want)]


def test_anomalies_read_the_scale_once(spark):
    rows, made = counted(operations(spark))
    assert anomaly.summary(anomaly.detect(rows, contamination=0.1, trees=5, sample=32)).first().total_anomalies > 0
    # scale, number of rows, pool (counted and taken), scores
    assert made.value <= 4 * 400


def test_boxes_list_their_categories_once(spark):
    rows, made = counted(operations(spark))
    assert {r.category for r in charts.category_boxes(rows).collect()} == {"MG", "PA", "FERRO"}
    # two lists of categories, cuts, counts, values, ends
    assert made.value <= 6 * 400
