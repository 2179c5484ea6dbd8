"""Floors of the languages come from every labelled text."""

import public_tokenizers
from pyspark.sql import functions as F

from garimpo.llm import language


def test_floors_are_measured_on_all_labelled_texts(spark):
    words = ("the house by the river was old", "a garden full of roses and birds", "they walked home in the rain")
    rows = [(i, f"{words[i % 3]} and {words[(i // 3) % 3]}", "en") for i in range(1200)] + [(1200, "xqzj vkwq zzxj qqkv jxzw vvkq", None), (1201, "123", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, public_tokenizers.path("piece_bpe_32k.model"), per_language=40)
    names = ("letters", "best", "fluent")
    judged = language.judged(docs, model, names)
    want = judged.where("lang is not null and letters >= 20").agg(F.count("*"), F.avg("fluent"), F.stddev("fluent")).first()
    assert want[0] == 1200
    got = language.floors(judged, names, 1, 6.0)
    assert abs(got[0] - (want[1] - 6 * max(want[2], language.LEAST_DEVIATION))) < 1e-9
    kept = language.identified(docs, model, 6.0)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(1200))
