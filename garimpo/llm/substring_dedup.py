"""Substring dedup over words: seed and extend.

Documents meet on winnowed seeds, matches are extended both ways from the seed, and words covered
by a match of at least ``WINDOW`` words with an earlier document are removed (see ``repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm.common import documents, small_batches, texts_of, word_hashes
from garimpo.llm.registry import query
from garimpo.llm.repeats import Shape, ranges_of, repeated_windows, with_ranges

WINDOW = 50
WORDS = Shape(window=WINDOW, gram=8, part=8, own=False)
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<array<bigint>>, kept_text string"


def word_units(text: pa.Buffer) -> np.ndarray:
    return word_hashes(text.to_pybytes().split())


def without_repeats(docs: DataFrame, shape: Shape = WORDS, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed`` per row; ``with_text`` adds ``kept_text``.

    ``removed`` lists the maximal repeats as pairs of word numbers, end exclusive. A null text
    has no words and the digest of the empty text. Rows that share a ``doc_id`` are one document
    for the search: none of them repeats another. A row without ``doc_id`` takes no part and keeps
    all its words. Further columns are ignored.
    """
    rows = texts_of(docs).withColumn("text", F.col("text").cast("binary"))
    places = repeated_windows(rows.where("doc_id is not null"), word_units, shape)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            total, removed, ranges, digests, texts = [], [], [], [], []
            for text, places_ in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                words = text.split()
                found = [(a, min(b, len(words))) for a, b in ranges_of(places_, shape.window).tolist()]
                kept, at = [], 0
                for a, b in found:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                ranges.append([list(x) for x in found])
                digests.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                    "removed": pa.array(ranges, pa.list_(pa.list_(pa.int64()))), "kept_text": pa.array(texts, pa.string()),
                }
            )

    out = with_ranges(rows, places, "left").select("doc_id", "text", "places").mapInArrow(keep, KEPT)
    return out if with_text else out.drop("kept_text")


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("removed")
