"""Dedup of repeated byte strings across a corpus.

Every byte covered by a ``WINDOW``-byte string that starts earlier, in a document with a smaller id
or before in the same document, is removed. The search works on sampled suffixes chosen by content
(see ``repeats``); why it does not sort all suffixes by a difference cover is told in the README.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm.common import documents, small_batches, texts_of
from garimpo.llm.registry import query
from garimpo.llm.repeats import Shape, ranges_of, repeated_windows, with_ranges

WINDOW = 100
BYTES = Shape(window=WINDOW, gram=20, part=9, own=True)
KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<array<bigint>>, kept binary"


def byte_units(text: pa.Buffer) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def without_repeats(docs: DataFrame, shape: Shape = BYTES, with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` per row; ``with_bytes`` adds ``kept``.

    ``removed`` lists the maximal removed runs as pairs of byte offsets, end exclusive; ``kept`` may
    cut a character. A null or empty text has no bytes. Rows that share a ``doc_id`` count as one
    document whose rows all start at 0: equal rows do not repeat each other. A row without
    ``doc_id`` takes no part and keeps all its bytes. Further columns are ignored.
    """
    rows = texts_of(docs).withColumn("text", F.col("text").cast("binary"))
    places = repeated_windows(rows.where("doc_id is not null"), byte_units, shape)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            total, removed, spans, digests, ranges, kept_ = [], [], [], [], [], []
            for text, places_ in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                found = [(a, min(b, len(text))) for a, b in ranges_of(places_, shape.window).tolist() if a < len(text)]
                parts, at = [], 0
                for a, b in found:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept = b"".join(parts)
                total.append(len(text))
                removed.append(len(text) - len(kept))
                spans.append(len(found))
                digests.append(hashlib.sha256(kept).hexdigest())
                ranges.append([list(x) for x in found])
                kept_.append(kept if with_bytes else None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_bytes": pa.array(total, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array(digests, pa.string()),
                    "removed": pa.array(ranges, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept_, pa.binary()),
                }
            )

    out = with_ranges(rows, places, "left").select("doc_id", "text", "places").mapInArrow(keep, KEPT)
    return out if with_bytes else out.drop("kept")


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("removed")
