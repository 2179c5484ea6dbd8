"""Packing of tokenised documents into fixed windows: concatenate and cut.

First pass: every partition tokenises its documents and writes the ids with running offsets.
Partition totals are summed up to global offsets (two-level prefix sums, one row per partition).
Second pass: a document at a known global offset is cut at the borders of fixed windows; a
boundary record tells which piece of which document lies where. Only the last window is padded.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.llm.bpe import byte_letters
from garimpo.llm.common import MEMO_ENTRIES, RARE_SPACE, WORD_AND_MARKS, Memo, documents, keep_memos, models, small_batches, texts_of
from garimpo.llm.registry import query
from garimpo.schema import stage

WINDOW = 2048
END_ID = 1
#: White space at which every tokenizer of the kind used here starts anew.
CUT = re.compile(r"[ \t\n\r]+")
#: Texts with special tokens are encoded whole by the library.
SPECIAL = "<|"


class Encoder:
    """The library's tokenizer at a path, with a memo from a white-space chunk to id bytes.

    The tokenizer drops white space and never looks across it, so the ids of a text are those of
    its chunks one after another; those of a word with marks behind it are the word's and the marks'.
    """

    def __init__(self, path: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.marks = Memo(self.piece, memo)
        self.chunks = Memo(self.chunk, memo)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a word or of marks that the pre-tokenizer leaves whole: only the merges are left to do."""
        if not text.isascii():  # visible ASCII stands for itself
            text = "".join([self.letters[b] for b in text.encode()])
        ids = [token.id for token in self.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, text: str) -> bytes:
        if text.isascii() and text.isalpha() and text.islower():
            return self.piece(text)
        if m := WORD_AND_MARKS.fullmatch(text):
            word, marks = m.groups()
            lower = word.lower()
            # a word is remembered once, with or without marks behind it
            ids = self.piece(lower) if lower == text else self.chunks[lower]
            return ids + self.marks[marks] if marks else ids
        return self.encode(text)

    def __call__(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if SPECIAL in text:
            return self.encode(text)
        chunks = CUT.split(text) if RARE_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


ENCODERS: dict[tuple[str, int], Encoder] = models()


def encoder(path: str, memo: int = 2 * MEMO_ENTRIES) -> Encoder:
    """One encoder for each path, kept by a Python worker from task to task; ``memo`` bounds its entries."""
    if (path, memo) not in ENCODERS:
        ENCODERS[path, memo] = Encoder(path, memo)
    return ENCODERS[path, memo]


TOKENS = "doc_id bigint, part int, start bigint, doc_tokens bigint, ids binary"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = END_ID, memo: int = 2 * MEMO_ENTRIES) -> DataFrame:
    """``doc_id, part, start, doc_tokens, ids``: start is the offset within partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        end, encode = np.array([end_id], "<u4").tobytes(), encoder(tokenizer, memo)
        keep_memos(encode.marks, encode.chunks, ENCODERS)
        for batch in small_batches(batches):
            ids = [encode(text) + end for text in batch.column("text").to_pylist()]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            # ids below 65,536 are kept in two bytes; a marker byte tells which form follows
            packed = [
                b"\2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 65536 else b"\4" + x
                for x in ids for a in (np.frombuffer(x, "<u4"),)
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "part": pa.array([part] * len(ids), pa.int32()),
                    "start": pa.array(starts), "doc_tokens": pa.array(sizes),
                    "ids": pa.array(packed, pa.binary()),
                }
            )

    return docs.mapInArrow(run, TOKENS)


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
    memo: int = 2 * MEMO_ENTRIES,
) -> DataFrame:
    """Boundary records, one per piece of a document; ``with_ids`` adds the piece's ids.

    Documents follow one another in the order of the table's partitions. A null or empty text is
    one end id. Repeated rows are packed as often as they occur. An empty table has no pieces.
    Sequences are ``window`` ids long but for the last; a null ``doc_id`` stays null. ``memo`` bounds
    the entries of a worker's memos, which save time only.
    """
    tokens = stage(tokenise(texts_of(docs), tokenizer, end_id, memo))
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    # one row per partition of the input; blocks of 1,000 partitions, then the blocks
    block = F.floor(F.col("part") / 1000)
    blocks = totals.groupBy(block.alias("block")).agg(F.sum("tokens").alias("block_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_base", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    bases = totals.withColumn("block", block).join(F.broadcast(blocks), "block").select(
        "part", (F.col("block_base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memos()  # the tokenizer has done its work
        for batch in small_batches(batches):
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, at, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "ids"))):
                ids = np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4")
                raw, n, start = ids.tobytes(), len(ids), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = raw[4 * start : 4 * (start + length)]
                    for column, value in zip(
                        rows, (doc_id, start, length, zlib.crc32(piece), n, sequence, offset, ids[start : start + length])
                    ):
                        column.append(value)
                    start += length
            arrays = [pa.array(c, pa.int64()) for c in rows[:7]]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                arrays.append(pa.array(rows[7], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    placed = tokens.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("at"), "ids"
    )
    return placed.mapInArrow(cut, PIECES + (", ids array<bigint>" if with_ids else ""))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
