"""What the text operators share: the documents table, bounded Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text table that go to Python in one Arrow batch, so that a batch of long texts fits.
BATCH_ROWS = 1000
#: Entries of an in-task memo before it is emptied; a memo only saves time.
MEMO_ENTRIES = 150_000
#: Longest key that is remembered, so that text without white space cannot fill a memo.
MEMO_KEY = 64
#: ``[^\x20\x09-\x0D]+`` is what ``bytes.split()`` returns.
WHITE = b" \t\n\r\x0b\x0c"
#: Characters besides space, tab and line ends that some tokenizer or ``str.split`` takes for white space.
RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` of the documents table; a null text counts as empty."""
    return texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def texts_of(docs: DataFrame) -> DataFrame:
    """Only ``doc_id, text`` of ``docs``, so that further columns of any name cannot clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
#: A Latin word with ASCII marks behind it (no apostrophe): tokenizers cut it between the two.
WORD_AND_MARKS = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: All memos of this Python worker, which Spark uses for one operator after another.
MEMOS: list[weakref.ref[Memo]] = []
#: Vocabularies, automata and encoders of this worker, by file.
MODELS: list[dict] = []


def models() -> dict:
    """A dictionary of what operators load from files, emptied as the memos are."""
    MODELS.append({})
    return MODELS[-1]


def keep_memos(*kept: dict) -> None:
    """Empty all memos and models but these: called by a task, so that earlier operators leave no memory behind."""
    MEMOS[:] = [ref for ref in MEMOS if ref() is not None]
    held = [memo for ref in MEMOS if (memo := ref()) is not None] + MODELS
    left = [x for x in held if not any(x is k for k in kept) and (x or getattr(x, "old", None))]
    for x in left:
        x.clear()
        if isinstance(x, Memo):
            x.old = {}
    if left:
        del held, left, x
        gc.collect()
        if sys.platform == "linux":
            # the C library keeps freed memory, which counts as the executor's
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    pa.default_memory_pool().release_unused()


class Memo(dict):
    """A dictionary that computes a missing value.

    When it is full, its entries become the old generation, in which a missing value is looked up
    before it is computed: what is used often stays, and memory is bounded.
    """

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}
        MEMOS.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > MEMO_KEY:
            return
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value


#: Word to 64-bit hash; kept by a Python worker from task to task.
WORD_HASH = Memo(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@contextmanager
def wrapping():
    with np.errstate(over="ignore"):
        yield


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (unsigned integers) have each bit set, the lowest bit first.

    Carry-save adders: three words of one weight become their sum bits, of the same weight, and
    their carry bits, of twice the weight, until one word of each weight is left.
    """
    bits = np.arange(8 * words.dtype.itemsize, dtype=words.dtype)
    counts, weight = np.zeros(len(bits), np.int64), 0
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        counts += ((words[0] >> bits) & words.dtype.type(1)).astype(np.int64) << weight
        words = np.concatenate(carries) if carries else words[:0]
        weight += 1
    return counts


#: A key that this share of all rows holds is joined by broadcast: at most its reciprocal of keys.
HOT_SHARE = 1 / 1000


def join_by_uses(rows: DataFrame, dim: DataFrame, key: str, n: int) -> DataFrame:
    """Left join of ``rows`` (``n`` of them) with ``dim``, which has one row per ``key``; drops ``uses``.

    ``uses`` is the number of rows that hold the key, so at most ``1 / HOT_SHARE`` keys can be hot:
    they are sent to all executors, and no other key can fill a task of the shuffle join. Both
    inputs are read twice and should be staged.
    """
    hot = F.broadcast(dim.where(F.col("uses") >= n * HOT_SHARE).drop("uses"))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(
        rest.join(dim.where(F.col("uses") < n * HOT_SHARE).drop("uses"), key, "left")
    )
