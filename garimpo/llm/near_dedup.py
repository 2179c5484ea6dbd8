"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the ``k`` smallest.

1. Equal sets are folded to one representative.
2. Inverted lists of the retained values give overlaps. Two linked documents share at least
   ``needed`` retained values, so it is enough to list, for each document, the first
   ``k - needed + 1`` of them in the order rarest first: values that many documents share come last
   and fall out unless a document consists of little else. Values of one document are never listed.
3. Every list goes to its smallest member, the pivot, so that documents which share many lists meet
   once. A pivot's documents are cut into blocks of bounded size, and pairs of blocks are compared
   inside tasks: overlap of sketches, then the Jaccard estimate on the sketch of the union, then the
   exact Jaccard index on full sets, unless both are connected already. Only the links of a
   spanning forest become rows; pairs never do.
4. Connected components of the links; the smallest ``doc_id`` names a component.

Sets of at most ``FULL`` shingles are compared without any chance. For larger ones a link is lost
only if two sketches of 64 values with an expected overlap of 48 or more share fewer than 28, or the
estimate is below 0.42 where 0.75 is expected. By the binomial distribution that is 2.5e-8 for the
overlap and less for the estimate, for a pair at the threshold; likelier for none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm.common import WORD_HASH, documents, keep_memos, mixed, small_batches, texts_of, word_hashes, wrapping
from garimpo.llm.registry import query
from garimpo.operators.cluster import components
from garimpo.schema import sized_broadcast, stage

WIDTH = 5
SKETCH = 64
#: Similarity in hundredths.
LEAST = 75
#: Largest set whose linked sets all fit in a sketch, and retained values shared by larger ones.
FULL, SHARED = SKETCH * LEAST // 100, 28
ESTIMATE = 0.42
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Candidate representatives whose ids may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lower-cased.

    With fewer words than ``width`` the whole sequence is one shingle; without words none.
    """
    words = word_hashes(text.lower().split())
    n = len(words)
    if not n:
        return words
    with wrapping():
        take = min(width, n)
        total = np.full(n - take + 1, np.uint64(take))
        for i in range(take):
            total = total * BASE + words[i : n - take + 1 + i]
        return np.unique(mixed(total))


SKETCHES = "doc_id bigint, n_shingles bigint, fold binary, sketch array<bigint>"


def sketches(docs: DataFrame, width: int = WIDTH, size: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, fold, sketch``: set size, digest of the whole set, smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memos(WORD_HASH)
        for batch in small_batches(batches):
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "fold": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "sketch": pa.array([s[:size].view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SKETCHES)


def _estimates(sketch: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs from the bottom-k sketch of their union.

    ``sketch`` has a row per document, filled up with the largest number; a full set is a sketch
    of any length, so the estimate of two small sets is exact.
    """
    k = sketch.shape[1]
    both = np.sort(np.concatenate([sketch[a], sketch[b]], axis=1), axis=1)
    filler = both == np.iinfo(np.uint64).max
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & ~filler[:, 1:]
    rank = np.cumsum(~again & ~filler, axis=1)  # distinct values so far
    full = (size[a] <= k) & (size[b] <= k)
    limit = np.where(full, rank[:, -1], np.minimum(rank[:, -1], k))[:, None]
    shared = (again & (rank <= limit)).sum(1)
    return shared / np.maximum(limit[:, 0], 1)


def _linked(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < least * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = int(np.count_nonzero(y[at] == x))
    return 100 * shared >= least * (len(x) + len(y) - shared)


def _links(ids: list[int], sets: list[np.ndarray], side: list[bool], other: list[bool], least: int, k: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of two blocks (or within one)."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    sketch = np.full((n, k), np.iinfo(np.uint64).max)
    for i, s in enumerate(sets):
        sketch[i, : min(k, len(s))] = s[:k]
    # overlaps of sketches by products of slices of the value-by-document matrix
    values, column = np.unique(sketch, return_inverse=True)
    column = column.reshape(n, k)
    uses = np.bincount(column.ravel(), minlength=len(values))
    if len(values) and values[-1] == np.iinfo(np.uint64).max:
        uses[-1] = 0
    number = np.cumsum(uses > 1) - 1
    row, at = np.nonzero(uses[column] > 1)
    column = number[column[row, at]]
    overlap = np.zeros((n, n), np.float32)
    for start in range(0, int((uses > 1).sum()), 4096):
        inside = (column >= start) & (column < start + 4096)
        part = np.zeros((n, 4096), np.float32)
        part[row[inside], column[inside] - start] = 1
        overlap += part @ part.T
    needed = np.where(size <= FULL, -(-least * size // 100), SHARED)
    enough = overlap >= np.maximum.outer(np.minimum(needed, SHARED), np.minimum(needed, SHARED))
    side, other = np.array(side), np.array(other)
    enough &= np.outer(side, other) | np.outer(other, side)
    a, b = np.nonzero(np.triu(enough, 1))
    estimate = np.concatenate(
        [_estimates(sketch, size, a[s : s + 8192], b[s : s + 8192]) for s in range(0, len(a), 8192)] or [np.zeros(0)]
    )
    order = np.argsort(-estimate, kind="stable")
    order = order[estimate[order] >= ESTIMATE]
    parent = list(range(n))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = top(i), top(j)
        if x != y and _linked(sets[i], sets[j], least):
            parent[x] = y
            found.append((ids[i], ids[j]))
    return found


def near_groups(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents with ``100 * intersection >= least * union`` of their shingle sets are linked.
    A null or empty text, or one without words, has an empty set and is linked with nothing.
    Equal rows get equal answers; ``doc_id`` names a text: where rows of one id differ in text, each
    keeps its own set, and the links of one of them count for that id. A row without ``doc_id`` has no component. Further
    columns are ignored.
    """
    rows = texts_of(docs)
    sketched = stage(sketches(rows, width))
    folded = stage(
        sketched.where("doc_id is not null and n_shingles > 0").groupBy("fold").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")
        )
    )
    # retained values that occur in two sets at least, rarest first
    posted = folded.select("rep", F.explode("sketch").alias("value"))
    shared = posted.groupBy("value").agg(F.count("*").alias("uses")).where("uses > 1")
    held = F.least(F.col("n"), F.lit(SKETCH))
    needed = F.when(F.col("n") <= FULL, F.ceil(F.col("n") * least / 100)).otherwise(SHARED)
    known = folded.select("rep", "fold", "n")
    lists = posted.join(shared, "value").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("uses", "value"))).alias("values")  # at most SKETCH of them
    ).join(known, "rep").withColumn("take", held - needed + 1 - (held - F.size("values"))).where("take > 0")
    first = stage(
        lists.select("fold", "rep", "n", F.explode(F.expr("slice(values, 1, cast(take as int))")).alias("v"))
        .select("fold", "rep", "n", F.col("v.value").alias("value"))
    )
    pivots = first.groupBy("value").agg(F.min("rep").alias("pivot"), F.count("*").alias("uses")).where("uses > 1")
    members = stage(first.join(pivots, "value").select("pivot", "fold", "rep", "n").distinct())
    blocks = members.groupBy("pivot").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = stage(
        members.join(blocks, "pivot").select(
            "rep", "fold", "pivot", "blocks", F.pmod(F.xxhash64("fold"), "blocks").cast("int").alias("block")
        )
    )
    wanted = sized_broadcast(placed.select(F.col("rep").alias("doc_id")).distinct(), BROADCAST_IDS)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": batch.column("doc_id"), "fold": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "members": pa.array([s.tobytes() for s in sets], pa.binary()),
                }
            )

    sets = rows.join(wanted, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        full, "rep bigint, fold binary, members binary"
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("facing")
    meeting = (
        sets.join(placed, ["rep", "fold"])
        .select("pivot", "rep", "members", "block", every)
        .select("pivot", F.least("block", "facing").alias("i"), F.greatest("block", "facing").alias("j"), "rep", "block", "members")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets_, blocks_ = None, [], [], []

        def close() -> pa.RecordBatch:
            found = []
            if len(ids) > 1:
                i, j = key[1], key[2]
                found = _links(ids, sets_, [b == i for b in blocks_], [b == j for b in blocks_], least, SKETCH)
            return pa.RecordBatch.from_pydict(
                {"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())}
            )

        for batch in batches:
            columns = (batch.column(c) for c in ("pivot", "i", "j", "rep", "block", "members"))
            for pivot, i, j, rep, block, members_ in zip(*(c.to_pylist() for c in columns)):
                if (pivot, i, j) != key:
                    if len(ids) > 1:
                        yield close()
                    key, ids, sets_, blocks_ = (pivot, i, j), [], [], []
                if ids and ids[-1] == rep:  # repeated rows
                    continue
                ids.append(rep)
                sets_.append(np.frombuffer(members_, np.uint64))
                blocks_.append(block)
        if len(ids) > 1:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = meeting.repartition(parts, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "rep").mapInArrow(
        compare, "u bigint, v bigint"
    )
    links = stage(links)
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    roots = stage(components(nodes, links).where("node != root"))
    names = folded.select("fold", "rep").join(sized_broadcast(roots.withColumnRenamed("node", "rep")), "rep", "left").select(
        "fold", F.coalesce("root", "rep").alias("root")
    )
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return (
        sketched.select("doc_id", "n_shingles", "fold").join(names, "fold", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
