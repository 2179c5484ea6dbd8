"""SimHash near duplicates by pigeonring filtering.

1. A document's fingerprint has a bit set if more than half of the 64-bit hashes of its word
   shingles, repeats included, have it set. Equal fingerprints are folded to one.
2. The 64 bits are cut into ``differ + 1`` segments on a ring. If two fingerprints differ in at most
   ``differ`` bits, then by the pigeonring principle some segment starts a chain whose first 1, 2,
   3, ... segments differ in at most 0, 1, 2, ... bits in all: the budget is proportional to the
   length of the chain.
3. The first two lengths are a key: a fingerprint is at home under each segment and the segment
   behind it, and visits the keys whose second segment has one bit more. So only fingerprints whose
   chain of two is within its budgets ever meet, and a key has 26 bits.
4. Inside a task the chain goes on, segment by segment, over arrays of pairs; the full Hamming
   distance is checked last. Pairs never become rows: a task returns a spanning forest of its links.
5. A key under which more than ``MEETING`` fingerprints meet is not compared where it lies; it is cut
   into blocks, and every two blocks meet in a task of their own.
6. Connected components of the links; the smallest ``doc_id`` names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm.common import documents, join_by_uses, small_batches, texts_of
from garimpo.llm.registry import query
from garimpo.operators.cluster import components
from garimpo.schema import stage

WIDTH, BITS, SEED = 4, 64, 42
#: Bits in which linked fingerprints may differ.
DIFFER = 4
#: Shingles hashed, and pairs compared, at a time.
SLICE, PAIRS = 16_384, 1 << 20
#: Fingerprints of one key that one task compares.
MEETING = 8_192


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash of a UTF-8 text, A-Z lower-cased; 0 without words.

    A bit is set if it is set in over half of the XXH64 hashes of the shingles of ``width`` words,
    joined by one space; with fewer words the whole sequence is one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    take = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - take + 1].tolist()
    ends = ends[take - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for s in range(0, len(starts), SLICE):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[s : s + SLICE], ends[s : s + SLICE])], np.dtype("<u8")
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, print`` (the fingerprint as a signed integer) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            prints = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "print": pa.array(prints.view(np.int64))})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, print bigint"
    )


class Ring:
    """The segments of a fingerprint and the keys of its chains."""

    def __init__(self, differ: int):
        # three segments at least, so that the key of two and the chain's start fit in 64 bits
        self.differ, self.segments = differ, max(differ, 2) + 1
        self.edges = [round(BITS * i / self.segments) for i in range(self.segments + 1)]
        self.width = max(b - a for a, b in zip(self.edges, self.edges[1:]))

    def segment(self, prints: np.ndarray, i: int) -> np.ndarray:
        low, high = self.edges[i % self.segments], self.edges[i % self.segments + 1]
        return (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)

    def mask(self, i: int, length: int) -> int:
        """Bits of the chain of ``length`` segments from segment ``i``."""
        total = 0
        for k in range(i, i + length):
            low, high = self.edges[k % self.segments], self.edges[k % self.segments + 1]
            total |= (1 << high) - (1 << low)
        return total

    def keys(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """``(prints, keys, visiting)`` of each way in which fingerprints take part."""
        width = np.uint64(self.width)
        for i in range(self.segments):
            first = (np.uint64(i) << width | self.segment(prints, i)) << width
            second = self.segment(prints, i + 1)
            yield prints, first | second, False
            k = (i + 1) % self.segments
            for b in range(self.edges[k + 1] - self.edges[k]):
                bit = np.uint64(1 << b)
                without = (second & bit) == 0  # of two that differ in this bit one visits the other
                yield prints[without], first[without] | second[without] | bit, True

    def starts(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(2 * self.width)).astype(np.int64)


class Forest:
    """Union-find over numbered members that only accepts links which join two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        found, at, step = [], 0, 1024
        while at < len(a):
            x, y = a[at : at + step], b[at : at + step]
            at, step = at + step, 2 * step
            self.flatten()
            new = self.parent[x] != self.parent[y]
            for i, j in zip(x[new].tolist(), y[new].tolist()):
                p, q = self.top(i), self.top(j)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    found.append((i, j))
        return found

    def top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def flatten(self) -> None:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return
            self.parent = above


def chained_links(ring: Ring, key: np.ndarray, visiting: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
    """Positions of linked members, as a spanning forest of the links.

    Members are sorted by key, those at home first; whole keys only. A member is compared with the
    members at home before it: the chain of two holds for them by the key.
    """
    n = len(key)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group = np.cumsum(first) - 1
    homes = np.bincount(group, ~visiting).astype(np.int64)[group]
    partners = np.where(visiting, homes, np.arange(n) - start)
    masks = np.array(
        [[ring.mask(i, length) for length in range(3, ring.segments + 1)] for i in range(ring.segments)], np.uint64
    ).reshape(ring.segments, -1)
    forest, found = Forest(n), []
    members = np.nonzero(partners)[0]
    ends = np.cumsum(partners[members])
    at = 0
    while at < len(members):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        rows = members[at:stop]
        count = partners[rows]
        b = np.repeat(rows, count)
        a = np.repeat(start[rows], count) + np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
        apart = prints[a] ^ prints[b]
        chain = ring.starts(key[b])
        for length in range(3, ring.segments + 1):  # the last is the whole ring: the Hamming check
            near = np.bitwise_count(apart & masks[chain, length - 3]) <= min(length - 1, ring.differ)
            a, b, apart, chain = a[near], b[near], apart[near], chain[near]
        found += forest.add(a, b)
        at = stop
    return found


MEMBERS = "key bigint, visiting boolean, print bigint"
#: Links have ``u, v``; members of a crowded key, which are compared later, have ``u, key, visiting``.
MET = "u bigint, v bigint, key bigint, visiting boolean"


def _met(u: np.ndarray, v: np.ndarray | None, key: np.ndarray | None, visiting: np.ndarray | None) -> pa.RecordBatch:
    n = len(u)
    return pa.RecordBatch.from_pydict(
        {
            "u": pa.array(u, pa.int64()), "v": pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()),
            "key": pa.nulls(n, pa.int64()) if key is None else pa.array(key, pa.int64()),
            "visiting": pa.nulls(n, pa.bool_()) if visiting is None else pa.array(visiting, pa.bool_()),
        }
    )


def _compare(ring: Ring, batches: Iterator[pa.RecordBatch], keys: list[str], largest: int | None) -> Iterator[pa.RecordBatch]:
    """Links of the keys of a sorted partition; a key with more than ``largest`` members is handed on."""
    held: list[np.ndarray] = []
    crowded = None

    def closed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        *key, visiting, prints = rows
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        sizes = np.diff(np.append(np.nonzero(new)[0], len(prints)))
        company = np.repeat(sizes > 1, sizes)
        if company.any():
            # the start of the chain, and a number instead of the rest of the key
            start = key[0].view(np.uint64) >> np.uint64(2 * ring.width) << np.uint64(2 * ring.width)
            numbered = start | np.cumsum(new).astype(np.uint64)
            of = prints[company]
            links = chained_links(ring, numbered[company], visiting[company], of.view(np.uint64))
            if links:
                yield _met(of[[i for i, _ in links]], of[[j for _, j in links]], None, None)

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "visiting", "print")]
        if crowded is not None and batch.num_rows:
            again = np.logical_and.reduce([k == c for k, c in zip(rows, crowded)])
            if again.any():
                yield _met(rows[-1][again], None, rows[0][again], rows[-2][again])
            rows = [r[~again] for r in rows]
        if not len(rows[0]):
            continue
        crowded = None
        if held:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        last = np.logical_and.reduce([k == k[-1] for k in rows[: len(keys)]])
        open_from = len(last) - int(last.sum())  # sorted: the open key is at the end
        if open_from:
            yield from closed([r[:open_from] for r in rows])
        held = [r[open_from:] for r in rows]
        if largest is not None and len(held[0]) > largest:
            yield _met(held[-1], None, held[0], held[-2])
            crowded, held = [k[0] for k in held[: len(keys)]], []
    if held:
        yield from closed(held)


def links_of(prints: DataFrame, differ: int = DIFFER) -> DataFrame:
    """``u, v``: links that connect those of the distinct ``print`` that differ in at most ``differ`` bits."""
    ring = Ring(differ)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, keys, visiting in ring.keys(batch.column("print").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(keys.view(np.int64)), "visiting": pa.array(np.full(len(keys), visiting)),
                        "print": pa.array(owners.view(np.int64)),
                    }
                )

    met = stage(
        prints.select("print").mapInArrow(members, MEMBERS).repartition(parts, "key")
        .sortWithinPartitions("key", "visiting", "print")
        .mapInArrow(lambda batches: _compare(ring, batches, ["key"], MEETING), MET)
    )
    links = met.where("key is null").select("u", "v")
    crowd = met.where("key is not null").select("key", "visiting", F.col("u").alias("print"))
    if crowd.isEmpty():
        return links
    blocks = crowd.groupBy("key").agg(F.ceil(F.count("*") / MEETING * 2).cast("int").alias("blocks"))
    facing = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("facing")
    meeting = (
        # a crowded key has thousands of rows, so its one row here is small beside them
        crowd.join(F.broadcast(blocks) if blocks.limit(100_001).count() <= 100_000 else blocks, "key")
        .withColumn("block", F.pmod(F.xxhash64("print"), "blocks").cast("int"))
        .select("key", "visiting", "print", "block", facing)
        .select("key", F.least("block", "facing").alias("i"), F.greatest("block", "facing").alias("j"), "visiting", "print")
    )
    more = (
        meeting.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "visiting", "print")
        .mapInArrow(lambda batches: _compare(ring, batches, ["key", "i", "j"], None), MET)
    )
    return links.unionByName(stage(more).select("u", "v"))


def near_groups(docs: DataFrame, width: int = WIDTH, differ: int = DIFFER) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Documents whose fingerprints differ in at most ``differ`` bits are linked; ``component_id`` is the
    smallest ``doc_id`` that can be reached. A null or empty text, or one without words, has the
    fingerprint zero and is linked like any other. Repeated rows get equal answers; where rows of one
    id differ in text, each has the component of its own fingerprint. A row without ``doc_id`` has a
    fingerprint, but links nothing and has no component. An empty table gives an empty result;
    further columns are ignored.
    """
    rows = stage(fingerprints(texts_of(docs), width))
    folded = stage(
        rows.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("low"), F.count("*").alias("uses"))
    )
    links = links_of(folded, differ)
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    linked = stage(
        components(nodes, links).withColumnRenamed("node", "print").join(folded.select("print", "low"), "print")
    )
    lowest = stage(linked.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("uses")))
    reached = join_by_uses(linked.select("print", "root"), lowest, "root", linked.count()).select("print", "component_id")
    names = stage(
        folded.join(reached, "print", "left").select("print", "uses", F.coalesce("component_id", "low").alias("component_id"))
    )
    return join_by_uses(rows, names, "print", rows.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


@query("op12_simhash_dedup")
def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
