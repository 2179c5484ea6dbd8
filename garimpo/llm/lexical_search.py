"""Ranked lexical search by a dual-tree over items and documents.

1. One pass over whole texts leaves of each document its number of terms and the frequencies of the
   terms that some item has. Sums over these vectors give the corpus statistics and term weights.
2. Items form a tree, cut where a heavy term halves them; documents form a tree within each slice of
   a task, cut at the term whose impact varies most. A node of either tree holds the largest value of
   each coordinate below it: term weights for items, term impacts for documents.
3. The sum over a node's terms of weight times impact is a bound on the score of every pair below a
   node pair. Where it is below the weakest k-th score of the items, the whole batch of pairs is cut
   off, which cannot change a result; else both trees are descended, and leaves are scored exactly.
4. A bounded sample of documents is searched first: its k-th scores are lower bounds to start from.
   They save work only.

Items go to tasks in blocks of about ``BLOCK_TERMS`` terms, one block after the other, so what is
broadcast and held does not grow with the number of items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.llm.common import small_batches
from garimpo.llm.registry import query
from garimpo.schema import lowest_hashes, stage

#: Results of an item.
TOP = 10
#: Fixed values of the score: impact is 10**9 * tf / (1000 * tf + 8 * m), m = 10 + 90 * n * N / L.
SCALE, SATURATION, LENGTH, FLOOR, SLOPE = 10**9, 1000, 8, 10, 90
#: Terms of a block of items, items of a leaf, documents of a leaf, children of a document node.
BLOCK_TERMS, LEAF_ITEMS, LEAF_DOCS, FAN = 200_000, 4, 4, 4
#: Bytes of the impacts of a slice, and documents in it.
SLICE_BYTES, SLICE_DOCS = 32 << 20, 1024
#: Terms along which documents are split; documents searched first.
SPLIT_TERMS, SAMPLE = 192, 4096

# terms are runs of bytes other than these: every ASCII character but digits and letters
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters of a UTF-8 text, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


@dataclass
class Items:
    """A node of the item tree: the items ``low`` to ``high`` and their terms with the largest weights."""

    low: int
    high: int
    terms: np.ndarray
    weights: np.ndarray
    children: list[Items] = field(default_factory=list)
    #: Weights by item and term, in a leaf.
    table: np.ndarray | None = None


def item_tree(items: list[np.ndarray], weights: np.ndarray) -> tuple[Items, list[int]]:
    """The tree, and which item stands at each place of it. ``items`` has the term numbers of each item."""
    order: list[int] = []

    def grow(members: list[int]) -> Items:
        low = len(order)
        terms, uses = np.unique(np.concatenate([items[i] for i in members]), return_counts=True)
        share = uses / len(members)
        spread = weights[terms].astype(float) ** 2 * share * (1 - share)
        if len(members) <= LEAF_ITEMS or not spread.any():
            order.extend(members)
            table = np.array([np.isin(terms, items[i]) for i in members]) * weights[terms]
            return Items(low, len(order), terms, weights[terms], [], table)
        cut = terms[np.argmax(spread)]
        members = sorted(members, key=lambda i: (cut not in items[i], i))
        half = len(members) // 2
        children = [grow(members[:half]), grow(members[half:])]
        return Items(low, len(order), terms, weights[terms], children)

    return grow(list(range(len(items)))), order


def document_order(impacts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Documents (columns) in an order in which neighbours share terms: halves along the widest term."""
    heavy = np.argsort(-(impacts.var(1) * weights.astype(float) ** 2), kind="stable")[:SPLIT_TERMS]
    sub = impacts[heavy] * weights[heavy][:, None].astype(float)

    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= LEAF_DOCS:
            return [at]
        widest = sub[np.argmax(sub[:, at].var(1))]
        at = at[np.argsort(-widest[at], kind="stable")]
        # halves of whole leaves, so that leaves are filled
        half = LEAF_DOCS * -(-len(at) // (2 * LEAF_DOCS))
        return halves(at[:half]) + halves(at[half:])

    return np.concatenate(halves(np.arange(impacts.shape[1])))


class Search:
    """The best documents so far of all items of a block, within a task."""

    def __init__(self, root: Items, weights: np.ndarray, k: int, weakest: np.ndarray):
        n = root.high
        self.root, self.weights, self.k = root, weights, k
        self.scores, self.ids = np.zeros((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).max)
        #: Scores below these cannot be among the best.
        self.weakest = np.maximum(weakest, 1)
        self.scored = 0

    def add(self, impacts: np.ndarray, ids: np.ndarray) -> None:
        """Search documents whose impacts are the columns of ``impacts``."""
        order = document_order(impacts, self.weights)
        self.ids_here = ids[order]
        self.levels = [impacts[:, order]]
        # coordinate maxima of the leaves, of FAN leaves, of FAN * FAN ..., up to one node
        for fan in self._fans(len(ids)):
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], fan), axis=1))
        top = len(self.levels) - 1
        self._visit(self.root, top, np.arange(self.levels[top].shape[1]))

    @staticmethod
    def _fans(n: int) -> list[int]:
        fans, n = [LEAF_DOCS], -(-n // LEAF_DOCS)
        while n > 1:
            fans.append(FAN)
            n = -(-n // FAN)
        return fans

    def _visit(self, node: Items, level: int, docs: np.ndarray) -> None:
        bound = node.weights @ self.levels[level][node.terms[:, None], docs]
        docs = docs[bound >= self.weakest[node.low : node.high].min()]
        if not len(docs):
            return
        if level:
            fan = LEAF_DOCS if level == 1 else FAN
            docs = (docs[:, None] * fan + np.arange(fan)).ravel()
            docs = docs[docs < self.levels[level - 1].shape[1]]
            level -= 1
        elif not node.children:
            self._score(node, docs)
            return
        for child in node.children or [node]:
            self._visit(child, level, docs)

    def _score(self, leaf: Items, docs: np.ndarray) -> None:
        scores = leaf.table @ self.levels[0][leaf.terms[:, None], docs]
        self.scored += scores.size
        for place, row in enumerate(scores, leaf.low):
            good = row >= self.weakest[place]
            if good.any():
                values = np.concatenate([self.scores[place], row[good].astype(np.int64)])
                ids = np.concatenate([self.ids[place], self.ids_here[docs[good]]])
                best = np.lexsort((ids, -values))[: self.k]
                self.scores[place], self.ids[place] = values[best], ids[best]
                self.weakest[place] = max(self.weakest[place], self.scores[place, -1])


VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts``: number of terms, and frequencies of those in the vocabulary by number."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                known = np.array([i for i in map(number.get, words) if i is not None], np.int32)
                distinct, uses = np.unique(known, return_counts=True)
                n.append(len(words))
                terms.append(distinct)
                counts.append(uses)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()),
                    "terms": pa.array(terms, pa.list_(pa.int32())), "counts": pa.array(counts, pa.list_(pa.int64())),
                }
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    ).mapInArrow(run, VECTORS)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``item_id, term`` of the items; a null text has no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, texts = batch.column("item_id").to_pylist(), batch.column("text").to_pylist()
            pairs = [(i, t) for i, text in zip(ids, texts) for t in sorted(set(terms_of(text)))]
            yield pa.RecordBatch.from_pydict(
                {"item_id": pa.array([i for i, _ in pairs], pa.int64()), "term": pa.array([t for _, t in pairs], pa.binary())}
            )

    return items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(run, "item_id bigint, term binary").distinct()


def best(found: DataFrame, k: int) -> DataFrame:
    """``item, rank, doc_id, score``: the best ``k`` rows of every item, first within shares of its rows."""
    line = [F.col("score").desc(), F.col("doc_id")]
    shared = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = shared.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*line)))
    ranked = first.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*line)))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search_block(docs: DataFrame, block: list[tuple[int, bytes]], k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` for the items of ``block``, which has their distinct terms."""
    spark = docs.sparkSession
    names = sorted({i for i, _ in block})
    vocabulary = sorted({t for _, t in block})
    number = {t: j for j, t in enumerate(vocabulary)}
    known = stage(vectors(docs, vocabulary))
    corpus = known.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = int(corpus[0]), int(corpus[1])
    uses = dict(known.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row a term
    # a term that no document holds adds nothing to any score
    whole = np.array(
        [
            math.floor(1000 * math.log((2 * documents + 2) / (2 * uses[j] + 1))) if j in uses else 0
            for j in range(len(vocabulary))
        ],
        np.int64,
    )
    # sums of products are exact in doubles below 2 ** 53; an impact is below SCALE / SATURATION
    exact = float(whole.sum()) * SCALE / SATURATION < 2**53
    weights = whole.astype(np.float64 if exact else np.int64)
    terms: dict[int, list[int]] = {i: [] for i in names}
    for i, t in block:
        terms[i].append(number[t])
    root, order = item_tree([np.array(sorted(terms[i]), np.int64) for i in names], weights)
    width = max(1, min(SLICE_DOCS, SLICE_BYTES // (8 * len(vocabulary))))

    def searching(weakest: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(root, weights, k, weakest)
            for batch in small_batches(batches, width):
                lists = batch.column("terms")
                size = lists.value_lengths().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), size)
                tf = batch.column("counts").flatten().to_numpy()
                # n times N may exceed 64 bits
                m = np.array([FLOOR + SLOPE * n * documents // length for n in batch.column("n").to_pylist()], np.int64)
                impacts = np.zeros((len(vocabulary), batch.num_rows), weights.dtype)
                impacts[lists.flatten().to_numpy(), row] = SCALE * tf // (SATURATION * tf + LENGTH * m[row])
                if batch.num_rows:
                    search.add(impacts, batch.column("doc_id").to_numpy())
            place, rank = np.nonzero(search.scores > 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "item": pa.array(place, pa.int32()), "score": pa.array(search.scores[place, rank]),
                    "doc_id": pa.array(search.ids[place, rank]),
                }
            )

        return run

    found = "item int, score bigint, doc_id bigint"
    candidates = known.where("doc_id is not null and size(terms) > 0")
    first = lowest_hashes(candidates, F.xxhash64("doc_id"), SAMPLE)
    start = np.zeros(len(names), np.int64)
    for r in best(first.mapInArrow(searching(start.copy()), found), k).where(F.col("rank") == k).collect():  # a row an item
        start[r.item] = r.score
    ranked = best(candidates.mapInArrow(searching(start), found), k)
    places = spark.createDataFrame([(place, names[i]) for place, i in enumerate(order)], "item int, item_id bigint")
    return ranked.join(F.broadcast(places), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, ``rank`` from 1.

    Scores follow the weights and impacts of this module's constants; only scores above 0 are ranked,
    equal ones by ascending ``doc_id``. Every row of ``docs`` with a term counts in the statistics;
    rows without ``doc_id`` are not ranked, and repeated rows are ranked each. Rows of ``items`` with
    one ``item_id`` are one item with the terms of all; rows without an id are no items. A null or
    empty text has no terms. Empty tables give an empty result; further columns are ignored.
    """
    wanted = stage(item_terms(items))
    blocks = -(-wanted.count() // BLOCK_TERMS)
    found = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if rows:
            result = search_block(docs, [(r.item_id, bytes(r.term)) for r in rows], k)
            found = result if blocks == 1 else found.unionByName(stage(result))
    return found


SQL = """
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n) AS len FROM lengths),
frequencies AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM frequencies, corpus GROUP BY term
),
sizes AS (SELECT doc_id, 100 - 90 + ((90 * n * docs) // len) AS m FROM lengths, corpus),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN frequencies USING (term) JOIN sizes USING (doc_id)
  GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""


@query("op13_ranked_search", SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
