"""Scoring by a Brown class-based bigram model.

Every counted training word belongs to one of ``CLASSES`` classes, chosen so that the likelihood of
class bigrams is largest; words never met form a class of their own. The probability of a word is
the smoothed transition from the class before times the word's smoothed share of its class.

The classes start from an exchange on the driver over *units* (the ``WORD_UNITS`` most frequent
words, and all other words by their last bytes). Then all words are clustered in Spark: each sweep
sums, for every word, how often each class stands before and behind it, and the words
take their best classes, given the table of class bigrams; half of them in turn. Sweeps go on until the likelihood settles.

What is broadcast is bounded by parameters: the ``LISTED`` most frequent words with their counts and
classes, and the class tables. All other words meet their counts and classes by shuffle joins.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm.common import documents, small_batches, texts_of
from garimpo.llm.language import remainder
from garimpo.llm.registry import query
from garimpo.schema import shared_folder, stage

#: The end of a text as a token: no word is empty.
END = b""
WORD_UNITS, ENDING_UNITS, ENDING = 512, 512, 3
UNITS = WORD_UNITS + ENDING_UNITS
CLASSES, SWEEPS = 64, 6
#: Class of the words never met in training.
UNSEEN = CLASSES
#: Most sweeps over all words, and the relative gain of likelihood below which they end.
WORD_SWEEPS, LEAST_GAIN = 6, 1e-3
#: Rows that are judged together in a sweep.
JUDGED = 400
LISTED = 1 << 18
#: Entries a task counts before it hands them on.
COUNTED = 400_000
#: Weight of the class shares in a transition.
BACKOFF = 8.0


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased, then one end."""
    return [*text.lower().split(), END]


def ending_unit(word: bytes) -> int:
    return WORD_UNITS + zlib.crc32(word[-ENDING:]) % ENDING_UNITS


def code_of(word: bytes) -> int:
    """The negative code of a word that is not listed: 54 bits of a hash over 9 bits of its unit.

    Words of equal code, which chance gives to one pair in 2^54, share a class; counts are by word.
    """
    hashed = xxhash.xxh3_64_intdigest(word) & ((1 << 54) - 1)
    return -1 - (hashed * ENDING_UNITS + ending_unit(word) - WORD_UNITS)


def turn_of(code):
    """0 or 1, from the hash in a negative code: the sweeps in which a word moves."""
    return (-1 - code) // ENDING_UNITS % 2


class Lexicon(dict):
    """Word to code: the rank of a listed word, a negative ``code_of`` of any other."""

    def __init__(self, counts: dict[bytes, int], ends: int):
        """``counts``: the listed words; ``ends``: how often the end occurs. The end has rank 0."""
        super().__init__()
        ranked = [END, *sorted((w for w in counts if w != END), key=lambda w: (-counts[w], w))]
        self.update(zip(ranked, range(len(ranked))))
        self.counts = np.array([ends, *(counts[w] for w in ranked[1:])], np.int64)
        self.turns = np.array([turn_of(code_of(w)) for w in ranked], np.int64)
        self.units = np.array([i if i < WORD_UNITS else ending_unit(w) for i, w in enumerate(ranked)], np.int64)

    def __missing__(self, word: bytes) -> int:
        return code_of(word)

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def units_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < 0, WORD_UNITS + (-1 - codes) % ENDING_UNITS, self.units[np.maximum(codes, 0)])


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each token occurs in ``docs``; counted in tasks, summed by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
            )

        for batch in small_batches(batches, 100):
            for text in batch.column("text").to_pylist():
                counts.update(tokens(text))
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words of the highest frequency bands that hold at most ``most`` words together."""
    band = F.floor(F.log2("n") * 8)
    bands = {r["band"]: r["words"] for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("words")).collect()}
    total, least = 0, None
    for b in sorted(bands, reverse=True):
        total += bands[b]
        if total > most:
            break
        least = b
    if least is None:
        return {}
    table = counts.where(band >= least).toArrow()
    return dict(zip(map(bytes, table.column("word").to_pylist()), table.column("n").to_pylist()))


def count_bigrams(docs: DataFrame, lexicon) -> DataFrame:
    """``first, second, n``: bigrams of codes over ``docs``; a text starts behind an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            codes = np.concatenate([np.zeros(1, np.int64), *held])
            first, second = codes[:-1], codes[1:]  # a text ends with code 0, behind which the next starts
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])][: len(first)])
            n = np.diff(np.r_[new, len(first)])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (first[new], second[new], n)], ["first", "second", "n"])

        for batch in small_batches(batches, 100):
            for text in batch.column("text").to_pylist():
                held.append(words.codes(tokens(text)))
                size += len(held[-1])
            if size >= 2 * COUNTED:
                yield out()
                held.clear()
                size = 0
        yield out()

    pairs = docs.select("text").mapInArrow(run, "first bigint, second bigint, n bigint")
    return pairs.groupBy("first", "second").agg(F.sum("n").alias("n"))


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    """``cell, n`` rows of tasks summed to a ``size`` x ``size`` matrix on the driver."""
    table = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(size * size)
    sums[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return sums.reshape(size, size)


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sums)
    return pa.RecordBatch.from_pydict({"cell": pa.array(at.astype(np.int32)), "n": pa.array(sums[at].astype(np.int64))})


def unit_pairs(pairs: DataFrame, lexicon) -> np.ndarray:
    """Bigrams of units as a UNITS x UNITS matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        sums = np.zeros(UNITS * UNITS)
        for batch in batches:
            first, second, n = (c.to_numpy() for c in batch.columns)
            sums += np.bincount(words.units_of(first) * UNITS + words.units_of(second), n, UNITS * UNITS)
        yield _cells(sums)

    return _matrix(pairs.mapInArrow(run, "cell int, n bigint"), UNITS)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: units move one at a time to the class that gives the highest likelihood.

    Class 0 holds the end of text alone. The matrix has a fixed size, whatever the data's.
    """
    n = len(pairs)
    order = np.argsort(-pairs.sum(1), kind="stable")
    order = order[order != 0]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    onto = np.zeros((n, classes))
    onto[np.arange(n), of] = 1
    table = onto.T @ pairs @ onto
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not pairs[u].any() and not pairs[:, u].any():
                continue
            own, a = pairs[u, u], of[u]
            out = np.bincount(of, pairs[u], classes)
            into = np.bincount(of, pairs[:, u], classes)
            table[a] -= out
            table[:, a] -= into
            table[a, a] += own
            out[a] -= own
            into[a] -= own
            rows, columns = table.sum(1), table.sum(0)
            by_row = _f(table + out) - _f(table)
            by_column = _f(table + into[:, None]) - _f(table)
            corner = np.diag(table)
            gain = by_row.sum(1) - np.diag(by_row) + by_column.sum(0) - np.diag(by_column)
            gain += _f(corner + out + into + own) - _f(corner)
            gain -= _f(rows + out.sum() + own) - _f(rows) + _f(columns + into.sum() + own) - _f(columns)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            moved += b != a
            of[u] = b
            table[b] += out
            table[:, b] += into
            table[b, b] += own
        if not moved:
            break
    return of


def class_sums(pairs: DataFrame, listed, rare: DataFrame) -> DataFrame:
    """``code, cls, slots``: how often each class stands next to each code, and the code's own class.

    A slot is ``n * 256 + k``: ``k`` is a class before, CLASSES + a class behind, or 2 * CLASSES for
    the code before itself. ``listed`` are the classes of listed words, ``rare`` (``code, cls``) those
    of all others.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = listed.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            code, slot, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((slot, code))
            code, slot, n = code[order], slot[order], n[order]
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (slot[1:] != slot[:-1])])
            arrays = [pa.array(x) for x in (code[new], slot[new].astype(np.int32), np.add.reduceat(n, new))]
            return pa.RecordBatch.from_arrays(arrays, ["code", "slot", "n"])

        for batch in batches:
            first, second, n = (c.to_numpy() for c in batch.columns)
            for code, other, base in ((second, first, 0), (first, second, CLASSES)):
                at = other >= 0
                held.append((code[at], base + of[other[at]], n[at]))
            at = first == second
            held.append((first[at], np.full(at.sum(), 2 * CLASSES), n[at]))
            size += sum(len(x[0]) for x in held[-3:])
            if size >= 2 * COUNTED:
                yield out()
                held.clear()
                size = 0
        if size:
            yield out()

    known = pairs.mapInArrow(near, "code bigint, slot int, n bigint")
    other = pairs.where("first < 0").selectExpr("second as code", "first as other", "0 as base", "n").unionAll(
        pairs.where("second < 0").selectExpr("first as code", "second as other", f"{CLASSES} as base", "n")
    )
    joined = other.join(rare.select(F.col("code").alias("other"), "cls"), "other").select(
        "code", (F.col("base") + F.col("cls")).alias("slot"), "n"
    )
    # few rows a code are left, so one shuffle by code serves both groupings
    sums = known.unionAll(joined).repartition("code").groupBy("code", "slot").agg(F.sum("n").alias("n"))
    slots = sums.groupBy("code").agg(F.collect_list(F.col("n") * 256 + F.col("slot")).alias("slots"))
    return slots.join(rare, "code", "left").select("code", "cls", "slots")


def _unpacked(batch: pa.RecordBatch, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes and classes of the rows; row, slot and count of each entry."""
    code = batch.column("code").to_numpy()
    own = batch.column("cls").fill_null(0).to_numpy(zero_copy_only=False)
    own = np.where(code < 0, own, of[np.maximum(code, 0)])
    slots = batch.column("slots")
    packed = slots.flatten().to_numpy()
    row = np.repeat(np.arange(len(code)), np.diff(slots.offsets.to_numpy()))
    return code, own, row, packed % 256, packed // 256


def class_table(sums: DataFrame, listed) -> np.ndarray:
    """Bigrams of classes as a CLASSES x CLASSES matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            _, own, row, slot, n = _unpacked(batch, listed.value)
            at = slot < CLASSES
            table += np.bincount(slot[at] * CLASSES + own[row[at]], n[at], CLASSES * CLASSES)
        yield _cells(table)

    return _matrix(sums.mapInArrow(run, "cell int, n bigint"), CLASSES)


def likelihood(table: np.ndarray) -> float:
    """What depends on the classes in the log-likelihood of class bigrams."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def best_classes(table: np.ndarray, own: np.ndarray, row: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class in which each row gives the highest likelihood, the other rows staying where they are.

    ``own`` are the rows' classes; ``row, slot, n`` the entries of their slots. Class 0 takes no word.
    """
    m, classes = len(own), len(table)
    dense = np.bincount(row * (2 * classes + 1) + slot, n, m * (2 * classes + 1)).reshape(m, -1)
    before, behind, self_ = dense[:, :classes], dense[:, classes : 2 * classes], dense[:, -1]
    ends, begins, at = before.sum(1), behind.sum(1), np.arange(m)
    before[at, own] -= self_
    behind[at, own] -= self_
    sides = ((table, before), (table.T, behind))
    gain = np.zeros((m, classes))
    left = np.zeros(m)  # what the row adds to its own class
    for t, near in sides:
        r, s = np.nonzero(near)
        x = near[r, s]
        # equal counts next to one class add the same to any class: computed once
        kinds, which = np.unique((s << 48) + x.astype(np.int64), return_inverse=True)
        cell = t[kinds >> 48]
        added = _f(cell + (kinds & ((1 << 48) - 1))[:, None]) - _f(cell)
        if len(r):
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            gain[r[starts]] += np.add.reduceat(added[which], starts, axis=0)
        column = t[:, own].T
        taken = _f(column) - _f(column - near)
        taken[at, own] = 0
        left += taken.sum(1)
    corner = np.diag(table)
    gain += _f(corner + before + behind + self_[:, None])
    gain += _f(corner) - _f(corner + before) - _f(corner + behind)
    # the row's own class has lost the row when another class gets it
    for (t, near), (_, opposite) in zip(sides, sides[::-1]):
        cell, mine = t[own], near[at, own][:, None]
        gain += _f(cell - opposite + mine) - _f(cell - opposite) - _f(cell + mine) + _f(cell)
    home = table[own, own]
    left += _f(home) - _f(home - before[at, own] - behind[at, own] - self_)
    for size, total in ((table.sum(0), ends), (table.sum(1), begins)):
        gain -= _f(size + total[:, None]) - _f(size)
        left -= _f(size[own]) - _f(size[own] - total)
    gain[at, own] = left + 1e-9 * np.abs(left)  # of equal ones the old class
    gain[:, 0] = -np.inf
    return np.where(own == 0, 0, gain.argmax(1))


def take_best(sums: DataFrame, lexicon, listed, table: np.ndarray, turn: int) -> DataFrame:
    """``code, cls``: the half of the words whose ``turn`` it is in their best class, given the classes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, JUDGED):
            code, own, row, slot, n = _unpacked(batch, listed.value)
            best = best_classes(table, own, row, slot, n)
            turns = np.where(code < 0, turn_of(code), lexicon.value.turns[np.maximum(code, 0)])
            best = np.where(turns == turn % 2, best, own)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(best.astype(np.int32))], ["code", "cls"])

    return sums.mapInArrow(run, "code bigint, cls int")


def unlisted(counts: DataFrame, lexicon) -> DataFrame:
    """``word, n, code`` of the counted words that are not listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon.value
        for batch in batches:
            codes = words.codes(batch.column("word").to_pylist())
            yield batch.append_column("code", pa.array(codes)).filter(pa.array(codes < 0))

    return counts.select("word", "n").mapInArrow(run, "word binary, n bigint, code bigint")


@dataclass
class Clusters:
    """``listed``: classes of listed words; ``rare``: ``code, cls`` of all others; ``table``: class bigrams."""

    listed: np.ndarray
    rare: DataFrame
    table: np.ndarray
    level: float


def cluster(pairs: DataFrame, lexicon, rare_words: DataFrame) -> list[Clusters]:
    """The clusterings of all counted words from the first to the last sweep, each better than the one before.

    Words move at once, half of them in a sweep, lest neighbours change places for ever. A sweep may still
    lose; it is then dropped and ends the clustering.
    """
    spark = pairs.sparkSession
    of = exchange(unit_pairs(pairs, lexicon))
    listed = of[lexicon.value.units]
    by_ending = F.array(*[F.lit(int(c)) for c in of[WORD_UNITS:]])
    unit = F.pmod(-1 - F.col("code"), F.lit(ENDING_UNITS)).cast("int")
    rare = rare_words.select("code").distinct().select("code", F.get(by_ending, unit).alias("cls"))
    folder = f"{shared_folder(spark)}/{uuid4().hex}"
    found: list[Clusters] = []
    for sweep in range(WORD_SWEEPS + 1):
        known = spark.sparkContext.broadcast(listed)
        sums = class_sums(pairs, known, rare)
        sums.write.mode("overwrite").parquet(folder)  # those of the sweep before are not needed again
        sums = spark.read.schema(sums.schema).parquet(folder)
        table = class_table(sums, known)
        level = likelihood(table)
        if found and level <= found[-1].level:
            break
        settled = bool(found) and level - found[-1].level < LEAST_GAIN * abs(level)
        found.append(Clusters(listed, rare, table, level))
        if settled or sweep == WORD_SWEEPS:
            break
        moved = stage(take_best(sums, lexicon, known, table, sweep))
        at = moved.where("code >= 0").toArrow()
        listed = listed.copy()
        listed[at.column("code").to_numpy()] = at.column("cls").to_numpy()
        rare = moved.where("code < 0")
    return found


@dataclass
class Scorer:
    """Logarithms to base 10: transitions by classes, and the denominator of each class.

    ``listed`` are the classes and ``logs`` the counts of listed words."""

    listed: np.ndarray
    logs: np.ndarray
    transition: np.ndarray
    share: np.ndarray


def fit(clusters: Clusters, counted: np.ndarray, rare: DataFrame) -> Scorer:
    """``counted``: how often each listed word occurs; ``rare``: ``word, n, cls`` of all others."""
    table = np.zeros((CLASSES + 1, CLASSES))
    table[:CLASSES] = clusters.table
    words = np.bincount(clusters.listed, minlength=CLASSES).astype(float)
    for r in rare.groupBy("cls").agg(F.count("*").alias("words")).collect():
        words[r["cls"]] += r["words"]
    size = table.sum(0)
    # a word never met is as likely behind any class as it is in the base score
    never = 1 / (size.sum() + words.sum() + 1)
    prior = (size + 1) / (size.sum() + CLASSES)
    known = (table + BACKOFF * prior) / (table.sum(1, keepdims=True) + BACKOFF)
    transition = np.log10(np.c_[(1 - never) * known, np.full(CLASSES + 1, never)])
    size, words = np.r_[size, 0], np.r_[words, 0]
    # a word never met is the only one of its class, and a class may be empty
    share = -np.log10(np.maximum(size + words, 1))
    return Scorer(clusters.listed, np.log10(counted + 1), transition, share)


PARTIAL = (
    "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, listed double, classes double, "
    "at array<int>, rare array<binary>, before array<int>, behind array<int>"
)


def score(docs: DataFrame, train: F.Column = None) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    ``train`` is a condition on ``doc_id`` that chooses the training documents (default: all).
    A null or empty text is one end. Repeated rows are scored each, and each counts in training.
    Without any training document the base score is 0 and all classes are equally likely.
    """
    rows = texts_of(docs).withColumn("text", F.col("text").cast("binary"))
    training = rows if train is None else rows.where(train)
    spark = docs.sparkSession
    counts = stage(count_words(training))
    ends = F.sum(F.when(F.col("word") == F.lit(END), F.col("n")))
    told = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(ends, F.lit(0)).alias("ends")
    ).first()
    lexicon = spark.sparkContext.broadcast(Lexicon(frequent(counts, LISTED), told["ends"]))
    rare_words = stage(unlisted(counts, lexicon))
    clusters = cluster(stage(count_bigrams(training, lexicon)), lexicon, rare_words)[-1]
    classed = stage(rare_words.join(clusters.rare, "code").select("word", "n", "cls"))
    scorer = spark.sparkContext.broadcast(fit(clusters, lexicon.value.counts, classed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = lexicon.value, scorer.value
        row = TaskContext.get().partitionId() << 33
        for batch in small_batches(batches):
            out: list[list] = [[] for _ in range(9)]
            for text in batch.column("text").to_pylist():
                found = tokens(text)
                codes = words.codes(found)
                cls = np.where(codes < 0, -1, model.listed[np.maximum(codes, 0)])
                before, behind = np.r_[0, cls[:-1]], np.r_[cls[1:], -1]
                listed = cls >= 0
                both = listed & (before >= 0)
                classes = model.transition[before[both], cls[both]].sum() + model.share[cls[listed]].sum()
                logs = model.logs[codes[listed]]
                at = np.flatnonzero(~listed)
                values = (
                    row, len(found), int((logs > 0).sum()), float(logs.sum()), float(classes), at,
                    [found[i] for i in at], before[at], behind[at],
                )
                row += 1
                for column, value in zip(out, values):
                    column.append(value)
            few, many = pa.list_(pa.int32()), pa.list_(pa.binary())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), few, many, few, few)
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(
                [arrays[0], batch.column("doc_id"), *arrays[1:]], [c.split()[0] for c in PARTIAL.split(", ")]
            )

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer.value
        for batch in small_batches(batches, 100):
            lists = batch.column("words")
            flat = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, before, behind, n, cls = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            order = np.lexsort((at, doc))
            before, behind, cls = before[order], behind[order], cls[order]
            # a class before of -1: that of the word before, which is not listed either
            before = np.where(before < 0, np.r_[0, cls[:-1]], before)
            classes = model.transition[before, cls] + model.share[cls]
            classes += np.where(behind < 0, 0.0, model.transition[cls, np.maximum(behind, 0)])
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(np.bincount(doc, n > 0, m).astype(np.int64)),
                    pa.array(np.bincount(doc, np.log10(n + 1), m)), pa.array(np.bincount(doc[order], classes, m)),
                ],
                ["row", "more_known", "more", "more_classes"],
            )

    partial = stage(rows.mapInArrow(run, PARTIAL))
    rare = partial.select("row", F.explode(F.arrays_zip("at", "rare", "before", "behind")).alias("x")).select("row", "x.*")
    met = rare.join(classed.withColumnRenamed("word", "rare"), "rare", "left").select(
        "row",
        F.struct(
            "at", "before", "behind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(UNSEEN)).alias("cls")
        ).alias("word"),
    )
    more = met.groupBy("row").agg(F.collect_list("word").alias("words")).mapInArrow(
        complete, "row bigint, more_known bigint, more double, more_classes double"
    )
    emitted = F.col("listed") + F.coalesce("more", F.lit(0.0))
    n, v = told["n"], told["v"]
    return partial.drop("at", "rare", "before", "behind").join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (emitted - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (emitted + F.col("classes") + F.coalesce("more_classes", F.lit(0.0))).alias("score"),
    )


@query("op3_language_model")
def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(7) == 2
    return score(documents(spark, sf_dir), ~held_out).withColumn("held_out", held_out).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )
