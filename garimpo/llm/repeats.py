"""Repeated windows of units (bytes or words), found by seeds and extended both ways.

A *window* is ``window`` consecutive units of one document. Winnowing picks a seed in every window:
its gram of ``gram`` units with the smallest hash. Equal windows have equal seeds at equal places,
so only places with equal seeds need to be compared. Consecutive windows with the same seed form a
*stretch*; extending a match from the seed both ways means asking how much of the stretch is equal.

1. Whole stretches: those with equal seeds meet. A stretch equal to an earlier one is repeated
   throughout; one whose seed occurs nowhere else is not repeated; the others stay open.
2. Open stretches are cut into parts at fixed distances from the seed, and the parts are judged in
   the same way, by the units that all windows of a part have in common.
3. What is open then is judged window by window.

Every step shuffles rows of (hash, hash, document, place), never pairs. Equality is by two 64-bit
hashes of the units compared; it is not confirmed on the units themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import mixed, small_batches, wrapping
from garimpo.schema import stage

STEP = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2**64
BACK = np.uint64(pow(int(STEP), -1, 2**64))
#: The 64-bit unit of each byte.
BYTE_UNITS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SECOND = np.uint64(0x5851F42D4C957F2D)
POWERS = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of STEP and of its inverse, modulo 2**64."""
    if POWERS["n"] < n:
        size = max(4096, 1 << n.bit_length())
        for name, base in (("up", STEP), ("down", BACK)):
            steps = np.full(size, base)
            steps[0] = 1
            POWERS[name] = np.multiply.accumulate(steps)
        POWERS["n"] = size
    return POWERS["up"][:n], POWERS["down"][:n]


class Hashes:
    """Hashes of any stretches of one sequence of 64-bit units, from prefix sums."""

    def __init__(self, units: np.ndarray, salt: np.uint64 | None = None):
        n = len(units)
        if units.dtype == np.uint8:
            units = BYTE_UNITS[units]
        if salt is not None:  # hashes independent of those without
            units = mixed(units ^ salt)
        self.up, down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * down[:n], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + np.uint64(1) * (end - start).astype(np.uint64))


@dataclass(frozen=True)
class Shape:
    """What to look for: units per window, per gram and windows per part; whether a document's own
    earlier windows count; windows of a document that are worked on at a time."""

    window: int
    gram: int
    part: int
    own: bool
    segment: int = 1 << 21


def seeds(h: Hashes, n: int, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a sequence of ``n`` units: first window, windows, seed's place, seed's hash."""
    starts = np.arange(n - shape.gram + 1)
    gram = h(starts, starts + shape.gram)
    bits = np.uint64(int(n).bit_length())
    # smallest hash first, then the leftmost
    key = (gram >> bits << bits) | starts.astype(np.uint64)
    span, width = 1, shape.window - shape.gram + 1
    low = key
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    seed = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
    count = np.diff(np.r_[first, len(seed)])
    return first, count, seed[first], gram[seed[first]]


def _stretches(h: Hashes, n: int, shape: Shape):
    first, count, seed, name = seeds(h, n, shape)
    whole = h(first, first + count - 1 + shape.window)
    with wrapping():
        whole = mixed(whole + mixed((seed - first).astype(np.uint64)))
    return name, whole, first, count, seed


def _parts(h: Hashes, first: np.ndarray, count: np.ndarray, seed: np.ndarray, shape: Shape):
    """Cut stretches at fixed distances from their seeds: common units, all units, place, windows."""
    reach_high, reach_low = seed - first, seed - first - count + 1
    top, bottom = reach_high // shape.part, reach_low // shape.part
    pieces = top - bottom + 1
    of = np.repeat(np.arange(len(first)), pieces)
    block = top[of] - (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    high = np.minimum(block * shape.part + shape.part - 1, reach_high[of])
    low = np.maximum(block * shape.part, reach_low[of])
    at, windows = seed[of] - high, high - low + 1
    core_from = seed[of] - block * shape.part
    core = h(core_from, core_from - shape.part + 1 + shape.window)
    with wrapping():
        core = mixed(core + mixed(block.astype(np.uint64)))
        whole = mixed(h(at, at + windows - 1 + shape.window) + mixed(low.astype(np.uint64)))
    return core, whole, at, windows


def _windows(h: Hashes, other: Hashes, first: np.ndarray, count: np.ndarray, shape: Shape):
    of = np.repeat(np.arange(len(first)), count)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return h(at, at + shape.window), other(at, at + shape.window), at, np.ones(len(at), np.int64)


PLACES = "name bigint, whole bigint, doc_id bigint, place bigint"


def _rows(doc_ids: list[int], found: list[tuple], seeds_: bool) -> pa.RecordBatch:
    """``place`` packs the first window, the number of windows and the seed's distance."""
    if not found:
        return pa.RecordBatch.from_pydict({c: pa.array([], pa.int64()) for c in ("name", "whole", "doc_id", "place")})
    name, whole, at, count = (np.concatenate([f[i] for f in found]) for i in range(4))
    reach = np.concatenate([f[4] - f[2] for f in found]) if seeds_ else np.zeros(len(at), np.int64)
    ids = np.repeat(np.array(doc_ids, np.int64), [len(f[0]) for f in found])
    return pa.RecordBatch.from_pydict(
        {
            "name": pa.array(name.view(np.int64)), "whole": pa.array(whole.view(np.int64)), "doc_id": pa.array(ids),
            "place": pa.array((at.astype(np.int64) << 20) | (count.astype(np.int64) << 10) | reach),
        }
    )


def judge(places: DataFrame, shape: Shape) -> DataFrame:
    """``doc_id, place, repeated``: places repeated throughout, and those that are open (false).

    Rows with equal ``whole`` are one class; those behind its first row are repeated. The first
    row is open if another class has the same name. Counts and first rows are combined before the
    shuffle, and the joins are plain ones, so adaptive execution splits a name that many rows share.
    """
    places = stage(places)  # read twice; what makes them works through all texts
    names = places.groupBy("name").agg(
        F.count("*").alias("rows"), (F.min("whole") != F.max("whole")).alias("several")
    ).where("rows > 1").drop("rows")
    met = stage(places.join(names, "name"))
    first = met.groupBy("name", "whole").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    before = F.col("first.doc_id") < F.col("doc_id")
    if shape.own:
        before = before | (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.place") < F.col("place"))
    return (
        met.join(first, ["name", "whole"])
        .select("doc_id", "place", before.alias("repeated"), "several")
        .where("repeated or several").drop("several")
    )


def with_ranges(docs: DataFrame, ranges: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to the list of their ``place`` values, which is shorter than the document."""
    return docs.join(ranges.groupBy("doc_id").agg(F.collect_list("place").alias("places")), "doc_id", how)


def repeated_windows(docs: DataFrame, units: Callable[[bytes], np.ndarray], shape: Shape) -> DataFrame:
    """``doc_id, place`` of all runs of windows that occur earlier (see ``ranges_of``).

    ``docs`` has ``doc_id`` (not null) and ``text`` as binary. Earlier means in a document with a
    smaller id and, if ``shape.own``, also before in the same document.
    """

    def segments(u: np.ndarray, places: np.ndarray | None):
        """Bounded slices of a document with the places that start in each."""
        for start in range(0, len(u) - shape.window + 1, shape.segment):
            inside = None if places is None else places[(places >> 20 >= start) & (places >> 20 < start + shape.segment)]
            if inside is None or len(inside):
                # places of one window or more reach at most a window further than a segment's own
                yield start, u[start : start + shape.segment + (1 if places is None else 2) * shape.window - 1], inside

    def moved(found: tuple, start: int) -> tuple:
        return found[:2] + (found[2] + start,) + found[3:4] + tuple(x + start for x in found[4:])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with wrapping():
            for batch in small_batches(batches, 200):
                ids, found = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    u = units(text.as_buffer())
                    for start, part, _ in segments(u, None):
                        ids.append(doc_id)
                        found.append(moved(_stretches(Hashes(part), len(part), shape), start))
                yield _rows(ids, found, True)

    def cut(single: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with wrapping():
                for batch in small_batches(batches, 200):
                    ids, found = [], []
                    for doc_id, text, places in zip(
                        batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("places").to_pylist()
                    ):
                        for start, part, p in segments(units(text.as_buffer()), np.array(places, np.int64)):
                            first, count, reach = (p >> 20) - start, (p >> 10) & 1023, p & 1023
                            h = Hashes(part)
                            ids.append(doc_id)
                            if single:
                                cut_ = _windows(h, Hashes(part, SECOND), first, count, shape)
                            else:
                                cut_ = _parts(h, first, count, first + reach, shape)
                            found.append(moved(cut_, start))
                    yield _rows(ids, found, False)

        return run

    stretches = stage(judge(docs.mapInArrow(whole, PLACES), shape))
    opened = stretches.where("not repeated").select("doc_id", "place")
    parts = stage(judge(with_ranges(docs, opened, "inner").mapInArrow(cut(False), PLACES), shape))
    opened = parts.where("not repeated").select("doc_id", "place")
    single = stage(judge(with_ranges(docs, opened, "inner").mapInArrow(cut(True), PLACES), shape))
    found = stretches.where("repeated").unionByName(parts.where("repeated")).unionByName(single.where("repeated"))
    return found.select("doc_id", "place")


def ranges_of(places: list[int] | None, window: int) -> np.ndarray:
    """Maximal ranges of units covered by the windows at ``places``: rows ``start, end``."""
    p = np.sort(np.array(places or [], np.int64))
    if not len(p):
        return np.zeros((0, 2), np.int64)
    start, end = p >> 20, (p >> 20) + ((p >> 10) & 1023) - 1 + window
    end = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return np.stack([start[first], end[np.r_[first[1:] - 1, len(p) - 1]]], axis=1)
