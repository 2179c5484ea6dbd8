"""Folding of the points near the points of one block, inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Points of a leaf, points of the stream folded at once, points compared with a leaf at once, leaves whose
#: boxes are judged at once.
LEAF, CHUNK, COMPARED, JUDGED = 64, 2**18, 4096, 64
#: What a row of a block is to it: its own, its own and one of the others, another's.
OWN, BOTH, OTHER = 0, 1, 2
LOW_BITS = 32
MOST = np.iinfo(np.int64).max


def curve_order(points: np.ndarray) -> np.ndarray:
    """Order of the points along a Z curve over their bounding box."""
    bits = min(16, 60 // points.shape[1])
    low = points.min(axis=0)
    width = max((points.max(axis=0) - low).max(), 1e-300)
    grid = np.minimum((points - low) / width * 2**bits, 2**bits - 1).astype(np.int64)
    code = np.zeros(len(points), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(points.shape[1]):
            code = code << 1 | grid[:, axis] >> bit & 1
    return np.argsort(code, kind="stable")


class Leaves:
    """Points along the curve, cut into leaves with bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.order = curve_order(points)
        self.points = points[self.order]
        self.starts = np.arange(0, len(points), LEAF)
        self.low = np.minimum.reduceat(self.points, self.starts)
        self.high = np.maximum.reduceat(self.points, self.starts)


class Block:
    """The points of one block and what has been folded for them so far."""

    def __init__(self, rows: pa.Table, points: np.ndarray, folds: dict, radius: float, margin: float):
        self.rows, self.folds = rows, folds
        self.square, self.margin = radius * radius, margin
        self.leaves = Leaves(points)
        n = len(self.leaves.points)
        self.hits = np.zeros(n, np.int64)
        kinds = {c: rows.schema.field(c).type for c in folds}
        self.floats = [c for c, how in folds.items() if how == "sum" and pa.types.is_floating(kinds[c])]
        self.whole = [c for c, how in folds.items() if how == "sum" and c not in self.floats]
        self.least = [c for c, how in folds.items() if how == "min"]
        self.sums = {c: np.zeros(n) for c in self.floats}
        self.high = {c: np.zeros(n, np.int64) for c in self.whole}
        self.low = {c: np.zeros(n, np.int64) for c in self.whole}
        self.minima = {c: np.full(n, MOST) for c in self.least}

    def _columns(self, values: dict) -> tuple[list, np.ndarray]:
        """Doubles whose sums over a chunk are exact where integers are added: (target, column)."""
        found = [(self.hits, np.ones(len(next(iter(values.values()))))) ]
        for c in self.whole:
            # 2^31 * CHUNK and 2^32 * CHUNK are below 2^53
            found += [(self.high[c], (values[c] >> LOW_BITS).astype(float)), (self.low[c], (values[c] & 2**LOW_BITS - 1).astype(float))]
        for c in self.floats:
            found.append((self.sums[c], np.where(np.isfinite(values[c]), values[c], 0.0)))
        found = [(target, column) for target, column in found if column.any()]
        return [target for target, _ in found], np.column_stack([column for _, column in found])

    def fold(self, points: np.ndarray, values: dict[str, np.ndarray]):
        """Fold a chunk of other points; yields (own row, other row) of pairs too close to the radius to tell."""
        mine, theirs = self.leaves, Leaves(points)
        values = {c: v[theirs.order] for c, v in values.items()}
        targets, columns = self._columns(values)
        leaf_sums = np.add.reduceat(columns, theirs.starts)
        leaf_minima = {c: np.minimum.reduceat(values[c], theirs.starts) for c in self.least}
        # infinite or undefined amounts would spoil a product with zero, so they are added apart
        odd = {c: np.flatnonzero(~np.isfinite(values[c])) for c in self.floats}
        odd = {c: at for c, at in odd.items() if len(at)}
        sure, unsure = self.square * (1 - self.margin), self.square * (1 + self.margin)
        steps = np.arange(LEAF)
        for i, inside, crossing in self._met(theirs):
            start = mine.starts[i]
            own = slice(start, min(start + LEAF, len(mine.points)))
            within = np.flatnonzero(inside)
            met = (np.flatnonzero(crossing)[:, None] * LEAF + steps).ravel()
            met = met[met < len(theirs.points)]
            # of the points in crossing leaves, those near every own point or none need no comparison either
            away, across = theirs.points[met] - mine.high[i], mine.low[i] - theirs.points[met]
            gap = (np.maximum(np.maximum(away, across), 0.0) ** 2).sum(axis=1)
            whole = (np.maximum(-away, -across) ** 2).sum(axis=1) < sure
            sides = met[whole]
            met = met[~whole & (gap <= unsure)]
            if len(within) or len(sides):
                for target, found in zip(targets, leaf_sums[within].sum(axis=0) + columns[sides].sum(axis=0)):
                    target[own] += target.dtype.type(found)
                for c in self.least:
                    least = np.concatenate([leaf_minima[c][within], values[c][sides]]).min()
                    self.minima[c][own] = np.minimum(self.minima[c][own], least)
                for c, at in odd.items():
                    at = np.concatenate([at[inside[at // LEAF]], sides[np.isin(sides, at)]])
                    self.sums[c][own] += values[c][at].sum()
            if not len(met):
                continue
            centre = (mine.low[i] + mine.high[i]) / 2
            a = mine.points[own] - centre
            a = np.column_stack([-2 * a, (a * a).sum(axis=1), np.ones(len(a))])
            for at in range(0, len(met), COMPARED):
                some = met[at : at + COMPARED]
                b = theirs.points[some] - centre
                away = a @ np.column_stack([b, np.ones(len(b)), (b * b).sum(axis=1)]).T
                near = away < sure
                for target, found in zip(targets, (near.astype(float) @ columns[some]).T):
                    target[own] += found.astype(target.dtype)
                for c in self.least:
                    least = np.where(near, values[c][some], MOST).min(axis=1)
                    self.minima[c][own] = np.minimum(self.minima[c][own], least)
                for c, places in odd.items():
                    bad = np.flatnonzero(np.isin(some, places))
                    self.sums[c][own] += np.where(near[:, bad], values[c][some[bad]], 0.0).sum(axis=1)
                border = (away <= unsure) & ~near
                if border.any():
                    rows, columns_ = np.nonzero(border)
                    yield mine.order[start + rows], theirs.order[some[columns_]]

    def _met(self, theirs: Leaves):
        """Number of every own leaf that others may be near, and which of their leaves lie inside and cross the radius."""
        mine = self.leaves
        for first in range(0, len(mine.starts), JUDGED):
            some = slice(first, first + JUDGED)
            gap = span = 0.0
            for k in range(mine.points.shape[1]):
                a, b = theirs.low[None, :, k] - mine.high[some, None, k], mine.low[some, None, k] - theirs.high[None, :, k]
                apart, across = np.maximum(np.maximum(a, b), 0.0), np.maximum(-a, -b)
                gap, span = gap + apart * apart, span + across * across
            inside = span < self.square * (1 - self.margin)
            crossing = ~inside & (gap <= self.square * (1 + self.margin))
            for i in np.flatnonzero((inside | crossing).any(axis=1)):
                yield first + i, inside[i], crossing[i]

    def result(self) -> tuple[np.ndarray, dict]:
        """Row numbers of the points that have neighbours, and their folded columns."""
        found = np.flatnonzero(self.hits)
        out = {}
        for c in self.folds:
            if c in self.sums:
                out[c] = self.sums[c][found]
            elif c in self.minima:
                out[c] = self.minima[c][found]
            else:
                high, low = self.high[c][found], self.low[c][found]
                high, low = high + (low >> LOW_BITS), low & 2**LOW_BITS - 1
                if len(high) and max(-(high.min() + 1), high.max()) >= 2**31:
                    raise OverflowError(f"the sum of {c} does not fit 64 bits")
                out[c] = (high << LOW_BITS) + low
        return self.leaves.order[found], out


def positions(rows: pa.Table, axes: list[str]) -> np.ndarray:
    return np.column_stack([rows.column(x).to_numpy() for x in axes])


def block_folder(place, own: list[str], more: list[str], folds: dict, ends: tuple[list[str], list[str]], radius: float, margin: float):
    """Function for ``mapInArrow`` over rows sorted by ``block`` and ``side``.

    ``place`` gives the positions of a table's rows. Yields a row per own point with neighbours (``sure``, columns
    of the other side null), and a row per pair whose distance is within ``margin`` of the radius, with both
    positions under the names ``ends``.
    """

    def sums(state: Block) -> pa.Table:
        rows, found = state.result()
        return table(state.rows.take(pa.array(rows)), None, {c: pa.array(v) for c, v in found.items()}, True)

    def table(mine: pa.Table, other: pa.Table | None, values: dict, sure: bool) -> pa.Table:
        n = mine.num_rows
        out = {c: mine.column(c) for c in own}
        for c in more:
            out[c] = pa.nulls(n, mine.schema.field(c).type) if other is None else other.column(c)
        for names, rows in zip(ends, (mine, other)):
            at = None if other is None else place(rows)
            out |= {x: pa.nulls(n, pa.float64()) if at is None else pa.array(at[:, k]) for k, x in enumerate(names)}
        out |= {c: values[c].cast(mine.schema.field(c).type) if other is None else other.column(c) for c in folds}
        return pa.table(out | {"sure": pa.array(np.full(n, sure))})

    def run(batches):
        key, mine, theirs, state = None, [], [], None

        def begin():
            nonlocal state, mine
            rows = pa.concat_tables(mine).combine_chunks()
            mine = []
            both = rows.column("side")[0].as_py() == BOTH
            state = Block(rows, place(rows), folds, radius, margin)
            if both:
                yield from fold(rows)

        def fold(other: pa.Table):
            for at in range(0, other.num_rows, CHUNK):
                part = other.slice(at, CHUNK).combine_chunks()
                for rows, met in state.fold(place(part), {c: part.column(c).to_numpy() for c in folds}):
                    pairs = table(state.rows.take(pa.array(rows)), part.take(pa.array(met)), {}, False)
                    yield from pairs.to_batches()

        def drain():
            nonlocal theirs
            if mine and state is None:
                yield from begin()
            if theirs and state is not None:
                other, theirs = pa.concat_tables(theirs).combine_chunks(), []
                yield from fold(other)
            theirs = []

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            keys, is_other = rows.column("block").to_numpy(), rows.column("side").to_numpy() == OTHER
            change = (keys[1:] != keys[:-1]) | (is_other[1:] != is_other[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if keys[a] != key:
                    yield from drain()
                    if state is not None:
                        yield from sums(state).to_batches()
                    key, mine, theirs, state = keys[a], [], [], None
                (theirs if is_other[a] else mine).append(rows.slice(a, b - a))
                if sum(t.num_rows for t in theirs) >= CHUNK:
                    yield from drain()
        yield from drain()
        if state is not None:
            yield from sums(state).to_batches()

    return run


def touch(mine: Leaves, theirs: Leaves, radius: float, margin: float) -> bool:
    """Whether a point of ``mine`` is within ``radius`` of one of ``theirs``; the closest leaves are tried first."""
    gap = span = 0.0
    for k in range(mine.points.shape[1]):
        a, b = theirs.low[None, :, k] - mine.high[:, None, k], mine.low[:, None, k] - theirs.high[None, :, k]
        apart, across = np.maximum(np.maximum(a, b), 0.0), np.maximum(-a, -b)
        gap, span = gap + apart * apart, span + across * across
    square = radius * radius
    if (span < square * (1 - margin)).any():
        return True
    first, second = np.nonzero(gap <= square * (1 + margin))
    for at in np.argsort(gap[first, second], kind="stable"):
        a = mine.points[first[at] * LEAF : (first[at] + 1) * LEAF]
        b = theirs.points[second[at] * LEAF : (second[at] + 1) * LEAF]
        away = 0.0
        for k in range(a.shape[1]):  # as the expression of the points that are compared as rows
            apart = a[:, None, k] - b[None, :, k]
            away = away + apart * apart
        if (np.sqrt(away) <= radius).any():
            return True
    return False


def block_toucher(block: list[str], cell: list[str], axes: list[str], radius: float, margin: float):
    """Function for ``mapInArrow`` over rows sorted by ``block``, ``other`` and ``cell``.

    Yields ``(*block, *cell)`` for every other cell with a point within ``radius`` of a point of the block.
    """
    keys = [*block, *cell]

    def run(batches):
        own_key, other_key, own, other, leaves = None, None, [], [], None

        def found() -> list[tuple]:
            nonlocal leaves
            if not own or not other:
                return []
            if leaves is None:
                leaves = Leaves(np.concatenate(own))
            return [own_key + other_key] if touch(leaves, Leaves(np.concatenate(other)), radius, margin) else []

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            is_other = rows.column("other").to_numpy()
            key = np.column_stack([rows.column(c).fill_null(0).to_numpy() for c in keys])
            points = positions(rows, axes)
            change = np.any(key[1:] != key[:-1], axis=1) | (is_other[1:] != is_other[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(key)]
            met = []
            for a, b in zip(cuts, cuts[1:]):
                at, near = tuple(key[a, : len(block)].tolist()), tuple(key[a, len(block) :].tolist())
                if at != own_key or (is_other[a] and near != other_key):
                    met += found()
                    other = []
                if at != own_key:
                    own_key, own, leaves = at, [], None
                if is_other[a]:
                    other_key = near
                    other.append(points[a:b])
                else:
                    own.append(points[a:b])
            yield table(met)
        yield table(found())

    def table(met: list[tuple]) -> pa.RecordBatch:
        columns = zip(*met) if met else [[] for _ in keys]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], keys)

    return run
