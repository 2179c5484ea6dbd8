"""Sums of ``weight / distance^power`` over all places, in time about proportional to their number.

Places live in a quadtree. A cell seen from at least its own side away acts through ``NODES`` x ``NODES``
nodes: its weights are spread over them by polynomial interpolation (Chebyshev nodes), and likewise what far cells do
to a cell is found at its nodes and interpolated from there. Pairs of places in cells that touch are computed one by
one. Every pair of places counts; the interpolation is wrong by about ``4.2^-NODES`` of the closest far pair, less than what
adding as many doubles loses.

The upper tree, with leaves of at most ``BLOCK_PLACES`` places, is held by the driver; a leaf is a block, whose task
receives the places of the blocks around it, and the nodes of all other cells by broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.schema import sized_broadcast

NODES = 20
#: Places of a block, of a leaf inside a task, products of two cells that are not worth any nodes.
BLOCK_PLACES, LEAF_PLACES, FEW_PAIRS = 65_536, 1024, 2**16
#: Levels of the upper tree, of one round of counting, of the tree of a task.
DEPTH, ROUND, DEEPEST = 24, 4, 40
TILE = (64, 1024)

Cell = tuple[int, int, int]  # level, column, row


# --- interpolation -------------------------------------------------------------------------

_ORDERS = np.arange(NODES)
POINTS = np.cos((2 * _ORDERS + 1) * math.pi / (2 * NODES))
_BASIS = np.cos(_ORDERS[:, None] * np.arccos(POINTS)) * np.where(_ORDERS == 0, 1, 2)[:, None] / NODES


def shares(x: np.ndarray) -> np.ndarray:
    """Values at ``x`` in [-1, 1] of the polynomials that are one at one node and zero at the others."""
    return np.cos(np.arccos(np.clip(x, -1, 1))[:, None] * _ORDERS) @ _BASIS


#: Shares of the nodes of the lower and upper half of an interval.
HALVES = [shares((POINTS - 1) / 2), shares((POINTS + 1) / 2)]


def spread(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights (a row per place) spread over the nodes of a square, places in units of half its side around its centre."""
    across, up = shares(x), shares(y)
    return np.stack([across.T @ (up * w[:, None]) for w in weights.T], axis=2)


def gathered(x: np.ndarray, y: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Values at places of fields known at the nodes of their square."""
    across, up = shares(x), shares(y)
    return np.stack([((across @ field[:, :, s]) * up).sum(axis=1) for s in range(field.shape[2])], axis=1)


def to_parent(nodes: np.ndarray, column: int, row: int) -> np.ndarray:
    return np.einsum("ka,klw,lb->abw", HALVES[column], nodes, HALVES[row], optimize=True)


def to_child(field: np.ndarray, column: int, row: int) -> np.ndarray:
    return np.einsum("ka,abs,lb->kls", HALVES[column], field, HALVES[row], optimize=True)


def node_places(x: float, y: float, half: float) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(x + half * POINTS, NODES), np.tile(y + half * POINTS, NODES)


# --- kernels -------------------------------------------------------------------------------

def pulled(x: np.ndarray, y: np.ndarray, from_x: np.ndarray, from_y: np.ndarray, weights: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Per place the sums over others of ``weights`` (a column per sum) over ``distance^powers``; not finite: zero."""
    out = np.zeros((len(x), len(powers)))
    which = {p: np.flatnonzero(powers == p) for p in set(powers.tolist())}
    spare = np.empty(TILE), np.empty(TILE)
    with np.errstate(all="ignore"):
        for i in range(0, len(x), TILE[0]):
            rows = slice(i, min(i + TILE[0], len(x)))
            for j in range(0, len(from_x), TILE[1]):
                columns = slice(j, min(j + TILE[1], len(from_x)))
                first, second = (s[: rows.stop - i, : columns.stop - j] for s in spare)
                np.subtract(x[rows, None], from_x[columns], out=first)
                np.multiply(first, first, out=first)
                np.subtract(y[rows, None], from_y[columns], out=second)
                np.multiply(second, second, out=second)
                np.add(first, second, out=first)
                np.divide(1.0, first, out=second)
                np.sqrt(second, out=first)
                for p, at in which.items():
                    kernel = first if p == 1 else second if p == 2 else first**p
                    found = kernel @ weights[columns][:, at]
                    if not np.isfinite(found).all():
                        found = np.where(np.isfinite(kernel), kernel, 0.0) @ weights[columns][:, at]
                    out[rows, at[0] : at[-1] + 1] += found
    return out


# --- the tree of a task --------------------------------------------------------------------

class Square:
    """A cell of a task's tree: centre, half side, the places ``first`` to ``last`` of its tree."""

    def __init__(self, x: float, y: float, half: float, first: int, last: int):
        self.x, self.y, self.half, self.first, self.last = x, y, half, first, last
        self.children: list[tuple[int, int, Square]] = []
        self.nodes = self.field = None

    @property
    def n(self) -> int:
        return self.last - self.first


class Places:
    """Places of one block, sorted into a quadtree, with their weights and, for targets, what was found."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, centre: tuple[float, float], half: float):
        self.order = np.arange(len(x))
        self.x, self.y = x, y
        self.root = Square(*centre, half, 0, len(x))
        self._split(self.root, 0)
        self.x, self.y, self.weights = x[self.order], y[self.order], weights[self.order]

    def _split(self, at: Square, depth: int):
        if at.n <= LEAF_PLACES or depth == DEEPEST:
            return
        some = self.order[at.first : at.last]
        code = (self.x[some] >= at.x) * 2 + (self.y[some] >= at.y)
        self.order[at.first : at.last] = some[np.argsort(code, kind="stable")]
        ends = at.first + np.cumsum([0, *np.bincount(code, minlength=4)])
        for k in range(4):
            if ends[k] < ends[k + 1]:
                column, row, half = k // 2, k % 2, at.half / 2
                child = Square(at.x + (2 * column - 1) * half, at.y + (2 * row - 1) * half, half, int(ends[k]), int(ends[k + 1]))
                at.children.append((column, row, child))
                self._split(child, depth + 1)

    def local(self, at: Square) -> tuple[np.ndarray, np.ndarray]:
        some = slice(at.first, at.last)
        return (self.x[some] - at.x) / at.half, (self.y[some] - at.y) / at.half

    def nodes(self, at: Square) -> np.ndarray:
        if at.nodes is None:
            if at.children:
                at.nodes = sum(to_parent(self.nodes(child), column, row) for column, row, child in at.children)
            else:
                at.nodes = spread(*self.local(at), self.weights[at.first : at.last])
        return at.nodes

    def sources(self, at: Square) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell as weighted places: its own or its nodes, whichever are fewer."""
        if at.n <= NODES * NODES:
            some = slice(at.first, at.last)
            return self.x[some], self.y[some], self.weights[some]
        return *node_places(at.x, at.y, at.half), self.nodes(at).reshape(NODES * NODES, -1)


def apart(a: tuple[float, float, float], b: tuple[float, float, float]) -> bool:
    """Whether squares (centre and half side) are as far from each other as the larger one's side."""
    gaps = [max(abs(a[k] - b[k]) - a[2] - b[2], 0.0) for k in (0, 1)]
    return math.hypot(*gaps) >= 2 * max(a[2], b[2]) * (1 - 1e-9)


def fold_near(mine: Places, out: np.ndarray, theirs: Places, columns: np.ndarray, powers: np.ndarray):
    """Add what the places of ``theirs`` do to those of ``mine``: to ``out`` or to the fields of cells."""

    def direct(a: Square, of: tuple):
        some = slice(a.first, a.last)
        out[some] += pulled(mine.x[some], mine.y[some], *of[:2], of[2][:, columns], powers)

    def whole(c: Square) -> tuple:
        some = slice(c.first, c.last)
        return theirs.x[some], theirs.y[some], theirs.weights[some]

    stack = [(mine.root, theirs.root)]
    while stack:
        a, c = stack.pop()
        if a.n * c.n <= FEW_PAIRS:
            direct(a, whole(c))
        elif apart((a.x, a.y, a.half), (c.x, c.y, c.half)):
            if a.n <= NODES * NODES:
                direct(a, theirs.sources(c))
            else:
                x, y, w = theirs.sources(c)
                found = pulled(*node_places(a.x, a.y, a.half), x, y, w[:, columns], powers).reshape(NODES, NODES, -1)
                a.field = found if a.field is None else a.field + found
        elif not a.children and not c.children:
            direct(a, whole(c))
        elif c.children and (c.half >= a.half or not a.children):
            stack += [(a, child) for _, _, child in c.children]
        else:
            stack += [(child, c) for _, _, child in a.children]


def push_down(mine: Places, out: np.ndarray):
    """Carry the fields of cells to the places."""
    stack = [mine.root]
    while stack:
        a = stack.pop()
        if a.field is not None and not a.children:
            out[a.first : a.last] += gathered(*mine.local(a), a.field)
        for column, row, child in a.children:
            if a.field is not None:
                passed = to_child(a.field, column, row)
                child.field = passed if child.field is None else child.field + passed
            stack.append(child)


# --- the upper tree ------------------------------------------------------------------------

class Upper:
    """Quadtree over the square from ``(x, y)`` whose leaves hold at most ``BLOCK_PLACES`` places.

    Leaves that touch differ by at most one level, so that few blocks are near a block.
    """

    def __init__(self, places: DataFrame):
        x0, x1, y0, y1 = places.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
        self.x, self.y = x0, y0
        self.side = max(x1 - x0, y1 - y0) * (1 + 1e-9) or 1.0
        cells = self._balanced(self._crowded(places))
        self.children: dict[Cell, list[Cell]] = {}
        for level, i, j in cells - {(0, 0, 0)}:
            self.children.setdefault((level - 1, i >> 1, j >> 1), []).append((level, i, j))
        leaves = [c for c in cells if c not in self.children]
        # in the order of the codes, in which a leaf is a range
        self.leaves = sorted(leaves, key=lambda c: self._code(*[np.array([k << DEPTH - c[0]]) for k in c[1:]])[0])
        self.starts = np.array([self._code(*[np.array([k << DEPTH - c[0]]) for k in c[1:]])[0] for c in self.leaves])

    def _crowded(self, places: DataFrame) -> set[Cell]:
        """Cells with more places than a block may hold, found ``ROUND`` levels at a time."""
        keys = [
            F.least(F.floor((F.col(c) - low) / self.side * float(2**DEPTH)), F.lit(2**DEPTH - 1)).cast("bigint").alias(k)
            for k, c, low in (("i", "lon", self.x), ("j", "lat", self.y))
        ]
        at = places.select(*keys)
        crowded: set[Cell] = set()
        level, within = 0, at
        while level < DEPTH:
            level = min(level + ROUND, DEPTH)
            shift = DEPTH - level
            # per crowded cell of the round before at most 4^ROUND rows, and those are few
            counts = within.groupBy(F.shiftright("i", shift).alias("i"), F.shiftright("j", shift).alias("j")).count().collect()
            n = {(r.i, r.j): r["count"] for r in counts}
            last = [c for c, m in n.items() if m > BLOCK_PLACES]
            for up in range(level, level - ROUND - 1, -1):
                crowded |= {(up, i, j) for (i, j), m in n.items() if m > BLOCK_PLACES}
                folded: dict = {}
                for (i, j), m in n.items():
                    folded[i >> 1, j >> 1] = folded.get((i >> 1, j >> 1), 0) + m
                n = folded
                if not up:
                    break
            if not last:
                break
            named = places.sparkSession.createDataFrame(last, "ci bigint, cj bigint")
            within = at.join(
                F.broadcast(named), (F.shiftright("i", shift) == F.col("ci")) & (F.shiftright("j", shift) == F.col("cj")), "left_semi"
            )
        return {c for c in crowded if 0 <= c[0] < DEPTH}

    @staticmethod
    def _balanced(crowded: set[Cell]) -> set[Cell]:
        cells: set[Cell] = {(0, 0, 0)}

        def split(level: int, i: int, j: int):
            if (level + 1, 2 * i, 2 * j) not in cells:
                if level:
                    split(level - 1, i >> 1, j >> 1)
                cells.update((level + 1, 2 * i + a, 2 * j + b) for a in (0, 1) for b in (0, 1))

        for c in crowded:
            split(*c)
        for level in range(max(c[0] for c in cells), 1, -1):
            for i, j in {(i >> 1, j >> 1) for at, i, j in cells if at == level}:
                for a in (i - 1, i, i + 1):
                    for b in (j - 1, j, j + 1):
                        if 0 <= min(a, b) and max(a, b) < 2 ** (level - 1):
                            split(level - 2, a >> 1, b >> 1)
        return cells

    @staticmethod
    def _code(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        code = np.zeros(len(i), np.int64)
        for bit in range(DEPTH):
            code |= (i >> bit & 1) << 2 * bit + 1 | (j >> bit & 1) << 2 * bit
        return code

    def square(self, cell: Cell) -> tuple[float, float, float]:
        half = self.side / 2 ** (cell[0] + 1)
        return self.x + (2 * cell[1] + 1) * half, self.y + (2 * cell[2] + 1) * half, half

    def block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of the leaf of each place."""
        i, j = (
            np.minimum(np.floor((v - low) / self.side * 2**DEPTH), 2**DEPTH - 1).astype(np.int64)
            for v, low in ((x, self.x), (y, self.y))
        )
        return np.searchsorted(self.starts, self._code(i, j), "right") - 1

    def around(self, leaf: Cell) -> tuple[list[Cell], list[Cell]]:
        """The leaves near a leaf, itself included, and the cells that cover all the rest."""
        near, far, stack, here = [], [], [(0, 0, 0)], self.square(leaf)
        while stack:
            c = stack.pop()
            if apart(here, self.square(c)):
                far.append(c)
            elif c in self.children:
                stack += self.children[c]
            else:
                near.append(c)
        return near, far

    def all_nodes(self, of_leaves: dict[int, np.ndarray]) -> dict[Cell, np.ndarray]:
        """Nodes of every cell that holds places, from those of the leaves."""
        found = {self.leaves[b]: nodes for b, nodes in of_leaves.items()}
        for cell in sorted(self.children, reverse=True):  # finer levels first
            parts = [to_parent(found[c], c[1] & 1, c[2] & 1) for c in self.children[cell] if c in found]
            if parts:
                found[cell] = sum(parts)
        return found


def _by_group(batches, key: str):
    """Tables of the rows with equal ``key``, from batches sorted by it."""
    at, parts = None, []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        keys = rows.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != at and parts:
                yield at, pa.concat_tables(parts).combine_chunks()
                parts = []
            at = keys[a]
            parts.append(rows.slice(a, b - a))
    if parts:
        yield at, pa.concat_tables(parts).combine_chunks()


def far_sums(places: DataFrame, sums: dict[str, tuple[str, int]]) -> DataFrame:
    """Per place the ``sums`` (name: weight column, power) over all other places: rows ``(lat, lon, *sums)``.

    ``places`` is a written table of distinct, finite ``lat`` and ``lon`` with the weight columns.
    """
    spark = places.sparkSession
    upper = Upper(places)
    names = sorted({w for w, _ in sums.values()})
    # sums of one power side by side
    ordered = sorted(sums, key=lambda s: sums[s][1])
    columns = np.array([names.index(sums[s][0]) for s in ordered])
    powers = np.array([sums[s][1] for s in ordered])
    kinds = ", ".join(f"`{c}` double" for c in ["lat", "lon", *names])

    def with_block(batches):
        for batch in batches:
            block = upper.block(batch.column("lon").to_numpy(), batch.column("lat").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], [*batch.schema.names, "block"])

    blocked = places.select("lat", "lon", *names).mapInArrow(with_block, kinds + ", block bigint")
    tasks = min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * len(upper.leaves)))

    def arrays(rows: pa.Table) -> tuple:
        weights = np.column_stack([rows.column(w).to_numpy() for w in names])
        return rows.column("lon").to_numpy(), rows.column("lat").to_numpy(), weights

    def spread_block(batches):
        for block, rows in _by_group(batches, "block"):
            (x, y, half), (lon, lat, weights) = upper.square(upper.leaves[block]), arrays(rows)
            nodes = spread((lon - x) / half, (lat - y) / half, weights)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "nodes": pa.array([nodes.tobytes()], pa.binary())})

    # a row per block: its nodes
    found = blocked.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(spread_block, "block bigint, nodes binary").collect()
    shape = (NODES, NODES, len(names))
    nodes = upper.all_nodes({r.block: np.frombuffer(bytes(r.nodes)).reshape(shape) for r in found})
    number = {c: b for b, c in enumerate(upper.leaves)}
    holding, pairs, far = {r.block for r in found}, [], {}
    for b in sorted(holding):
        near, others = upper.around(upper.leaves[b])
        far[b] = [c for c in others if c in nodes]
        pairs += [(number[c], b) for c in near if number[c] in holding]
    shared = spark.sparkContext.broadcast((nodes, far))

    def fold(batches):
        nodes_, far_ = shared.value
        for target, rows in _by_group(batches, "target"):
            of = rows.column("block").to_numpy()
            groups = {b: arrays(rows.take(pa.array(np.flatnonzero(of == b)))) for b in np.unique(of).tolist()}
            squares = {b: upper.square(upper.leaves[b]) for b in groups}
            trees = {b: Places(*groups[b], squares[b][:2], squares[b][2]) for b in groups}
            mine, here = trees[target], squares[target]
            out = np.zeros((len(mine.x), len(powers)))
            if far_[target]:
                at = node_places(*here) if len(mine.x) > NODES * NODES else (mine.x, mine.y)
                field = np.zeros((len(at[0]), len(powers)))
                for c in far_[target]:
                    weights = nodes_[c].reshape(NODES * NODES, -1)[:, columns]
                    field += pulled(*at, *node_places(*upper.square(c)), weights, powers)
                if len(mine.x) > NODES * NODES:
                    mine.root.field = field.reshape(NODES, NODES, -1)
                else:
                    out += field
            for theirs in trees.values():
                fold_near(mine, out, theirs, columns, powers)
            push_down(mine, out)
            result = {"lat": pa.array(mine.y), "lon": pa.array(mine.x)}
            yield from pa.table(result | {s: pa.array(out[:, k]) for k, s in enumerate(ordered)}).to_batches(max_chunksize=65_536)

    to = sized_broadcast(spark.createDataFrame(pairs, "block bigint, target bigint"))
    # a block's places go to the blocks near it
    rows = blocked.join(to, "block").repartition(tasks, "target").sortWithinPartitions("target")
    schema = "lat double, lon double, " + ", ".join(f"`{s}` double" for s in ordered)
    return rows.mapInArrow(fold, schema).select("lat", "lon", *sums)
