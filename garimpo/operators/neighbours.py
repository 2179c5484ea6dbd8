"""Neighbours within a radius, without ever listing the pairs of a dense area.

Points live in k dimensions with straight-line distance (points on the globe as unit
vectors). Both sides are cut into a hierarchy of cells whose side halves from level to level.
Starting from neighbouring cells of the size of the radius, every cell pair is judged by the
bounding boxes of its points:

* wholly outside the radius - dropped;
* wholly inside - the second cell counts as one aggregated row for the first;
* crossing the radius and few points - the points are compared;
* crossing the radius, at most ``BLOCK_POINTS`` a cell - the points of the second cell are sent to the
  first one's block, which folds them leaf by leaf in its task (``blocked``), where that is asked for;
* crossing the radius and more points - replaced by the pairs of its child cells.

The cells come from a pyramid: points are grouped once, into its finest cells, and every coarser
level is folded from the finer one by dropping the last bit of each axis. Areas denser than the
finest level go on below it, where only points of crossing parents are grouped. Points meet the
outcome of all levels in one join.

Where it only matters whether two cells hold a pair within the radius (``touching_cells``), the outermost
points of large cells are tried before any point is sent, and a block ends with the first pair found.

Only pairs that cross the circle are refined, so an area that holds a third of all rows is
split until its cells are small; nothing is capped and the result is exact. Equal locations
are folded to one point with a multiplicity before anything is joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.operators.blocks import BOTH, OTHER, OWN, block_folder, block_toucher, positions
from garimpo.schema import sized_broadcast, stage

COMPARED_PAIRS = 1500
#: Pairs of points of two cells up to which their outermost points are not tried first; the states of other pairs of cells.
FEW_PAIRS = 64
LARGE = ("many", "block", "refine")
#: Points a cell among which its outermost ones are looked for at first.
TRIED_POINTS = 4
#: Rows of a table with a row per cell and few columns up to which it is broadcast.
MOST_CELLS = 300_000
#: Points of a cell that one task may hold (about 200 MB); a pair of such cells is folded there without refining it.
BLOCK_POINTS = 2**20
#: Blocks that there should be at least, and the greatest side of one as a power of the square root of two.
LEAST_BLOCKS, MOST_STEPS = 48, 6
#: Points that a finest cell of the pyramid holds on average, and its most levels.
FINEST_POINTS, MOST_LEVELS = 8, 16
DEEPEST_LEVEL = 48
MARGIN = 1e-9


@dataclass
class Frontier:
    """Outcome of the refinement: per level the inside cell pairs, the pairs to compare, the pairs of blocks."""

    inside: list[tuple[int, DataFrame]]
    compare: list[tuple[int, DataFrame]]
    side: float
    axes: list[str]
    blocks: list[tuple[int, DataFrame]]


def _names(prefix: str, axes: list[str]) -> list[str]:
    return [f"{prefix}_{x}" for x in axes]


def cell_key(axis: str, side: float, level: int) -> Column:
    # scaling by a power of two is exact, so a child key shifted by one is its parent's key
    return F.floor(F.col(axis) / side * float(2**level)).cast("bigint")


def with_cells(points: DataFrame, axes: list[str], side: float, level: int, prefix: str) -> DataFrame:
    keys = zip(_names(prefix, axes), axes)
    return points.withColumns({name: cell_key(x, side, level) for name, x in keys})


def _folded(rows: DataFrame, keys: dict[str, Column], counted: Column, axes: list[str], lo: str, hi: str, payload: dict) -> DataFrame:
    return rows.groupBy(*[k.alias(name) for name, k in keys.items()]).agg(
        counted.alias("points"),
        *[F.min(lo + x).alias(f"lo_{x}") for x in axes],
        *[F.max(hi + x).alias(f"hi_{x}") for x in axes],
        *[f(c).alias(c) for c, f in payload.items()],
    )


class Pyramid:
    """Cells of ``points`` by level: number of points, bounding box and folded payload.

    Level 0 has cells of ``side``; each further level halves it.
    """

    def __init__(self, points: DataFrame, axes: list[str], side: float, payload: dict, finest: int):
        self.points, self.axes, self.side, self.payload = points, axes, side, payload
        self.keys = _names("c", axes)
        top = F.struct(*[cell_key(x, side, 0) for x in axes])
        n, cells = points.agg(F.count("*"), F.approx_count_distinct(top, 0.05)).first()
        # points on a surface: a level quarters a cell
        crowd = max(1.0, n / max(1, cells) / finest)
        self.depth = min(MOST_LEVELS, DEEPEST_LEVEL, math.ceil(math.log2(crowd) / 2))
        self.levels = {self.depth: stage(self._grouped(points, self.depth))}
        for level in range(self.depth - 1, -1, -1):
            finer = self.levels[level + 1]
            keys = {k: F.shiftright(k, 1) for k in self.keys}
            self.levels[level] = stage(_folded(finer, keys, F.sum("points"), axes, "lo_", "hi_", payload))

    def _grouped(self, points: DataFrame, level: int) -> DataFrame:
        keys = {k: cell_key(x, self.side, level) for k, x in zip(self.keys, self.axes)}
        return _folded(points, keys, F.count("*"), self.axes, "", "", self.payload)

    def cells(self, level: int, prefix: str, crossing: DataFrame | None = None) -> DataFrame:
        """The cells of a level, columns behind ``prefix``; below the pyramid those of ``crossing`` parents only."""
        found = self.levels.get(level)
        if found is None:
            parents = crossing.select(_names(prefix, self.axes)).distinct()
            inside = with_cells(self.points, self.axes, self.side, level - 1, prefix).join(
                parents, _names(prefix, self.axes), "left_semi"
            )
            found = self._grouped(inside.select(*self.axes, *self.payload), level)
        new = {c: f"{prefix}_{c.removeprefix('c_') if c in self.keys else c}" for c in found.columns if c not in self.payload}
        return found.withColumnsRenamed(new)


def _met_at_ends(judged: DataFrame, points: DataFrame, axes: list[str], side: float, radius: float) -> DataFrame:
    """``judged`` pairs of level-0 cells; those whose outermost points are within ``radius`` become inside.

    A cell's outermost points are the first and the last along each axis. They decide most pairs of dense cells,
    even when only some ``points`` are given.
    """
    large = F.col("state").isin(*LARGE)
    wanted = judged.where(large)
    keys = _names("c", axes)
    sides = [wanted.select(*[F.col(k).alias(c) for k, c in zip(_names(p, axes), keys)]) for p in "ab"]
    homed = with_cells(points, axes, side, 0, "c").join(sized_broadcast(sides[0].unionByName(sides[1]).distinct()), keys, "left_semi")
    turned = [F.struct(*[F.col(x) for x in [*axes[i:], *axes[:i]]]) for i in range(len(axes))]
    ends = homed.groupBy(*keys).agg(*[f(t).alias(f"e{i}{n}") for i, t in enumerate(turned) for n, f in enumerate((F.min, F.max))])
    every = F.array(*[F.struct(*[F.col(f"e{i}{n}")[x].alias(x) for x in axes]) for i in range(len(axes)) for n in range(2)])
    ends = stage(ends.select(*keys, every.alias("ends")))
    for p in "ab":
        of = ends.withColumnsRenamed({**dict(zip(keys, _names(p, axes))), "ends": f"{p}_ends"})
        judged = judged.join(of, _names(p, axes), "left")

    def close(p: Column, q: Column) -> Column:
        square = F.lit(0.0)
        for x in axes:
            square = square + (p[x] - q[x]) * (p[x] - q[x])
        return F.sqrt(square) <= radius

    met = F.exists("a_ends", lambda p: F.exists("b_ends", lambda q: close(p, q)))
    state = F.when(large & met, "inside").otherwise(F.col("state"))
    return judged.withColumn("state", state).drop("a_ends", "b_ends")


def _between_components(judged: DataFrame, components: DataFrame, axes: list[str]) -> DataFrame:
    """Those of the ``judged`` pairs whose cells belong to different ``components`` (rows of a cell's keys and ``root``)."""
    of = sized_broadcast(components, MOST_CELLS)
    for p in "ab":
        names = dict(zip(_names("c", axes), _names(p, axes)))
        judged = judged.join(of.withColumnsRenamed({**names, "root": f"{p}_root"}), list(names.values()))
    return judged.where((F.col("a_root") != F.col("b_root")) & (F.col("state") != "inside")).drop("a_root", "b_root")


def frontier(
    left: DataFrame,
    right: DataFrame,
    axes: list[str],
    radius: float,
    side: float | None = None,
    payload: dict | None = None,
    ordered: bool = True,
    same_points: bool = False,
    any_pair: bool = False,
    blocked: bool = False,
    connected: Callable[[DataFrame], DataFrame] | None = None,
) -> Frontier:
    """Refine cell pairs of ``left`` and ``right`` until none is both crossing and large.

    ``payload`` maps columns of ``right`` to the aggregate that folds them per cell.
    ``same_points``: both sides hold the same points, so one pyramid serves both.
    ``ordered=False`` keeps one of the two orders of a pair and no pair of a cell with itself.
    ``any_pair``: it only matters which cells of level 0 hold a pair of points within the radius, so
    all other pairs of their descendants are dropped once one is wholly inside or its outermost points are near.
    ``blocked``: crossing pairs of cells of at most ``BLOCK_POINTS`` end as pairs of blocks.
    ``connected``, with ``any_pair``: given the pairs of cells of level 0 known to touch it returns the component of each cell;
    pairs of cells of one component are then dropped, those known to touch as well.
    """
    side = side or radius * (1 + MARGIN)
    reach = math.ceil(radius / side - 1e-12)
    payload = payload or {}
    a_keys, b_keys = _names("a", axes), _names("b", axes)

    # every cell meets the cells at most ``reach`` steps away on each axis
    finest = max(FINEST_POINTS, BLOCK_POINTS // 4) if blocked else FINEST_POINTS
    of_right = Pyramid(right, axes, side, payload, finest)
    of_left = of_right if same_points else Pyramid(left, axes, side, {}, finest)
    a = of_left.cells(0, "a").drop(*payload)
    for x in axes:
        a = a.withColumn(f"d_{x}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    if not ordered:
        zero = F.struct(*[F.lit(0).alias(f"d_{x}") for x in axes])
        a = a.where(F.struct(*[F.col(f"d_{x}") for x in axes]) > zero)
    a = a.withColumns({b: F.col(k) + F.col(f"d_{x}") for b, k, x in zip(b_keys, a_keys, axes)})
    pairs = a.join(of_right.cells(0, "b"), b_keys)

    result = Frontier([], [], side, axes, [])
    box = [f"a_{end}_{x}" for end in ("lo", "hi") for x in axes] if blocked else []
    level = 0
    while True:
        gap, span = F.lit(0.0), F.lit(0.0)
        for x in axes:
            a_lo, a_hi = F.col(f"a_lo_{x}"), F.col(f"a_hi_{x}")
            b_lo, b_hi = F.col(f"b_lo_{x}"), F.col(f"b_hi_{x}")
            apart, across = F.greatest(b_lo - a_hi, a_lo - b_hi, F.lit(0.0)), F.greatest(b_hi - a_lo, a_hi - b_lo)
            gap = gap + apart * apart
            span = span + across * across
        square = radius * radius
        few = (F.col("a_points") * F.col("b_points") <= COMPARED_PAIRS) | (
            F.lit(level >= DEEPEST_LEVEL)
        )
        state = (
            F.when(gap > square * (1 + MARGIN), "outside")
            .when(span < square * (1 - MARGIN), "inside")
            .when(few & F.lit(any_pair and not level) & (F.col("a_points") * F.col("b_points") > FEW_PAIRS), "many")
            .when(few, "compare")
            .when(F.lit(blocked) & (F.greatest("a_points", "b_points") <= BLOCK_POINTS), "block")
            .otherwise("refine")
        )
        judged = stage(
            pairs.withColumn("state", state)
            .where(F.col("state") != "outside")
            .select("state", *a_keys, *b_keys, *payload, *box)
        )
        present = {r.state for r in judged.select("state").distinct().collect()}
        if connected and not level:
            # a few points of each cell connect most of them; which ones are tried has no part in the result
            m = max(1, int(of_left.levels[0].agg(F.avg("points")).first()[0] or 0) // TRIED_POINTS)
            if present & set(LARGE):
                some = left.where(F.pmod(F.xxhash64(*axes), F.lit(m)) == 0) if m > 1 else left
                judged = stage(_met_at_ends(judged, some, axes, side, radius))
            known = judged.where(F.col("state") == "inside").select(*a_keys, *b_keys)
            judged = stage(_between_components(judged, connected(known), axes))
            present = {r.state for r in judged.select("state").distinct().collect()}
        if any_pair and not level and present & set(LARGE):
            judged = _met_at_ends(judged, left, axes, side, radius)
            judged = stage(judged.withColumn("state", F.when(F.col("state") == "many", "compare").otherwise(F.col("state"))))
            present = {r.state for r in judged.select("state").distinct().collect()}
        if any_pair and level and "inside" in present:
            roots = [F.shiftright(k, level) for k in a_keys + b_keys]
            known = [f"known_{k}" for k in a_keys + b_keys]
            met = judged.where(F.col("state") == "inside").select(*[r.alias(k) for r, k in zip(roots, known)]).distinct()
            same = [r == F.col(k) for r, k in zip(roots, known)]
            judged = stage(
                judged.where(F.col("state") != "inside").join(met, same, "left_anti")
                .unionByName(
                    met.select(F.lit("inside").alias("state"), *[F.shiftleft(k, level).alias(k.removeprefix("known_")) for k in known]),
                    allowMissingColumns=True,
                )
            )
            present = {r.state for r in judged.select("state").distinct().collect()}
        if "inside" in present:
            result.inside.append((level, judged.where(F.col("state") == "inside").drop("state", *box)))
        if "compare" in present:
            result.compare.append(
                (level, judged.where(F.col("state") == "compare").select(*a_keys, *b_keys))
            )
        if "block" in present:
            result.blocks.append((level, judged.where(F.col("state") == "block").select(*a_keys, *b_keys, *box)))
        if "refine" not in present:
            return result
        level += 1
        crossing = judged.where(F.col("state") == "refine").select(*a_keys, *b_keys)
        child_a = of_left.cells(level, "a", crossing).drop(*payload)
        child_b = of_right.cells(level, "b", crossing)
        pairs = _children(_children(crossing, child_a, a_keys), child_b, b_keys)


def _children(pairs: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the cells named by ``keys`` with their (at most 2^k) children."""
    parents = [f"p_{k}" for k in keys]
    cells = cells.withColumns({p: F.shiftright(k, 1) for p, k in zip(parents, keys)})
    pairs = pairs.withColumnsRenamed(dict(zip(keys, parents)))
    return pairs.join(cells, parents).drop(*parents)


def _of_levels(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    out = None
    for level, rows in parts:
        rows = rows.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


def _at_levels(points: DataFrame, f: Frontier, levels: list[int], prefix: str) -> DataFrame:
    """A row per point and level, with the point's cell: ``level`` and the cell's keys."""
    deepest = max(levels)
    cells = with_cells(points, f.axes, f.side, deepest, prefix).withColumn(
        "level", F.explode(F.array(*[F.lit(k) for k in levels]))
    )
    return cells.withColumns({k: F.expr(f"shiftright({k}, {deepest} - level)") for k in _names(prefix, f.axes)})


def compared_points(
    f: Frontier, left: DataFrame, right: DataFrame, near: Column, columns: list[str]
) -> DataFrame | None:
    """Point pairs of the cell pairs left to compare that satisfy ``near``; ``level`` tells the cells' level.

    ``left`` and ``right`` share no column names apart from the axes, which are called ``l_*``
    and ``r_*`` inside ``near``.
    """
    if not f.compare:
        return None
    levels = sorted({level for level, _ in f.compare})
    a = _at_levels(left, f, levels, "a").withColumnsRenamed({x: f"l_{x}" for x in f.axes})
    b = _at_levels(right, f, levels, "b").withColumnsRenamed({x: f"r_{x}" for x in f.axes})
    return (
        _of_levels(f.compare).join(a, ["level", *_names("a", f.axes)]).join(b, ["level", *_names("b", f.axes)])
        .where(near).select(*columns)
    )


def block_side(points: DataFrame, axes: list[str], side: float) -> float:
    """``side`` times up to 8, as long as a cell holds ``BLOCK_POINTS / 4`` points and there is work for many tasks.

    The larger a block against the radius, the fewer blocks a point is sent to.
    """
    sides = [side * 2 ** (j / 2) for j in range(MOST_STEPS + 1)]
    tops = [F.struct(*[cell_key(x, s, 0) for x in axes]) for s in sides]
    n, *cells = points.agg(F.count("*"), *[F.approx_count_distinct(top, 0.05) for top in tops]).first()
    fit = [s for s, found in zip(sides, cells) if n <= found * BLOCK_POINTS / 4 and found >= LEAST_BLOCKS]
    return max(fit, default=side)


def _block_rows(f: Frontier, left: DataFrame, right: DataFrame, radius: float, blocks_a_task: int = 8) -> DataFrame:
    """The points of every block, each block in one task: its own, then those that may be near one, cell by cell."""
    levels = sorted({level for level, _ in f.blocks})
    a_keys, b_keys = _names("a", f.axes), _names("b", f.axes)
    block = ["level", *a_keys]
    pairs = _of_levels(f.blocks)
    homes = stage(pairs.select(*block).distinct())
    mine = _at_levels(left, f, levels, "a").join(homes, block, "left_semi").withColumn("other", F.lit(False))
    gap = F.lit(0.0)
    for x in f.axes:
        apart = F.greatest(F.col(f"a_lo_{x}") - F.col(x), F.col(x) - F.col(f"a_hi_{x}"), F.lit(0.0))
        gap = gap + apart * apart
    theirs = (
        _at_levels(right, f, levels, "b").join(pairs, ["level", *b_keys])
        .where(gap <= radius * radius * (1 + MARGIN)).withColumn("other", F.lit(True))
    )
    rows = mine.unionByName(theirs, allowMissingColumns=True)
    # little data but much work: a task for every few blocks
    session = left.sparkSession
    tasks = min(4096, max(int(session.conf.get("spark.sql.shuffle.partitions")), homes.count() // blocks_a_task))
    return rows.repartition(tasks, *block).sortWithinPartitions(*block, "other", *b_keys)


def folded_blocks(
    f: Frontier, left: DataFrame, right: DataFrame, radius: float, near: Column, payload: dict, same_points: bool = False,
    place: tuple[list[str], Callable] | None = None,
) -> DataFrame | None:
    """Fold the payload of the right points of the block pairs for each left point: rows ``(id, *payload)``.

    A left point goes to its block once and a right point once for each block its cell crosses, so
    what is shuffled is a fixed multiple of the points. A task reads one block after another, sorted:
    the block's own points first, then the others as a stream. Distances within ``MARGIN`` of
    the radius are left to ``near``. With ``same_points`` a point is not sent to its own block again, and with
    ``place`` its columns are sent instead of its position: see ``neighbour_aggregate``.
    """
    if not f.blocks:
        return None
    levels = sorted({level for level, _ in f.blocks})
    a_keys, b_keys = _names("a", f.axes), _names("b", f.axes)
    cell = ["level", *a_keys]
    own = [c for c in left.columns if c not in right.columns and c not in f.axes]
    more = [c for c in right.columns if c not in f.axes and c not in payload]
    sent = more if place else [*f.axes, *more]
    pairs = _of_levels(f.blocks)
    itself = F.lit(same_points)
    for a, b in zip(a_keys, b_keys):
        itself = itself & (F.col(a) == F.col(b))
    # few: a row per block; the number is written, hence fixed
    homes = stage(pairs.groupBy(*cell).agg(F.max(itself).alias("both")).withColumn("block", F.monotonically_increasing_id()))
    other_pairs = pairs.where(~itself).join(homes.drop("both"), cell).drop(*a_keys)
    gap = F.lit(0.0)
    for x in f.axes:
        apart = F.greatest(F.col(f"a_lo_{x}") - F.col(x), F.col(x) - F.col(f"a_hi_{x}"), F.lit(0.0))
        gap = gap + apart * apart
    mine = _at_levels(left, f, levels, "a").join(sized_broadcast(homes), cell).withColumn("side", F.when(F.col("both"), F.lit(BOTH)).otherwise(F.lit(OWN)))
    theirs = (
        _at_levels(right, f, levels, "b").join(sized_broadcast(other_pairs), ["level", *b_keys])
        .where(gap <= radius * radius * (1 + MARGIN)).withColumn("side", F.lit(OTHER))
    )
    columns = ["block", "side", *own, *sent, *payload]
    rows = mine.select(*[c for c in columns if c in mine.columns]).unionByName(
        theirs.select(*[c for c in columns if c in theirs.columns]), allowMissingColumns=True
    )
    # little data but much work: enough tasks that few get two blocks
    tasks = min(4096, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * homes.count()))
    rows = rows.repartition(tasks, "block").sortWithinPartitions("block", "side").select(*columns)
    kinds = {**dict(right.dtypes), **dict(left.dtypes)}
    ends = _names("l", f.axes), _names("r", f.axes)
    kept = {**{c: kinds[c] for c in own}, **{c: kinds[c] for c in more}, **dict.fromkeys([*ends[0], *ends[1]], "double")}
    kept |= {**{c: kinds[c] for c in payload}, "sure": "boolean"}
    folds = {c: "min" if fold is F.min else "sum" for c, fold in payload.items()}
    axes = f.axes
    at = (lambda rows: place[1](*[rows.column(c).to_numpy() for c in place[0]])) if place else (lambda rows: positions(rows, axes))
    fold = block_folder(at, own, more, folds, ends, radius, 2 * MARGIN)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kept.items())
    return rows.mapInArrow(fold, schema).where(F.col("sure") | near).select("id", *payload)


def near_axes(axes: list[str], radius: float) -> Column:
    """Straight-line distance of ``l_*`` and ``r_*`` at most ``radius``."""
    square = F.lit(0.0)
    for x in axes:
        square = square + (F.col(f"l_{x}") - F.col(f"r_{x}")) * (F.col(f"l_{x}") - F.col(f"r_{x}"))
    return F.sqrt(square) <= radius


def neighbour_aggregate(
    left: DataFrame,
    right: DataFrame,
    axes: list[str],
    radius: float,
    payload: dict,
    near: Column | None = None,
    same_points: bool = False,
    place: tuple[list[str], Callable] | None = None,
) -> DataFrame:
    """Fold the ``payload`` of all right points within ``radius`` of each left point.

    ``left`` has ``id`` and the axes; ``right`` has the axes and the payload columns, numbers that
    are never null, folded by ``F.sum`` or (integers) ``F.min``. ``near`` may differ from the straight-line
    distance only within ``MARGIN`` of the radius. Left points without a neighbour do not appear.
    ``same_points``: ``left`` is ``right`` with ``id``. ``place`` then may name columns of ``right`` and a function of
    their arrays that gives the axes to about the last bit, so that these columns travel and not the axes.
    """
    side = block_side(right, axes, radius * (1 + MARGIN))
    f = frontier(left, right, axes, radius, side, payload, same_points=same_points, blocked=True)
    columns = ["id", *payload]
    near = near_axes(axes, radius) if near is None else near
    own = left.select("id", *axes) if same_points else left
    parts = compared_points(f, own, right, near, columns)
    blocks = folded_blocks(f, left, right, radius, near, payload, same_points, place)
    if blocks is not None:
        parts = blocks if parts is None else parts.unionByName(blocks)
    if f.inside:
        keys = ["level", *_names("a", axes)]
        folded = _of_levels(f.inside).groupBy(*keys).agg(*[fold(c).alias(c) for c, fold in payload.items()])
        # one row per cell against its points: broadcast if small, else adaptive skew join
        points = _at_levels(own, f, sorted({level for level, _ in f.inside}), "a")
        cells = points.join(sized_broadcast(folded), keys).select(*columns)
        parts = cells if parts is None else parts.unionByName(cells)
    if parts is None:
        kinds = {**dict(right.dtypes), **dict(left.dtypes)}
        parts = left.sparkSession.createDataFrame([], ", ".join(f"{c} {kinds[c]}" for c in columns))
    return parts.groupBy("id").agg(*[fold(c).alias(c) for c, fold in payload.items()])


def around(points: DataFrame, others: DataFrame, axes: list[str], radius: float) -> DataFrame:
    """Those of ``points`` that may lie within ``radius`` of one of ``others``, judged by cells."""
    keys, side = _names("c", axes), radius * (1 + MARGIN)
    cells = with_cells(others, axes, side, 0, "c").select(*keys).distinct()
    for k in keys:
        cells = cells.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
    return with_cells(points, axes, side, 0, "c").join(cells.distinct(), keys, "left_semi").drop(*keys)


def touching_cells(
    points: DataFrame, axes: list[str], radius: float, side: float, connected: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Pairs of level-0 cells that hold two points within ``radius`` of each other.

    Pairs that neither their boxes nor their outermost points settle are searched for one pair of points, in
    the block of the first cell. ``connected`` (see ``frontier``) leaves out pairs of cells that others connect already.
    """
    f = frontier(
        points, points, axes, radius, side=side, ordered=False, same_points=True, any_pair=True, blocked=True, connected=connected
    )
    keys = _names("a", axes) + _names("b", axes)
    out = points.sparkSession.createDataFrame([], ", ".join(f"{k} bigint" for k in keys))

    def roots(pairs: DataFrame) -> DataFrame:
        return pairs.select(*[F.expr(f"shiftright({k}, level)").alias(k) for k in keys])

    if f.inside:
        out = out.unionByName(roots(_of_levels(f.inside)))
    near = near_axes(axes, radius)
    found = compared_points(f, points.select(*axes), points.select(*axes), near, ["level", *keys])
    if found is not None:
        out = out.unionByName(roots(found))
    if f.blocks:
        rows = _block_rows(f, points.select(*axes), points.select(*axes), radius, 64)
        find = block_toucher(["level", *_names("a", axes)], _names("b", axes), axes, radius, 2 * MARGIN)
        schema = ", ".join(f"{k} bigint" for k in ["level", *keys])
        met = rows.select("level", *keys, "other", *axes).mapInArrow(find, schema)
        out = out.unionByName(roots(met.withColumn("level", F.col("level").cast("int"))))
    return out.distinct()
