"""Clustering: K-means with elbow, DBSCAN, principal components, cluster profiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.geo import unit_vector
from garimpo.functions.numbers import mean, total
from garimpo.operators.geo import AXES, chord, placed
from garimpo.operators.neighbours import MOST_CELLS, around, neighbour_aggregate, touching_cells, with_cells
from garimpo.operators.rank import global_rank
from garimpo.schema import (
    AMOUNT, CLUSTER_EPS_KM, CLUSTER_MIN_SAMPLES, COMPANY, KEY, LAT, LON, STATE, SUBSTANCE,
    lowest_hashes, scalar_of, sharing, sized_broadcast, stage,
)

FEATURES = (AMOUNT, LON, LAT)
NOISE = -1
#: Radii that the search for one tries at a time.
TRIED = 4


# --- features ------------------------------------------------------------------------------

def usable_features(df: DataFrame, features) -> list[str]:
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    types = dict(df.dtypes)
    usable = [f for f in features if types.get(f, "").startswith(numeric)]
    if not usable:
        raise ValueError("no usable numeric feature column")
    return usable


def scaled(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Complete rows with ``z_<feature>``: (x - mean) / population deviation, 1 if that is zero."""
    features = usable_features(df, features)
    rows = df.na.drop(subset=features)
    # one row, written: else every job on the scaled rows would read all of them twice
    m = scalar_of(
        stage(
            rows.agg(
                *[F.avg(f).alias(f"m_{f}") for f in features],
                *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
            )
        )
    )
    return rows.withColumns(
        {
            f"z_{f}": (F.col(f) - m[f"m_{f}"])
            / F.when(m[f"s_{f}"] > 0, m[f"s_{f}"]).otherwise(F.lit(1.0))
            for f in features
        }
    )


def feature_vectors(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    names = [f"z_{f}" for f in usable_features(df, features)]
    return VectorAssembler(inputCols=names, outputCol="features").transform(scaled(df, features))


# --- K-means -------------------------------------------------------------------------------

def elbow(inertias: DataFrame) -> DataFrame:
    """``optimal_k`` from rows ``(k, inertia)``: one past the largest second difference.

    With fewer than three rows the smallest ``k`` is taken. Runs over one row per ``k``.
    """
    by_k = Window.orderBy("k")
    bend = F.lag("inertia").over(by_k) - 2 * F.col("inertia") + F.lead("inertia").over(by_k)
    bends = inertias.withColumn("bend", bend)
    best = F.min(F.when(F.col("bend").isNotNull(), F.struct((-F.col("bend")).alias("b"), F.col("k").alias("k"))))
    # the position of the bend counts from the second row, hence k itself
    return bends.agg(F.coalesce(best["k"], F.min("k")).alias("optimal_k"))


@dataclass
class CentreModel:
    """Cluster centres in the space of the ``z_*`` columns; ``cluster`` is the nearest one's number."""

    columns: list[str]
    centres: np.ndarray
    inertia: float
    silhouette: float

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def transform(self, rows: DataFrame) -> DataFrame:
        away = F.array(
            *[sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(self.columns, centre)), F.lit(0.0)) for centre in self.centres]
        )
        # the first of equally near centres
        return rows.withColumn("cluster", (F.array_position(away, F.array_min(away)) - 1).cast("int"))


def plus_plus(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` starting centres among the sample, each drawn by its squared distance to those before."""
    centres = [sample[rng.integers(len(sample))]]
    away = ((sample - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total_ = away.sum()
        pick = rng.choice(len(sample), p=away / total_) if total_ > 0 else rng.integers(len(sample))
        centres.append(sample[pick])
        away = np.minimum(away, ((sample - sample[pick]) ** 2).sum(1))
    return np.array(centres)


SUMS = "model int, centre int, n bigint, cost double, square double, sums array<double>"


def nearest(away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column of ``away`` the row of its least value, the first of equal ones, and that value."""
    best, near = away[0].copy(), np.zeros(away.shape[1], np.int16)
    for j in range(1, len(away)):
        np.putmask(near, away[j] < best, j)
        np.minimum(best, away[j], out=best)
    return near, best


def _scan(points: DataFrame, columns: list[str], models: dict[int, np.ndarray]) -> dict[int, list]:
    """One pass over ``points`` for all ``models``: per centre its rows, cost, sum of squares and sums.

    Every task returns a row per model and centre, so their number depends on the models alone.
    """
    numbers, every = list(models), np.concatenate(list(models.values()))
    edges = np.cumsum([0] + [len(m) for m in models.values()])
    squares, turned = (every**2).sum(1), -2 * every

    def run(batches):
        # per centre: rows, cost, squares and sums; a row of x and of facts is an axis, so that all
        # steps run along the rows of the batch
        found = np.zeros((len(every), 3 + len(columns)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            own = (x * x).sum(0)
            facts = np.vstack([np.ones_like(own), own, own, x])
            for low, high in zip(edges, edges[1:]):
                near, best = nearest(turned[low:high] @ x + squares[low:high, None])
                np.maximum(own + best, 0, out=facts[1])
                mine = near == np.arange(high - low, dtype=np.int16)[:, None]
                found[low:high] += mine.astype(float) @ facts.T
        of = np.searchsorted(edges, np.arange(len(every)), "right") - 1
        yield pa.RecordBatch.from_pydict(
            {
                "model": pa.array([numbers[i] for i in of], pa.int32()), "centre": pa.array(np.arange(len(every)) - edges[of], pa.int32()),
                "n": pa.array(found[:, 0].astype(np.int64)), "cost": pa.array(found[:, 1]), "square": pa.array(found[:, 2]),
                "sums": pa.array(found[:, 3:].tolist(), pa.list_(pa.float64())),
            }
        )

    totals = points.select(*columns).mapInArrow(run, SUMS).groupBy("model", "centre").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("square").alias("square"),
        *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(len(columns))],
    )
    found: dict[int, list] = {m: [None] * len(models[m]) for m in models}
    for r in totals.collect():  # models x centres rows
        found[r.model][r.centre] = (r.n, r.cost, r.square, np.array([r[f"s{j}"] for j in range(len(columns))]))
    return found


def _silhouettes(points: DataFrame, columns: list[str], models: dict[int, np.ndarray], stats: dict[int, list]) -> dict[int, float]:
    """Mean squared-distance silhouette of each model in one pass, from the sums of its clusters."""
    sizes = {m: np.array([s[0] for s in stats[m]]) for m in models}
    means = {m: np.array([s[3] / max(1, s[0]) for s in stats[m]]) for m in models}
    squares = {m: np.array([s[2] / max(1, s[0]) for s in stats[m]]) for m in models}

    def run(batches):
        n, total_ = 0, dict.fromkeys(models, 0.0)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows, own = np.arange(len(x)), (x**2).sum(1)[:, None]
            n += len(x)
            for m, centres in models.items():
                near = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
                away = np.maximum(own - 2 * (x @ means[m].T) + squares[m], 0)  # mean squared distances
                size = sizes[m][near]
                inner = away[rows, near] * size / np.maximum(size - 1, 1)
                away[:, sizes[m] == 0] = np.inf
                away[rows, near] = np.inf
                outer = away.min(1)
                top = np.maximum(inner, outer)
                good = (size > 1) & (top > 0) & np.isfinite(outer)
                total_[m] += float(((outer - inner)[good] / top[good]).sum())
        yield pa.RecordBatch.from_pydict(
            {
                "model": pa.array(list(models), pa.int32()), "n": pa.array([n] * len(models), pa.int64()),
                "total": pa.array([total_[m] for m in models], pa.float64()),
            }
        )

    found = points.select(*columns).mapInArrow(run, "model int, n bigint, total double").groupBy("model").agg(
        (F.sum("total") / F.sum("n")).alias("score")
    )
    return {r.model: r.score for r in found.collect()}


#: Rows from which starting centres are drawn.
START_ROWS = 4096


#: Rows that a task of a pass over the points has at least, where there are fewer tasks than cores.
TASK_ROWS = 20_000


def spread(points: DataFrame) -> DataFrame:
    """``points`` written again in even parts if they are many and their files too few for the cores."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = min(2 * cores, points.count() // TASK_ROWS)
    return stage(points.repartition(parts)) if parts > points.rdd.getNumPartitions() else points


def kmeans_search(
    rows: DataFrame, columns: list[str], ks: Sequence[int], key: str, restarts: int = 10, seed: int = 42,
    iterations: int = 100, tolerance: float = 1e-4,
) -> tuple[DataFrame, dict[int, CentreModel]]:
    """Best of ``restarts`` fits for every k: rows ``(k, inertia, silhouette)`` and the models.

    All (k, restart) models are fitted together: an iteration is one pass over ``rows`` in which every
    live model assigns the rows and sums them up; a model whose squared moves add up to at most
    ``tolerance`` (a row has variance 1 on each axis) drops out. So the passes are as many as the iterations of the slowest model, not
    the sum over models. Starting centres are drawn from about ``START_ROWS`` rows with the lowest
    hashes of ``key``; a centre without rows stays where it is. The silhouette is the linear-time one
    of squared distances.
    """
    sample = np.array(lowest_hashes(rows, F.xxhash64(key), START_ROWS).select(*columns).orderBy(*columns).collect(), float)
    rows = spread(rows.select(*columns))
    live, centres = {}, {}
    for k in ks:
        for r in range(restarts):
            live[len(live)] = k
            centres[len(centres)] = plus_plus(sample, k, np.random.default_rng([seed, r, k]))
    every = dict(live)
    for _ in range(iterations):
        stats = _scan(rows, columns, {m: centres[m] for m in live})
        for m in list(live):
            moved = np.array([s[3] / s[0] if s[0] else c for s, c in zip(stats[m], centres[m])])
            shift = float(((moved - centres[m]) ** 2).sum())
            centres[m] = moved
            if shift <= tolerance:
                del live[m]
        if not live:
            break
    final = _scan(rows, columns, centres)
    cost = {m: sum(s[1] for s in final[m]) for m in every}
    best = {k: min((m for m in every if every[m] == k), key=lambda m: (cost[m], m)) for k in ks}
    scores = _silhouettes(rows, columns, {k: centres[m] for k, m in best.items()}, {k: final[m] for k, m in best.items()})
    models = {k: CentreModel(columns, centres[m], cost[m], scores[k]) for k, m in best.items()}
    table = rows.sparkSession.createDataFrame(
        [(k, float(m.inertia), float(m.silhouette)) for k, m in models.items()], "k int, inertia double, silhouette double"
    )
    return table, models


def kmeans(
    df: DataFrame, features: tuple[str, ...] = FEATURES, k_max: int = 10, restarts: int = 10, seed: int = 42,
    key: str = KEY, half_range: bool = False,
) -> dict:
    """K-means with k chosen at the elbow: ``search`` and ``labelled`` tables, ``model``, ``optimal_k``.

    k runs from 2 to ``k_max``, and to one less than the rows at most; ``half_range`` keeps the older
    limit of one less than half of the rows. Rows without a feature, company, state or substance take
    no part.
    """
    needed = [c for c in (COMPANY, STATE, SUBSTANCE) if c in df.columns]
    rows = stage(scaled(df.na.drop(subset=needed) if needed else df, features))
    columns = [f"z_{f}" for f in usable_features(df, features)]
    n = rows.limit(2 * k_max + 4).count()
    ks = range(2, min(k_max, n // 2 - 1 if half_range else n - 1) + 1)
    if not ks:
        raise ValueError("too few rows for K-means")
    search, models = kmeans_search(rows, columns, ks, key, restarts, seed)
    k = elbow(search).first().optimal_k
    labelled = stage(models[k].transform(rows).withColumnRenamed("cluster", "Cluster_KMeans"))
    return {"search": search, "optimal_k": k, "model": models[k], "models": models, "labelled": labelled}


def centroids(model: CentreModel, spark) -> DataFrame:
    """Cluster centres in scaled space: at most k rows."""
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


# --- profiles ------------------------------------------------------------------------------

def dominant(df: DataFrame, group: str, column: str, alias: str) -> DataFrame:
    """Most frequent value per group, smallest on ties.

    Counted per (group, value) first, so no task holds the values of a whole group.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(group).agg(best["v"].alias(alias))


def cluster_profile(labelled: DataFrame, cluster: str = "Cluster_KMeans") -> DataFrame:
    """Size, mean amount, dominant state and substance, number of states per cluster."""
    sizes = labelled.groupBy(cluster).agg(
        F.count("*").alias("size"), mean(AMOUNT).alias("avg_cfem"),
        F.countDistinct(STATE).alias("geographic_spread"),
    )
    return sizes.join(dominant(labelled, cluster, STATE, "dominant_state"), cluster, "left").join(
        dominant(labelled, cluster, SUBSTANCE, "dominant_substance"), cluster, "left"
    )


def cluster_table(labelled: DataFrame, cluster: str = "Cluster_KMeans") -> DataFrame:
    """Count, mean, sum and three distinct counts per cluster; noise is left out."""
    return labelled.where(F.col(cluster) != NOISE).groupBy(cluster).agg(
        F.count(AMOUNT).alias("count"), mean(AMOUNT).alias("mean"), total(AMOUNT).alias("sum"),
        F.countDistinct(COMPANY).alias("companies"), F.countDistinct(STATE).alias("states"),
        F.countDistinct(SUBSTANCE).alias("substances"),
    )


def spatial_profile(labelled: DataFrame, cluster: str = "Spatial_Cluster") -> DataFrame:
    """Size, amounts, companies, dominant substance, centre and extent per spatial cluster."""
    rows = labelled.where(F.col(cluster) != NOISE)
    table = rows.groupBy(cluster).agg(
        F.count("*").alias("size"), total(AMOUNT).alias("total_cfem"), mean(AMOUNT).alias("avg_cfem"),
        F.countDistinct(COMPANY).alias("num_companies"),
        F.avg(LAT).alias("center_lat"), F.avg(LON).alias("center_lon"),
        (F.max(LAT) - F.min(LAT)).alias("lat_range"), (F.max(LON) - F.min(LON)).alias("lon_range"),
    )
    return table.join(dominant(rows, cluster, SUBSTANCE, "dominant_substance"), cluster, "left")


# --- DBSCAN --------------------------------------------------------------------------------

def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of the connected component of every node: rows ``(node, root)``.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every edge set is
    written once, so neither lineage nor any group but a star grows; minima are combined on
    the map side, and a star is joined to its one-row minimum.
    """
    edges = stage(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct())

    def signature(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, larger: bool) -> DataFrame:
        flipped = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        if larger:
            links = e.unionByName(flipped)
        else:
            links = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        joined = links.join(low, "u")
        if larger:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
                low.select("u", F.col("low").alias("v"))
            )
        return out.where(F.col("u") != F.col("v")).distinct()

    before = signature(edges)
    while True:  # every round but the last lowers some edge
        edges = stage(star(star(edges, True), False))
        after = signature(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def dbscan(
    points: DataFrame,
    axes: list[str],
    eps: float,
    min_samples: int,
    label: str = "cluster",
) -> DataFrame:
    """Exact DBSCAN over points ``(id, *axes)``: rows ``(id, label)``, noise is -1.

    A point is core if at least ``min_samples`` points, itself included, lie within ``eps``; in a cell
    that holds as many, all are, and only the points of thinner cells are counted.
    Cells of side ``eps / sqrt(k)`` are cliques, so core points are linked cell by cell and
    only cells with a close pair become edges: a dense area costs cells, not pairs. A border
    point joins the smallest cluster among its core neighbours; clusters are numbered in the
    order of their smallest core ``id``.
    """
    # equal locations are one point with a multiplicity
    side = eps / math.sqrt(len(axes)) * (1 - 1e-9)
    cells = [f"c_{x}" for x in axes]
    places = points.groupBy(*axes).agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    # written cell by cell, so that a task meets few cells and what it folds to cells is little
    places = stage(with_cells(places, axes, side, 0, "c").repartitionByRange(*cells, *axes).drop(*cells))
    # all points of a cell with enough of them are core; only those of other cells are counted, among
    # the points of the cells that the radius can reach
    homed = with_cells(places, axes, side, 0, "c")
    crowds = stage(homed.groupBy(*cells).agg((F.sum("copies") >= min_samples).alias("crowd"), F.min("id").alias("node")))
    crowded = sized_broadcast(crowds.where("crowd").select(*cells), MOST_CELLS)
    thin = stage(homed.join(crowded, cells, "left_anti").select("id", *axes))
    counts = neighbour_aggregate(
        thin, stage(around(places.select(*axes, "copies"), thin, axes, eps)), axes, eps, {"copies": F.sum}
    )
    sparse = stage(thin.join(counts, "id").select("id", *axes, (F.col("copies") >= min_samples).alias("core")))
    sparse_core = with_cells(sparse.where("core"), axes, side, 0, "c")
    core = stage(homed.join(crowded, cells, "left_semi").select(*axes).unionByName(sparse_core.select(*axes)))
    nodes = stage(
        crowds.where("crowd").select(*cells, "node").unionByName(sparse_core.groupBy(*cells).agg(F.min("id").alias("node")))
    )

    def named(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
        """The pairs of cells as rows ``(u, v)`` of what ``of`` calls them."""
        for p, end in (("a", "u"), ("b", "v")):
            keys = [f"{p}_{x}" for x in axes]
            pairs = pairs.join(of.select(*[F.col(c).alias(k) for c, k in zip(cells, keys)], F.col(name).alias(end)), keys)
        return pairs.select("u", "v")

    found = []

    def connected(pairs: DataFrame) -> DataFrame:
        roots = components(nodes.select("node"), named(pairs, nodes, "node"))
        found.append(stage(nodes.join(roots, "node").select(*cells, "root")))
        return found[0]

    # only pairs of cells that nothing else connects are searched for a close pair of points
    touching = touching_cells(core, axes, eps, side, connected)
    roots = components(
        found[0].select(F.col("root").alias("node")).distinct(), named(touching, found[0], "root")
    ).select(F.col("node").alias("root"), F.col("root").alias("least"))
    labelled_cells = stage(found[0].join(roots, "root").select(*cells, F.col("least").alias("root")))

    # numbering: clusters in order of their smallest core id
    names = labelled_cells.select("root").distinct().withColumn("zero", F.lit(0.0))
    numbers = global_rank(names, "zero", "root").select("root", (F.col("row_rank") - 1).alias("number"))
    # one row per cell against its points: broadcast if small, else adaptive skew join
    of_cells = sized_broadcast(labelled_cells.join(numbers, "root").select(*cells, "number"), MOST_CELLS)
    core_numbers = with_cells(core, axes, side, 0, "c").join(of_cells, cells).select(*axes, "number")
    rest = stage(sparse.where(~F.col("core")).select(F.struct(*axes).alias("id"), *axes))
    border = neighbour_aggregate(
        rest, stage(around(core_numbers, rest, axes, eps)), axes, eps, {"number": F.min}
    )
    of_sparse = sparse_core.join(of_cells, cells).select(*axes, "number").unionByName(border.select("id.*", "number"))
    # points of crowded cells are told by their cell, the others by their place
    homes = with_cells(points, axes, side, 0, "c")
    crowd_numbers = sized_broadcast(of_cells.join(crowds.where("crowd").select(*cells), cells), MOST_CELLS)
    clustered = homes.join(crowd_numbers, cells).select("id", F.col("number").cast("bigint").alias(label))
    others = homes.join(crowded, cells, "left_anti").join(sized_broadcast(of_sparse), axes, "left")
    return clustered.unionByName(others.select("id", F.coalesce("number", F.lit(NOISE)).cast("bigint").alias(label)))


def spatial_dbscan(
    df: DataFrame,
    eps_km: float = CLUSTER_EPS_KM,
    min_samples: int = CLUSTER_MIN_SAMPLES,
    strict: bool = False,
    key: str = KEY,
) -> DataFrame:
    """Operations with ``Spatial_Cluster`` and ``Is_Noise``.

    The radius is in kilometres on the globe. ``strict`` repeats the historical computation,
    which applies ``eps_km / 111`` to standardised coordinates.
    """
    rows = placed(df)
    if strict:
        axes, eps = [f"z_{LAT}", f"z_{LON}"], eps_km / 111.0
        points = scaled(rows, (LAT, LON)).select(F.col(key).alias("id"), *axes)
    else:
        axes, eps = AXES, chord(eps_km)
        vector = unit_vector(F.col(LAT).cast("double"), F.col(LON).cast("double"))
        points = rows.select(F.col(key).alias("id"), *[c.alias(x) for c, x in zip(vector, AXES)])
    labels = dbscan(stage(points), axes, eps, min_samples, label="Spatial_Cluster")
    return rows.join(labels.withColumnRenamed("id", key), key).withColumn(
        "Is_Noise", F.col("Spatial_Cluster") == NOISE
    )


def dbscan_counts(labelled: DataFrame, cluster: str = "Spatial_Cluster") -> DataFrame:
    return labelled.agg(
        F.countDistinct(F.when(F.col(cluster) != NOISE, F.col(cluster))).alias("n_clusters"),
        F.count_if(F.col(cluster) == NOISE).alias("n_noise"),
    )


def dbscan_search(
    df: DataFrame,
    features: tuple[str, ...] = FEATURES,
    min_samples: int = 3,
    key: str = KEY,
    radii: tuple[float, ...] = tuple(round(0.1 * i, 1) for i in range(1, 20)),
) -> dict:
    """DBSCAN on scaled features with the radius chosen by silhouette among noise-free results.

    A larger radius only ever turns noise into members and merges clusters. So the smallest
    noise-free radius is found by cutting the radii into ``TRIED`` + 1 parts again and again, and the walk
    upwards stops at one single cluster. ``TRIED`` radii are tried at a time, as their many small jobs leave
    most of a cluster idle. Without a candidate the radius is 0.5 and the score 0.
    """
    features = tuple(usable_features(df, features))
    axes = [f"z_{f}" for f in features]
    rows = stage(scaled(df, features))
    points = rows.select(F.col(key).alias("id"), *axes)
    tried: dict[float, tuple] = {}

    def run(eps: float) -> tuple:
        if eps not in tried:
            out = stage(dbscan(points, axes, eps, min_samples, label="Cluster_DBSCAN"))
            tried[eps] = (out, dbscan_counts(out, "Cluster_DBSCAN").first())
        return tried[eps]

    def run_all(some: Sequence[float]) -> list[tuple]:
        # the driver holds the broadcasts of all of them
        with sharing(df.sparkSession, len(some)), ThreadPoolExecutor(TRIED) as pool:
            return list(pool.map(inheritable_thread_target(df.sparkSession)(run), some))

    low, high = 0, len(radii)
    while low < high:
        inner = sorted({low + (high - low) * (i + 1) // (TRIED + 1) for i in range(TRIED)})
        noisy = [counts.n_noise > 0 for _, counts in run_all([radii[i] for i in inner])]
        first = noisy.index(False) if False in noisy else len(inner)
        low = inner[first - 1] + 1 if first else low
        high = inner[first] if first < len(inner) else high
    best_eps, best_score = 0.5, None
    vectors = VectorAssembler(inputCols=axes, outputCol="features").transform(rows)
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="Cluster_DBSCAN")
    for i, eps in enumerate(radii[low:], low):
        if eps not in tried:
            run_all(radii[i : i + TRIED])
        out, counts = run(eps)
        if counts.n_clusters < 2:
            break
        labelled = vectors.join(out.withColumnRenamed("id", key), key)
        score = evaluator.evaluate(labelled.withColumn("Cluster_DBSCAN", F.col("Cluster_DBSCAN").cast("int")))
        if best_score is None or score > best_score:
            best_eps, best_score = eps, score
    out, counts = run(best_eps)
    summary = df.sparkSession.range(1).select(
        F.lit(float(best_eps)).alias("eps"),
        F.lit(counts.n_clusters).alias("n_clusters"),
        F.lit(counts.n_noise).alias("n_noise"),
        F.lit(best_score or 0.0).alias("silhouette_score"),
    )
    labelled = rows.drop(*axes).join(out.withColumnRenamed("id", key), key)
    return {"summary": summary, "labelled": labelled}


# --- principal components ------------------------------------------------------------------

def principal_components(df: DataFrame, features: tuple[str, ...] = FEATURES) -> dict:
    """All components of the scaled features.

    ``variance``: rows (component, ratio, cumulative, n_components_95); ``loadings``: rows
    (component, feature, loading), each component signed so that its largest loading is
    positive; ``projected``: every row with its coordinates.
    """
    features = usable_features(df, features)
    d = len(features)
    vectors = feature_vectors(df, tuple(features))
    model = PCA(k=d, inputCol="features", outputCol="pca").fit(vectors)
    ratios = [float(v) for v in model.explainedVariance]
    matrix = model.pc.toArray()  # d x d, d = number of features
    signs = [1.0 if matrix[abs(matrix[:, j]).argmax(), j] >= 0 else -1.0 for j in range(d)]
    sums = [sum(ratios[: i + 1]) for i in range(d)]
    enough = next((i + 1 for i, s in enumerate(sums) if s >= 0.95), 1)
    spark = df.sparkSession
    variance = spark.createDataFrame(
        [(i + 1, ratios[i], sums[i], enough) for i in range(d)],
        "component int, ratio double, cumulative double, n_components_95 int",
    )
    loadings = spark.createDataFrame(
        [(j + 1, features[i], float(matrix[i, j] * signs[j])) for j in range(d) for i in range(d)],
        "component int, feature string, loading double",
    )
    values = vector_to_array("pca")
    projected = model.transform(vectors).withColumns(
        {f"pc{j + 1}": values[j] * signs[j] for j in range(d)}
    ).drop("pca", "features", *[f"z_{f}" for f in features])
    return {"variance": variance, "loadings": loadings, "projected": projected, "model": model}
