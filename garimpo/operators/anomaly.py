"""Isolation forest (Liu, Ting, Zhou 2008) and the summary of its findings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import labels
from garimpo.functions.numbers import mean, ratio, total
from garimpo.operators.cluster import FEATURES, scaled, usable_features
from garimpo.operators.kpi import top_k
from garimpo.operators.rank import quantile_columns
from garimpo.schema import ANOMALY_CONTAMINATION, AMOUNT, COMPANY, KEY, lowest_hashes, stage

TREES = 100
SAMPLE = 256
NODE = "tree int, node int, feature int, split double, left int, length double"


def mean_path(n: int) -> float:
    """Average path length of an unsuccessful search in a binary search tree of n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random splits down to depth log2(sample); rows (node, feature, split, left, length).

    The right child follows the left one. A leaf has feature -1.
    """
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple] = [()]
    pending = [(0, x, 0)]
    while pending:
        node, rows, depth = pending.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(open_features):
            nodes[node] = (node, -1, 0.0, node, depth + mean_path(len(rows)))
            continue
        f = int(rng.choice(open_features))
        # above the lowest value, so that neither side is empty
        cut = max(float(rng.uniform(low[f], high[f])), float(np.nextafter(low[f], np.inf)))
        left = len(nodes)
        nodes += [(), ()]
        nodes[node] = (node, f, cut, left, 0.0)
        below = rows[:, f] < cut
        pending += [(left, rows[below], depth + 1), (left + 1, rows[~below], depth + 1)]
    return nodes


def grow_forest(points: DataFrame, axes: list[str], n: int, seed: int, trees: int, sample: int) -> DataFrame:
    """All trees as node rows; each tree is grown from its own ``sample`` rows in its own group.

    The ``trees * sample`` rows with the smallest hashes form the pool. It is put in as many
    hashed orders as it takes to fill all trees, and consecutive rows go to the same tree, so
    no more than about ``2 * trees * sample`` rows are handled whatever the size of the table.
    Hashing keys makes the choice the same on every run.
    """
    wanted = trees * sample
    pool_size = min(n, wanted)
    first = F.xxhash64("id", F.lit(seed))
    pool = lowest_hashes(points, first, wanted, n).orderBy(first, "id").limit(wanted)
    orders = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(wanted / pool_size) - 1)))
    by_hash = Window.partitionBy("order").orderBy(F.xxhash64("id", "order", F.lit(seed)), "id")
    slot = F.col("order") * pool_size + F.row_number().over(by_hash) - 1
    taken = (
        pool.withColumn("order", orders)
        .withColumn("turn", slot)
        .where(F.col("turn") < wanted)
        .withColumn("tree", F.floor(F.col("turn") / sample).cast("int"))
    )

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rows = pdf.sort_values("turn")[axes].to_numpy()
        nodes = grow_tree(rows, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "length"])
        out.insert(0, "tree", tree)
        return out

    return taken.select("tree", "turn", *axes).groupBy("tree").applyInPandas(grow, NODE)


def score_column(forest: pd.DataFrame, axes: list[str], sample_size: int):
    """Vectorised scorer: minus two to the minus mean path over expected path."""
    trees = []
    for _, nodes in forest.groupby("tree"):
        nodes = nodes.sort_values("node")
        leaf = (nodes["feature"] < 0).to_numpy()
        # a leaf sends every row to itself, so all rows walk the same number of steps
        trees.append((
            np.where(leaf, 0, nodes["feature"]).astype(np.int32),
            np.where(leaf, np.inf, nodes["split"]),
            nodes["left"].to_numpy(np.int32), nodes["length"].to_numpy(),
        ))
    steps = math.ceil(math.log2(max(sample_size, 2)))
    expected = mean_path(sample_size) or 1.0
    width = len(axes)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        flat = np.column_stack([c.to_numpy() for c in columns]).ravel()
        start = np.arange(0, len(flat), width, dtype=np.int32)
        depth = np.zeros(len(start))
        for feature, cut, left, length in trees:
            at = np.zeros(len(start), dtype=np.int32)
            for _ in range(steps):
                at = left.take(at) + (flat.take(start + feature.take(at)) >= cut.take(at))
            depth += length.take(at)
        return pd.Series(-np.power(2.0, -depth / len(trees) / expected))

    return score(*axes)


def detect(
    df: DataFrame,
    features: tuple[str, ...] = FEATURES,
    contamination: float | None = None,
    seed: int = 42,
    trees: int = TREES,
    sample: int = SAMPLE,
    key: str = KEY,
) -> DataFrame:
    """Complete rows with ``Anomaly_Score``, ``Anomaly_Label`` (-1 or 1) and ``Is_Anomaly``.

    The lowest ``contamination`` share of scores is anomalous; by default min(0.1, 50 / rows).
    The forest is small by construction (trees x 2 x sample nodes) and travels with the scorer.
    """
    features = usable_features(df, features)
    axes = [f"z_{f}" for f in features]
    rows = scaled(df, tuple(features))
    points = rows.select(F.col(key).alias("id"), *axes)
    n = rows.count()
    if n < 5:
        raise ValueError("too few rows for anomaly detection (at least 5)")
    share = min(ANOMALY_CONTAMINATION, 50 / n) if contamination is None else contamination
    sample = min(sample, n)
    forest = grow_forest(points, axes, n, seed, trees, sample).toPandas()
    score = score_column(forest, axes, sample)
    scored = stage(rows.withColumn("Anomaly_Score", score).drop(*axes))
    cut = quantile_columns(scored, "Anomaly_Score", {"cut": share}).scalar()
    return scored.withColumn("Is_Anomaly", F.col("Anomaly_Score") < cut).withColumn(
        "Anomaly_Label", F.when(F.col("Is_Anomaly"), -1).otherwise(1)
    )


def summary(detected: DataFrame) -> DataFrame:
    """One row: anomalies, their share, mean amounts of both classes, impact label."""
    odd = F.col("Is_Anomaly")
    row = detected.agg(
        F.count_if(odd).alias("total_anomalies"),
        ratio(F.count_if(odd) * 100, F.count("*")).alias("anomaly_percentage"),
        F.coalesce(mean(F.when(odd, F.col(AMOUNT))), F.lit(0.0)).alias("cfem_mean_anomaly"),
        F.coalesce(mean(F.when(~odd, F.col(AMOUNT))), F.lit(0.0)).alias("cfem_mean_normal"),
        ratio(total(F.when(odd, F.col(AMOUNT))), total(AMOUNT)).alias("share"),
    )
    return row.withColumn(
        "anomaly_impact", labels.anomaly_impact(F.col("total_anomalies"), F.col("share"))
    ).drop("share")


def top_companies(detected: DataFrame, k: int = 5, key: str = KEY) -> DataFrame:
    """Companies of the largest anomalous operations."""
    return top_k(detected.where("Is_Anomaly"), AMOUNT, key, k).select(COMPANY, AMOUNT)
