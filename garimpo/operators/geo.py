"""Spatial statistics, hotspots, accessibility."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import labels, tails
from garimpo.functions.geo import EARTH_RADIUS_KM, KM_PER_DEGREE, haversine_km, quadrant, unit_vector
from garimpo.functions.numbers import mean, ratio, total
from garimpo.operators import dims
from garimpo.operators.far import far_sums
from garimpo.operators.kpi import top_k
from garimpo.operators.neighbours import neighbour_aggregate
from garimpo.operators.rank import quantile_columns
from garimpo.operators.stats import correlation_test
from garimpo.schema import (
    AMOUNT, COMPANY, HOTSPOT_RADIUS_KM, KEY, LAT, LON, PLACE, STATE, SUBSTANCE, scalar_of,
    stage,
)

AXES = ["x", "y", "z"]


def placed(df: DataFrame, *more: str) -> DataFrame:
    return df.na.drop(subset=[LON, LAT, *more])


# --- centre, dispersion, hull, quadrants ---------------------------------------------------

def centre_of(df: DataFrame) -> DataFrame:
    return placed(df).agg(F.avg(LAT).alias("latitude"), F.avg(LON).alias("longitude"))


def dispersion(df: DataFrame) -> DataFrame:
    """Centre and the distances to it: mean, population deviation, maximum, their ratio."""
    c = scalar_of(centre_of(df))
    rows = placed(df).select(
        haversine_km(F.col(LAT), F.col(LON), c["latitude"], c["longitude"]).alias("d")
    )
    return rows.agg(
        F.avg("d").alias("mean_distance_to_center"),
        F.stddev_pop("d").alias("std_distance_to_center"),
        F.max("d").alias("max_distance_to_center"),
        ratio(F.stddev_pop("d"), F.avg("d")).alias("dispersion_index"),
    ).select(c["latitude"].alias("latitude"), c["longitude"].alias("longitude"), "*")


def quadrants(df: DataFrame) -> DataFrame:
    """Operations per quadrant around the centre, empty quadrants included."""
    c = scalar_of(centre_of(df))
    name = quadrant(F.col(LAT), F.col(LON), c["latitude"], c["longitude"])
    counts = placed(df).select(name.alias("quadrant")).groupBy("quadrant").agg(F.count("*").alias("n"))
    names = dims.labels(df.sparkSession, "quadrant", ["NE", "NW", "SE", "SW"])
    return names.join(counts, "quadrant", "left").select(
        "quadrant", F.coalesce("n", F.lit(0)).alias("operations")
    )


def hull_points(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows):
        kept: list = []
        for x, y in rows:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                kept.pop()
            kept.append((x, y))
        return kept[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def _hulls(batches):
    """Hull of a partition; batches are merged one by one, so memory stays small."""
    corners = np.empty((0, 2))
    for batch in batches:
        corners = hull_points(np.vstack([corners, batch[["x", "y"]].to_numpy()]))
    yield pd.DataFrame(corners, columns=["x", "y"])


def outside(points: DataFrame, directions: int = 32) -> DataFrame:
    """``points`` without those strictly inside the polygon of the extreme points of some directions.

    One aggregate and one filter, both in the JVM; corners of the hull are never inside.
    """
    angles = [2 * math.pi * i / directions for i in range(directions)]
    row = points.agg(
        *[F.max_by(F.struct("x", "y"), F.col("x") * math.cos(a) + F.col("y") * math.sin(a)) for a in angles]
    ).first()
    found = [tuple(p) for p in row if p is not None]
    corners = hull_points(np.array(found, float).reshape(-1, 2))
    if len(corners) < 3:
        return points
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners.tolist(), np.roll(corners, -1, axis=0).tolist()):
        inside = inside & ((F.col("y") - ay) * (bx - ax) - (F.col("x") - ax) * (by - ay) > 1e-9)
    return points.where(~inside)


def convex_hull(df: DataFrame) -> DataFrame:
    """Corner points ``(x, y)`` = (longitude, latitude) of all operations.

    Points that cannot be corners go first. Hulls of partitions, then of 16 groups of those, then of the few corners left. The hull of
    hulls is the hull, and no step sees more than corners of the step before.
    """
    points = placed(df).select(F.col(LON).cast("double").alias("x"), F.col(LAT).cast("double").alias("y"))
    schema = "x double, y double"
    corners = outside(points).mapInPandas(_hulls, schema).repartition(16).mapInPandas(_hulls, schema)
    return corners.repartition(1).mapInPandas(_hulls, schema)


def density(df: DataFrame) -> DataFrame:
    """Hull area in km2 (degrees scaled at the mean latitude) and operations per km2."""

    def area(batches):
        # the corners of one hull: a few rows
        p = pd.concat(list(batches))
        x, y = p["x"].to_numpy(), p["y"].to_numpy()
        twice = np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)) if len(p) > 2 else 0.0
        yield pd.DataFrame({"area": [abs(twice) / 2]})

    degrees = convex_hull(df).mapInPandas(area, "area double")
    row = placed(df).agg(F.count("*").alias("total_points"), F.avg(LAT).alias("lat"))
    km2 = degrees.agg(F.max("area").alias("area")).scalar() * (
        KM_PER_DEGREE**2 * F.cos(F.radians("lat"))
    )
    return row.select(
        F.coalesce(km2, F.lit(0.0)).alias("convex_hull_area_km2"), "total_points"
    ).withColumn(
        "points_per_km2",
        F.coalesce(ratio("total_points", "convex_hull_area_km2"), F.lit(0.0)),
    )


# --- hotspots ------------------------------------------------------------------------------

def chord(km: float) -> float:
    """Straight-line length on the unit sphere of a great-circle distance."""
    return 2 * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def locations(df: DataFrame, payload: dict) -> DataFrame:
    """Distinct coordinates with their folded payload, an id and their place on the sphere."""
    folded = placed(df).groupBy(
        F.col(LAT).cast("double").alias("lat"), F.col(LON).cast("double").alias("lon")
    ).agg(*[c.alias(n) for n, c in payload.items()])
    return folded.withColumns(dict(zip(AXES, unit_vector(F.col("lat"), F.col("lon")))))


def _near_km(radius_km: float) -> Column:
    """Great-circle distance at most ``radius_km``; the chord decides all but what is on the border."""
    square = F.lit(0.0)
    for x in AXES:
        square = square + (F.col(f"l_{x}") - F.col(f"r_{x}")) * (F.col(f"l_{x}") - F.col(f"r_{x}"))
    limit = chord(radius_km) ** 2
    exactly = haversine_km(F.col("id.lat"), F.col("id.lon"), F.col("lat"), F.col("lon")) <= radius_km
    return (square < limit * (1 - 1e-9)) | ((square <= limit * (1 + 1e-9)) & exactly)


#: Amounts below this are added as whole units and billionths, both as integers; others as double.
WHOLE_UNITS = 1e15


def on_sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """``unit_vector`` of arrays."""
    phi, lam = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])


def _totals(df: DataFrame, value: str, radius_km: float) -> DataFrame:
    """``neighbour_totals`` with the number of operations at the location itself: ``operations``."""
    folded = locations(placed(df, value), {"neighbours": F.count("*"), "total": total(value)})
    small = F.abs(F.col("total")) < WHOLE_UNITS
    units = F.when(small, F.floor("total")).otherwise(0)
    points = stage(
        folded.drop(*AXES).withColumn("units", units.cast("bigint"))
        .withColumn("billionths", F.when(small, F.round((F.col("total") - F.col("units")) * 1e9)).otherwise(0).cast("bigint"))
        .withColumn("large", F.when(small, F.lit(0.0)).otherwise(F.col("total"))).drop("total")
    ).withColumns(dict(zip(AXES, unit_vector(F.col("lat"), F.col("lon")))))
    left = points.withColumn("id", F.struct("lat", "lon", F.col("neighbours").alias("operations")))
    sums = {c: F.sum for c in ("neighbours", "units", "billionths", "large")}
    found = neighbour_aggregate(
        left, points, AXES, chord(radius_km), sums, _near_km(radius_km), same_points=True, place=(["lat", "lon"], on_sphere)
    )
    local_sum = F.col("units").cast("double") + F.col("billionths") / 1e9 + F.col("large")
    return found.select("id.lat", "id.lon", "id.operations", "neighbours", local_sum.alias("local_sum"))


def neighbour_totals(df: DataFrame, value: str = AMOUNT, radius_km: float = HOTSPOT_RADIUS_KM) -> DataFrame:
    """Per distinct location the number and total of operations within the radius.

    Totals of locations below ``WHOLE_UNITS`` are added to nine digits in integers, in any order
    with the same result; larger ones are added as doubles.
    """
    return _totals(df, value, radius_km).drop("operations")


def hotspot_scores(df: DataFrame, value: str = AMOUNT, radius_km: float = HOTSPOT_RADIUS_KM) -> DataFrame:
    """Every operation with its score and category.

    Score: total within the radius times ``ln(neighbours + 1)``, zero for an isolated operation.
    Categories cut at the 70th, 85th and 95th percentile of the scores of all operations.
    Operations of a location share its score, so the percentiles come from the locations and their numbers of
    operations, and the operations themselves are joined when the result is read, with the columns it needs.
    """
    n = F.col("neighbours")
    score = F.when(n > 1, F.col("local_sum") * F.ln(n + 1)).otherwise(F.lit(0.0))
    near = stage(_totals(df, value, radius_km).select("lat", "lon", "operations", "neighbours", score.alias("Hotspot_Score")))
    p = scalar_of(
        stage(quantile_columns(near, "Hotspot_Score", {"p70": 0.7, "p85": 0.85, "p95": 0.95}, copies="operations"))
    )
    category = labels.hotspot(F.col("Hotspot_Score"), p["p70"], p["p85"], p["p95"])
    rows = placed(df, value)
    of_place = near.drop("operations")
    return rows.join(
        F.broadcast(of_place) if near.limit(100_001).count() <= 100_000 else of_place,
        (rows[LAT].cast("double") == F.col("lat")) & (rows[LON].cast("double") == F.col("lon")),
    ).drop("lat", "lon").withColumn("Hotspot_Category", category)


def class_table(df: DataFrame, category: str, distinct: dict[str, str], value: str = AMOUNT) -> DataFrame:
    """Count, sum, mean and distinct counts per class."""
    return df.groupBy(category).agg(
        F.count(value).alias("count"),
        total(value).alias("sum"),
        mean(value).alias("mean"),
        *[F.countDistinct(c).alias(n) for n, c in distinct.items()],
    )


def hotspot_table(scored: DataFrame, value: str = AMOUNT) -> DataFrame:
    return class_table(
        scored, "Hotspot_Category", {"companies": COMPANY, "substances": SUBSTANCE}, value
    )


def top_hotspots(scored: DataFrame, k: int = 10, value: str = AMOUNT) -> DataFrame:
    return top_k(scored, "Hotspot_Score", KEY, k).select(COMPANY, PLACE, STATE, "Hotspot_Score", value)


# --- accessibility -------------------------------------------------------------------------

def with_accessibility(df: DataFrame) -> DataFrame:
    """Distance to the reference point of the state (27-row broadcast) and its category."""
    points = F.broadcast(dims.state_points(df.sparkSession))
    km = haversine_km(F.col(LAT), F.col(LON), F.col("point_lat"), F.col("point_lon"))
    return (
        placed(df)
        .join(points, STATE, "left")
        .withColumn("Distance_to_Capital", km)
        .withColumn("Accessibility_Category", labels.accessibility(F.col("Distance_to_Capital")))
        .drop("point_lat", "point_lon")
    )


def accessibility_table(df: DataFrame) -> DataFrame:
    return class_table(with_accessibility(df), "Accessibility_Category", {"companies": COMPANY})


def accessibility_correlation(df: DataFrame) -> DataFrame:
    return correlation_test(with_accessibility(df), "Distance_to_Capital", AMOUNT)


def mean_accessibility(df: DataFrame) -> DataFrame:
    return with_accessibility(df).agg(F.avg("Distance_to_Capital").alias("average_distance_to_capital"))


# --- autocorrelation -----------------------------------------------------------------------

#: Rows and columns of a tile of distances: two of them fit into a core's cache.
TILE = (16, 4096)


def block_sums(one: pd.DataFrame, other: pd.DataFrame, sums: dict[str, tuple[str, int]]) -> tuple[dict, dict]:
    """The sums of ``kernel_sums`` over the points of ``other`` for ``one``, and the other way round.

    Distances are the same in both directions, so each is computed once. ``1 / distance`` counts as
    zero wherever it is not a finite number.
    """
    by_power: dict[int, list[str]] = {}
    for name, (_, power) in sums.items():
        by_power.setdefault(power, []).append(name)
    weights = {p: [side[[sums[x][0] for x in names]].to_numpy(float) for side in (one, other)] for p, names in by_power.items()}
    found = {p: (np.zeros((len(one), len(names))), np.zeros((len(names), len(other)))) for p, names in by_power.items()}
    (lat, lon), (lat_, lon_) = ([side[c].to_numpy(float) for c in ("lat", "lon")] for side in (one, other))
    spare = np.empty(TILE), np.empty(TILE)
    with np.errstate(all="ignore"):
        for i in range(0, len(one), TILE[0]):
            for j in range(0, len(other), TILE[1]):
                rows, columns = slice(i, min(i + TILE[0], len(one))), slice(j, min(j + TILE[1], len(other)))
                first, second = (x[: rows.stop - i, : columns.stop - j] for x in spare)
                np.subtract(lat[rows, None], lat_[columns], out=first)
                np.multiply(first, first, out=first)
                np.subtract(lon[rows, None], lon_[columns], out=second)
                np.multiply(second, second, out=second)
                np.add(first, second, out=first)
                np.divide(1.0, first, out=second)
                np.sqrt(second, out=first)
                for power, (mine, theirs) in found.items():
                    of_one, of_other = weights[power][0][rows].T, weights[power][1][columns]
                    kernel = first if power == 1 else second if power == 2 else first**power
                    there, back = kernel @ of_other, of_one @ kernel
                    if not (np.isfinite(there).all() and np.isfinite(back).all()):
                        kernel = np.where(np.isfinite(kernel), kernel, 0.0)
                        there, back = kernel @ of_other, of_one @ kernel
                    mine[rows] += there
                    theirs[:, columns] += back
    return (
        {x: found[p][0][:, i] for p, names in by_power.items() for i, x in enumerate(names)},
        {x: found[p][1][i] for p, names in by_power.items() for i, x in enumerate(names)},
    )


#: Places up to which all pairs are computed one by one.
PAIRED_PLACES = 32_768


def kernel_sums(
    points: DataFrame, sums: dict[str, tuple[str | None, int]], block: int = 16_384, paired: bool | None = None
) -> DataFrame:
    """For every point the sums over all other points of ``weight / distance^power``.

    ``points`` holds ``id, lat, lon`` and the weight columns. Equal locations have weight zero and
    equal sums, so they are folded first. The locations are cut into blocks of at most about ``block``
    and every unordered pair of blocks is one group, worked on tile by tile for both of its blocks:
    pairs of points are never rows, no group grows with the data, and the work is spread evenly
    whatever the geography. Distances are in degrees.

    More than ``PAIRED_PLACES`` locations go through ``far.far_sums`` instead, where far cells act
    through nodes; ``paired`` decides for or against it.
    """
    weights = sorted({w for w, _ in sums.values() if w})
    located = stage(
        points.groupBy("lat", "lon").agg(F.count("*").cast("double").alias("copies"), *[F.sum(w).alias(w) for w in weights])
    )
    n = located.count()
    named = {name: (weight or "copies", power) for name, (weight, power) in sums.items()}
    if n > PAIRED_PLACES if paired is None else not paired:
        finite = (F.abs("lat") < math.inf) & (F.abs("lon") < math.inf) & ~F.isnan("lat") & ~F.isnan("lon")
        found = far_sums(located.where(finite), named)
        # a place that is nowhere is at no finite distance from any other
        found = found.unionByName(located.where(~finite).select("lat", "lon", *[F.lit(0.0).alias(name) for name in sums]))
    else:
        found = _paired_sums(located, n, named, block)
    return points.select("id", "lat", "lon").join(found, ["lat", "lon"]).groupBy("id").agg(
        *[F.sum(name).alias(name) for name in sums]
    )


def _paired_sums(located: DataFrame, n: int, named: dict[str, tuple[str, int]], block: int) -> DataFrame:
    """The sums of every place, pair by pair."""
    weights = sorted({w for w, _ in named.values()} - {"copies"})
    # no fewer than 8 blocks, hence 36 tasks, where there is work for them
    blocks = max(1, math.ceil(n / block), min(8, math.ceil(n / 2000)))
    home, other = F.col("home"), F.col("other")
    rows = located.select(
        "lat", "lon", "copies", *weights, F.pmod(F.xxhash64("lat", "lon"), F.lit(blocks)).alias("home"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"),
    ).select(
        "lat", "lon", "copies", *weights, (F.least(home, other) * blocks + F.greatest(home, other)).alias("pair"),
        (home > other).alias("second"),
    )

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[~pdf["second"]], pdf[pdf["second"]]
        if key[0] // blocks == key[0] % blocks:  # a block with itself
            return one[["lat", "lon"]].assign(**block_sums(one, one, named)[0])
        mine, theirs = block_sums(one, two, named)
        return pd.concat([one[["lat", "lon"]].assign(**mine), two[["lat", "lon"]].assign(**theirs)])

    schema = "lat double, lon double, " + ", ".join(f"{name} double" for name in named)
    # little data but much work: a task for every few pairs of blocks
    partial = rows.repartition(min(4096, blocks * (blocks + 1) // 2), "pair").groupBy("pair").applyInPandas(multiply, schema)
    return partial.groupBy("lat", "lon").agg(*[F.sum(name).alias(name) for name in named])


def _deviations(df: DataFrame, value: str, key: str) -> DataFrame:
    rows = placed(df, value)
    centre = rows.agg(F.avg(value).alias("m")).scalar()
    z = F.col(value).cast("double") - centre
    return stage(
        rows.select(
            F.col(key).alias("id"), F.col(LAT).cast("double").alias("lat"),
            F.col(LON).cast("double").alias("lon"), z.alias("z"), (z * z).alias("zz"),
        )
    )


def row_sums(df: DataFrame, value: str = AMOUNT, key: str = KEY) -> DataFrame:
    """Per operation: row sum ``r`` of inverse distances, weighted sums, sum of squared inverses.

    All statistics below start from this table and take it as ``rows``, so that it is built once.
    """
    points = _deviations(df, value, key)
    sums = kernel_sums(
        points, {"r": (None, 1), "q": ("z", 1), "u": ("zz", 1), "r2": (None, 2)}
    )
    return stage(points.join(sums, "id"))


def simple_moran(df: DataFrame, value: str = AMOUNT, key: str = KEY, rows: DataFrame | None = None) -> DataFrame:
    """Moran's I with row-normalised inverse distances; fewer than four points give zero."""
    rows = row_sums(df, value, key) if rows is None else rows
    linked = F.when(F.col("r") > 0, F.col("z") * F.col("q") / F.col("r")).otherwise(0.0)
    row = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("s0"),
        F.sum(linked).alias("top"), F.sum("zz").alias("bottom"),
    )
    i = F.coalesce(ratio("n", "s0") * ratio("top", "bottom"), F.lit(0.0))
    return row.select(
        F.when(F.col("n") < 4, 0.0).otherwise(i).alias("morans_i"), "n"
    ).select(
        "morans_i",
        F.when(F.col("n") < 4, "Dados insuficientes")
        .otherwise(labels.simple_moran(F.col("morans_i")))
        .alias("interpretation"),
    )


def moran(
    df: DataFrame, value: str = AMOUNT, key: str = KEY, strict: bool = False, rows: DataFrame | None = None
) -> DataFrame:
    """Moran's I with expectation, variance under randomisation, z-score and p-value.

    ``strict`` takes ``S2`` from squared row sums alone, as the historical result does; the
    default adds the column sums, as the statistic is defined.
    """
    rows = (row_sums(df, value, key) if rows is None else rows).withColumn(
        "inverse", F.coalesce(F.try_divide(F.lit(1.0), F.col("r")), F.lit(0.0))
    )
    # second pass: sums that need the row sum of the other point
    back = kernel_sums(rows, {"column_sum": ("inverse", 1), "cross": ("inverse", 2)})
    rows = rows.join(back, "id")
    has = (F.col("r") > 0).cast("double")
    both = has if strict else has + F.col("column_sum")
    row = rows.agg(
        F.count("*").cast("double").alias("n"),
        F.sum(has).alias("s0"),
        F.sum(F.col("z") * F.col("q") * F.col("inverse")).alias("top"),
        F.sum("zz").alias("m2"),
        F.sum(F.col("zz") * F.col("zz")).alias("m4"),
        # half the sum of (w_ij + w_ji)^2, multiplied out
        F.sum(F.pow("inverse", 2.0) * F.col("r2") + F.col("inverse") * F.col("cross")).alias("s1"),
        F.sum(both * both).alias("s2"),
    )
    n, s0, s1, s2 = (F.col(c) for c in ("n", "s0", "s1", "s2"))
    i = F.coalesce(ratio(n, s0) * ratio("top", "m2"), F.lit(0.0))
    expected = ratio(F.lit(-1.0), n - 1)
    b2 = ratio(n * F.col("m4"), F.col("m2") * F.col("m2"))
    variance = ratio(
        n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0)
        - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0),
        (n - 1) * (n - 2) * (n - 3) * s0 * s0,
    ) - expected * expected
    out = row.select(
        i.alias("morans_i"), expected.alias("expected_i"), variance.alias("variance"), "n"
    ).where(n >= 5)
    out = out.withColumn(
        "z_score",
        F.when(F.col("variance") > 0, (F.col("morans_i") - F.col("expected_i")) / F.sqrt("variance"))
        .otherwise(0.0),
    )
    return out.withColumn("p_value", 2 * tails.normal_p(F.abs("z_score"))).select(
        "morans_i", "expected_i", "variance", "z_score", "p_value",
        labels.detailed_moran(F.col("morans_i"), F.col("p_value")).alias("interpretation"),
    )


def geary(df: DataFrame, value: str = AMOUNT, key: str = KEY) -> DataFrame:
    """Geary's C; expands ``w (z_i - z_j)^2`` so that per-point sums suffice."""
    rows = row_sums(df, value, key)
    spread = F.when(
        F.col("r") > 0, F.col("zz") + (F.col("u") - 2 * F.col("z") * F.col("q")) / F.col("r")
    ).otherwise(0.0)
    row = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("s0"),
        F.sum(spread).alias("top"), F.sum("zz").alias("m2"),
    ).where(F.col("n") >= 5)
    c = ratio((F.col("n") - 1) * F.col("top"), 2 * F.col("s0") * F.col("m2"))
    return row.select(F.coalesce(c, F.lit(1.0)).alias("gearys_c"), F.lit(1.0).alias("expected_c")).select(
        "*", labels.geary(F.col("gearys_c")).alias("interpretation")
    )


def autocorrelation(df: DataFrame, method: str = "moran", **options) -> DataFrame:
    if method.lower() == "moran":
        return moran(df, **options)
    if method.lower() == "geary":
        return geary(df, **options)
    raise ValueError("method must be 'moran' or 'geary'")
