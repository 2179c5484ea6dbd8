"""Neighbour totals and DBSCAN against brute force, dense areas included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.operators import cluster, geo, neighbours


def haversine(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(
        np.radians(lon2 - lon1) / 2
    ) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(a, 1)))


def sites(seed=0, n=300, dense=400):
    """Scattered sites, a dense town, and one location that many operations share."""
    rng = np.random.default_rng(seed)
    lat, lon = rng.uniform(-34, 6, n), rng.uniform(-74, -32, n)
    lat = np.concatenate([lat, -20 + rng.normal(0, 0.2, dense), np.full(150, -10.0)])
    lon = np.concatenate([lon, -44 + rng.normal(0, 0.2, dense), np.full(150, -50.0)])
    return lat, lon, np.round(rng.lognormal(8, 1, len(lat)), 2)


def frame(spark, lat, lon, amount):
    rows = [
        (i, f"C{i % 9}", "MG", "FERRO", f"M{i}", float(a), float(x), float(y))
        for i, (y, x, a) in enumerate(zip(lat, lon, amount))
    ]
    return spark.createDataFrame(
        rows,
        "op_id long, TITULAR string, ESTADO string, PRIMEIRODESUBS string, `MUNICIPIO(S)` string, CFEM double, LONGITUDE double, LATITUDE double",
    )


@pytest.mark.parametrize("compared", [4096, 16])
def test_totals_match_brute_force(spark, monkeypatch, compared):
    monkeypatch.setattr(neighbours, "COMPARED_PAIRS", compared)  # small: forces refinement
    lat, lon, amount = sites()
    df = frame(spark, lat, lon, amount)
    d = haversine(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    near = d <= 60.0
    got = {(r.lat, r.lon): (r.neighbours, r.local_sum) for r in geo.neighbour_totals(df, radius_km=60.0).collect()}
    for i in range(len(lat)):
        n, s = got[lat[i], lon[i]]
        assert n == near[i].sum()
        assert s == pytest.approx(amount[near[i]].sum(), rel=1e-9)


def test_hotspot_scores_and_categories(spark):
    lat, lon, amount = sites(1, 120, 80)
    out = geo.hotspot_scores(frame(spark, lat, lon, amount), radius_km=100.0).orderBy("op_id").collect()
    near = haversine(lat[:, None], lon[:, None], lat[None, :], lon[None, :]) <= 100.0
    n = near.sum(axis=1)
    score = np.where(n > 1, (near * amount[None, :]).sum(axis=1) * np.log(n + 1), 0.0)
    assert [r.Hotspot_Score for r in out] == pytest.approx(list(score), rel=1e-9)
    p70, p85, p95 = np.percentile([r.Hotspot_Score for r in out], [70, 85, 95])
    for r in out:
        s = r.Hotspot_Score
        want = "Very Hot" if s >= p95 else "Hot" if s >= p85 else "Warm" if s >= p70 else "Cold"
        assert r.Hotspot_Category == want


def brute_dbscan(distance, eps, min_samples):
    near = distance <= eps
    core = near.sum(axis=1) >= min_samples
    label = np.full(len(distance), -1)
    current = 0
    for i in range(len(distance)):
        if not core[i] or label[i] != -1:
            continue
        label[i] = current
        queue = [i]
        while queue:
            p = queue.pop()
            if core[p]:
                for q in np.flatnonzero(near[p] & (label == -1)):
                    label[q] = current
                    queue.append(q)
        current += 1
    # a border point goes to the smallest cluster among its core neighbours
    for i in np.flatnonzero(~core):
        mine = label[near[i] & core]
        label[i] = mine.min() if len(mine) else -1
    return label


@pytest.mark.parametrize("seed,eps_km,min_samples,compared", [(0, 40.0, 3, 4096), (1, 120.0, 5, 16)])
def test_spatial_dbscan_matches_brute_force(spark, monkeypatch, seed, eps_km, min_samples, compared):
    monkeypatch.setattr(neighbours, "COMPARED_PAIRS", compared)
    lat, lon, amount = sites(seed, 200, 100)
    out = cluster.spatial_dbscan(frame(spark, lat, lon, amount), eps_km, min_samples).orderBy("op_id").collect()
    want = brute_dbscan(haversine(lat[:, None], lon[:, None], lat[None, :], lon[None, :]), eps_km, min_samples)
    assert [r.Spatial_Cluster for r in out] == list(want)
    assert [r.Is_Noise for r in out] == [w == -1 for w in want]


def test_strict_mode_uses_standardised_coordinates(spark):
    lat, lon, amount = sites(3, 80, 60)
    out = cluster.spatial_dbscan(frame(spark, lat, lon, amount), 20.0, 3, strict=True).orderBy("op_id").collect()
    z = np.column_stack([(lat - lat.mean()) / lat.std(), (lon - lon.mean()) / lon.std()])
    distance = np.sqrt(((z[:, None] - z[None, :]) ** 2).sum(axis=2))
    assert [r.Spatial_Cluster for r in out] == list(brute_dbscan(distance, 20.0 / 111.0, 3))


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    nodes = spark.range(n + 2).select(F.col("id").alias("node"))
    got = {r.node: r.root for r in cluster.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, n: n, n + 1: n + 1}


def test_hull_area_and_density(spark):
    rng = np.random.default_rng(5)
    lat, lon = np.append(rng.uniform(-20, -10, 300), [-20, -20, -10, -10]), np.append(rng.uniform(-60, -50, 300), [-60, -50, -60, -50])
    row = geo.density(frame(spark, lat, lon, np.ones(304)).repartition(7)).first()
    want = 100.0 * 111.0**2 * np.cos(np.radians(lat.mean()))
    assert row.convex_hull_area_km2 == pytest.approx(want, rel=1e-9)
    assert row.points_per_km2 == pytest.approx(304 / want, rel=1e-9)
    line = geo.density(frame(spark, np.arange(5.0), np.arange(5.0), np.ones(5))).first()
    assert (line.convex_hull_area_km2, line.points_per_km2) == (0.0, 0.0)


def moran_brute(lat, lon, x):
    d = np.sqrt((lat[:, None] - lat[None, :]) ** 2 + (lon[:, None] - lon[None, :]) ** 2)
    w = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
    r = w.sum(axis=1)
    w = np.divide(w, r[:, None], out=np.zeros_like(w), where=r[:, None] != 0)
    z = x - x.mean()
    i = len(x) / w.sum() * (w * np.outer(z, z)).sum() / (z**2).sum()
    c = (len(x) - 1) * (w * (x[:, None] - x[None, :]) ** 2).sum() / (2 * w.sum() * (z**2).sum())
    return i, c, w, z


def test_autocorrelation_in_blocks(spark):
    lat, lon, amount = sites(6, 90, 40)
    df = frame(spark, lat, lon, amount)
    i, c, w, z = moran_brute(lat, lon, amount)
    assert geo.simple_moran(df).first().morans_i == pytest.approx(i, rel=1e-9)
    assert geo.geary(df).first().gearys_c == pytest.approx(c, rel=1e-9)
    got = geo.moran(df).first()
    n, s0 = len(z), w.sum()
    s1 = 0.5 * ((w + w.T) ** 2).sum()
    s2 = ((w.sum(axis=1) + w.sum(axis=0)) ** 2).sum()
    b2 = n * (z**4).sum() / (z**2).sum() ** 2
    var = (n * ((n**2 - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - b2 * ((n**2 - n) * s1 - 2 * n * s2 + 6 * s0**2)) / (
        (n - 1) * (n - 2) * (n - 3) * s0**2
    ) - 1 / (n - 1) ** 2
    assert got.variance == pytest.approx(var, rel=1e-7)
    assert got.z_score == pytest.approx((i + 1 / (n - 1)) / np.sqrt(var), rel=1e-6)


def test_kernel_sums_do_not_depend_on_block_size(spark):
    lat, lon, amount = sites(7, 60, 20)
    pts = frame(spark, lat, lon, amount).select(
        F.col("op_id").alias("id"), F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"), F.col("CFEM").alias("a")
    )
    sums = {"r": (None, 1), "q": ("a", 1)}
    one = {r.id: (r.r, r.q) for r in geo.kernel_sums(pts, sums).collect()}
    many = {r.id: (r.r, r.q) for r in geo.kernel_sums(pts, sums, block=17).collect()}
    assert one.keys() == many.keys()
    for k in one:
        assert one[k] == pytest.approx(many[k], rel=1e-10)


def test_isolated_point_scores_zero_and_twins_weigh_nothing(spark):
    df = frame(spark, np.array([-10.0, -30.0, -30.0]), np.array([-50.0, -60.0, -60.0]), np.array([5.0, 1.0, 2.0]))
    out = {r.op_id: r.Hotspot_Score for r in geo.hotspot_scores(df).collect()}
    assert out[0] == 0.0
    assert out[1] == out[2] == pytest.approx(3.0 * np.log(3))


@pytest.mark.parametrize("finest, most", [(1, 16), (8, 1), (1000, 16)])
def test_pyramid_of_any_depth_gives_the_same_totals(spark, monkeypatch, finest, most):
    monkeypatch.setattr(neighbours, "FINEST_POINTS", finest)
    monkeypatch.setattr(neighbours, "MOST_LEVELS", most)
    monkeypatch.setattr(neighbours, "COMPARED_PAIRS", 4)
    lat, lon, amount = sites(n=60, dense=120)
    amount[3] = 1e16  # beyond what is added in integers
    d = haversine(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    got = {(r.lat, r.lon): (r.neighbours, r.local_sum) for r in geo.neighbour_totals(frame(spark, lat, lon, amount), radius_km=80.0).collect()}
    for i in range(len(lat)):
        near = d[i] <= 80.0
        assert got[lat[i], lon[i]] == (near.sum(), pytest.approx(amount[near].sum(), rel=1e-12))


@pytest.mark.parametrize("block", [32768, 24])
def test_blocks_match_brute_force(spark, monkeypatch, block):
    """Dense cells are folded in blocks; infinite amounts, border distances and both folds included."""
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", block)
    monkeypatch.setattr(neighbours, "COMPARED_PAIRS", 4)
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.integers(0, 60, (500, 2)), rng.integers(0, 12, (300, 2)) / 4 + 20])
    xy = np.unique(xy.astype(float), axis=0)
    whole = rng.integers(-(2**45), 2**45, len(xy))
    real = np.where(np.arange(len(xy)) % 97 == 5, np.inf, rng.uniform(0, 9, len(xy)))
    rows = [(i, float(x), float(y), int(w), float(v), i) for i, ((x, y), w, v) in enumerate(zip(xy, whole, real))]
    points = spark.createDataFrame(rows, "id long, x double, y double, w long, v double, least long")
    found = neighbours.neighbour_aggregate(
        points.select("id", "x", "y"), points.drop("id"), ["x", "y"], 5.0, {"w": F.sum, "v": F.sum, "least": F.min}
    ).collect()
    near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= 25
    assert sorted(r.id for r in found) == list(range(len(xy)))
    for r in found:
        assert r.w == whole[near[r.id]].sum()
        assert r.v == pytest.approx(real[near[r.id]].sum(), rel=1e-9)
        assert r.least == np.flatnonzero(near[r.id]).min()


def test_crossing_cells_end_as_blocks(spark):
    """What is judged by cells does not grow with the points: 40 times the points, the same pairs of cells."""
    def judged(n):
        xy = np.random.default_rng(2).uniform(0, 5, (n, 2)).tolist()
        points = spark.createDataFrame(xy, "x double, y double")
        f = neighbours.frontier(points, points, ["x", "y"], 1.0, same_points=True, blocked=True)
        return sum(pairs.count() for _, pairs in f.inside + f.compare + f.blocks)

    assert judged(20000) == judged(500)


@pytest.mark.parametrize("compared, block", [(1500, 32768), (4, 32768), (4, 24)])
def test_touching_cells_match_brute_force(spark, monkeypatch, compared, block):
    """Cells touch by one pair of points, also one exactly the radius apart; settled by ends, in blocks or refined."""
    monkeypatch.setattr(neighbours, "COMPARED_PAIRS", compared)
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", block)
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.integers(0, 160, (250, 2)) / 4, rng.integers(0, 40, (400, 2)) / 8 + 20])
    xy = np.unique(xy, axis=0)
    points = spark.createDataFrame(xy.tolist(), "x double, y double")
    side = 5.0 / np.sqrt(2) * (1 - 1e-9)
    got = {tuple(r) for r in neighbours.touching_cells(points, ["x", "y"], 5.0, side).collect()}
    cell = [tuple(c) for c in np.floor(xy / side).astype(int).tolist()]
    near = np.argwhere(((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= 25)
    assert got == {cell[i] + cell[j] for i, j in near if cell[i] < cell[j]}


def test_touching_cells_do_not_multiply_points(spark, monkeypatch):
    """Dense cells meet as boxes, ends and blocks: no pair of cells is refined or compared as rows."""
    found = []
    plain = neighbours.frontier
    monkeypatch.setattr(neighbours, "frontier", lambda *a, **k: found.append(plain(*a, **k)) or found[-1])
    points = spark.createDataFrame(np.random.default_rng(3).uniform(0, 4.9, (20000, 2)).tolist(), "x double, y double")
    assert neighbours.touching_cells(points, ["x", "y"], 1.0, 0.7).count() > 100
    (f,) = found
    assert not f.compare and {level for level, _ in f.inside + f.blocks} == {0}
    # most pairs are settled without sending a point
    assert sum(p.count() for _, p in f.inside) > sum(p.count() for _, p in f.blocks)


def test_hotspots_write_places_and_not_operations(spark, monkeypatch):
    """Scores are written per place and weighed by its operations; the operations are not written again."""
    written, plain = [], geo.stage
    monkeypatch.setattr(geo, "stage", lambda df: written.append(df.columns) or plain(df))
    rng = np.random.default_rng(4)
    at = rng.integers(0, 40, 400) ** 2 // 40  # few places with many operations, many with few
    lat, lon = -20 + at * 0.31, -50 + at * 0.17
    amount = rng.uniform(1, 100, 400).round(2)
    out = geo.hotspot_scores(frame(spark, lat, lon, amount), radius_km=60.0)
    assert not any("op_id" in columns or "CFEM" in columns for columns in written)
    rows = out.collect()
    assert len(rows) == 400
    near = haversine(lat[:, None], lon[:, None], lat[None, :], lon[None, :]) <= 60.0
    n = near.sum(axis=1)
    score = np.where(n > 1, (near * amount).sum(axis=1) * np.log(n + 1), 0.0)
    p70, p85, p95 = np.quantile(score, [0.7, 0.85, 0.95])
    for r in rows:
        s = score[r.op_id]
        assert r.Hotspot_Score == pytest.approx(s, rel=1e-12)
        if min(abs(s - p) for p in (p70, p85, p95)) > 1e-6:
            assert r.Hotspot_Category == ("Very Hot" if s > p95 else "Hot" if s > p85 else "Warm" if s > p70 else "Cold")


@pytest.mark.parametrize("same", [False, True])
def test_points_that_serve_their_own_block(spark, monkeypatch, same):
    """With the same points on both sides a block's own points are sent once and folded with each other."""
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 400)
    monkeypatch.setattr(neighbours, "COMPARED_PAIRS", 4)
    xy = np.random.default_rng(5).uniform(0, 30, (1500, 2))
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(xy.tolist())], "least long, x double, y double")
    left = points.withColumn("id", F.col("least"))
    found = neighbours.neighbour_aggregate(
        left if same else left.select("id", "x", "y"), points, ["x", "y"], 3.0, {"least": F.min}, same_points=same
    ).collect()
    near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= 9
    assert {r.id: r.least for r in found} == {i: int(np.flatnonzero(near[i]).min()) for i in range(len(xy))}


def kernel_points(spark, seed: int, n: int = 3000):
    """Places spread out, in a dense town and on one spot, with weights of both signs; some share a place."""
    rng = np.random.default_rng(seed)
    lon = np.concatenate([rng.uniform(-74, -32, n), rng.normal(-50, 1e-3, n), np.full(5, -40.0), [-74.0, -32.0]])
    lat = np.concatenate([rng.uniform(-34, 6, n), rng.normal(-20, 1e-3, n), np.full(5, -10.0), [-34.0, 6.0]])
    lon[:20], lat[:20] = lon[20:40], lat[20:40]
    a = rng.normal(0, 1, len(lon))
    return lat, lon, a, spark.createDataFrame(
        [(i, *row) for i, row in enumerate(np.column_stack([lat, lon, a]).tolist())], "id long, lat double, lon double, a double"
    )


def test_far_cells_give_the_sums_of_all_pairs(spark, monkeypatch):
    """Many blocks, of sizes far apart, with cells that act through nodes: the sums of brute force."""
    from garimpo.operators import far

    lat, lon, a, points = kernel_points(spark, 11)
    monkeypatch.setattr(far, "BLOCK_PLACES", 600)
    monkeypatch.setattr(far, "LEAF_PLACES", 450)
    monkeypatch.setattr(far, "FEW_PAIRS", 64)
    sums = {"r": (None, 1), "q": ("a", 1), "r2": (None, 2)}
    got = {r.id: (r.r, r.q, r.r2) for r in geo.kernel_sums(points, sums, paired=False).collect()}
    with np.errstate(divide="ignore"):
        v = 1 / np.sqrt((lat[:, None] - lat) ** 2 + (lon[:, None] - lon) ** 2)
    v[~np.isfinite(v)] = 0.0
    found = np.array([got[i] for i in range(len(lat))])
    assert found[:, 0] == pytest.approx(v.sum(axis=1), rel=1e-12)
    assert (np.abs(found[:, 1] - v @ a) <= 1e-12 * (v @ np.abs(a))).all()
    assert found[:, 2] == pytest.approx((v * v).sum(axis=1), rel=1e-12)


def test_blocks_near_a_block_stay_few(spark, monkeypatch):
    """A place is sent to the blocks around its own, not to all of them, however uneven the places are."""
    from garimpo.operators import far

    monkeypatch.setattr(far, "BLOCK_PLACES", 200)
    for points in (kernel_points(spark, 12)[3], kernel_points(spark, 13, 400)[3]):
        upper = far.Upper(points.select("lat", "lon").distinct())
        near = [len(upper.around(leaf)[0]) for leaf in upper.leaves]
        assert len(upper.leaves) > 20 and max(near) <= 64 and np.mean(near) <= 20


def test_many_places_are_not_paired_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(geo, "PAIRED_PLACES", 50)
    monkeypatch.setattr(geo, "_paired_sums", None)
    points = kernel_points(spark, 14, 200)[3]
    nowhere = spark.createDataFrame([(9999, float("nan"), 0.0, 1.0)], points.schema)
    got = {r.id: r.r for r in geo.kernel_sums(points.unionByName(nowhere), {"r": (None, 1)}).collect()}
    assert len(got) == 408 and got[9999] == 0.0


def test_connected_cells_are_not_searched(spark, monkeypatch):
    """Cells that others connect need no pair of points; DBSCAN still tells clusters apart that only blocks can."""
    sent, plain = [], neighbours._block_rows
    monkeypatch.setattr(neighbours, "_block_rows", lambda f, *a, **k: sent.append(sum(p.count() for _, p in f.blocks)) or plain(f, *a, **k))
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 9, (20000, 2))
    xy = xy[np.abs(xy[:, 0] - 4.5) > 0.495]  # a moat about as wide as the radius
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(xy.tolist())], "id long, x double, y double")
    got = {r.id: r.cluster for r in cluster.dbscan(points, ["x", "y"], 1.0, 3).collect()}
    left, right = xy[(xy[:, 0] > 3.9) & (xy[:, 0] < 4.5)], xy[(xy[:, 0] > 4.5) & (xy[:, 0] < 5.1)]
    one = (((left[:, None] - right[None]) ** 2).sum(axis=2) <= 1).any()
    assert len(set(got.values())) == (1 if one else 2) and min(got.values()) == 0
    # all pairs lie across the moat: 13 cells high, and not the hundreds inside the two halves
    assert sum(sent) < 200


def test_jobs_side_by_side_share_broadcasts(spark):
    from garimpo import schema

    def hinted(rows):
        return "broadcast" in schema.sized_broadcast(spark.range(rows), 100)._jdf.queryExecution().logical().toString().lower()

    assert hinted(100)
    with schema.sharing(spark, 4):
        assert hinted(25) and not hinted(26)
        with schema.sharing(spark, 2):
            assert not hinted(13)
    assert hinted(100) and not hinted(101)
