"""Sums over pairs of blocks: both sides from one pass, repeated places folded, tables shared."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from garimpo.operators import geo


def test_a_pair_of_blocks_serves_both_sides(monkeypatch):
    monkeypatch.setattr(geo, "TILE", (4, 8))
    rng = np.random.default_rng(3)
    one, other = (pd.DataFrame({"lat": rng.uniform(-9, 9, n), "lon": rng.uniform(-9, 9, n), "w": rng.normal(size=n)}) for n in (11, 21))
    other.loc[5, ["lat", "lon"]] = one.loc[2, ["lat", "lon"]].to_numpy()  # no weight for the same place
    mine, theirs = geo.block_sums(one, other, {"q": ("w", 1), "s": ("w", 2), "t": ("w", 3)})
    away = np.hypot(one.lat.to_numpy()[:, None] - other.lat.to_numpy(), one.lon.to_numpy()[:, None] - other.lon.to_numpy())
    for name, power in (("q", 1), ("s", 2), ("t", 3)):
        kernel = np.where(away > 0, 1 / np.where(away > 0, away, 1) ** power, 0)
        assert mine[name] == pytest.approx(kernel @ other.w.to_numpy(), rel=1e-10)
        assert theirs[name] == pytest.approx(one.w.to_numpy() @ kernel, rel=1e-10)


def test_repeated_places_are_folded_before_they_meet(spark, monkeypatch):
    points = spark.range(600).select(
        "id", (F.col("id") % 3).cast("double").alias("lat"), (F.col("id") % 2).cast("double").alias("lon"), F.lit(1.0).alias("w")
    )
    staged = []
    monkeypatch.setattr(geo, "stage", lambda df, keep=geo.stage: staged.append(keep(df)) or staged[-1])
    got = {r.id: r for r in geo.kernel_sums(points, {"r": (None, 1), "q": ("w", 1)}, block=2).collect()}
    assert staged[0].count() == 6 and len(got) == 600
    assert got[0].r == got[6].r == got[0].q == pytest.approx(100 * (1 + 1 + 0.5 + 1 / 2**0.5 + 1 / 5**0.5))


def test_both_statistics_start_from_one_table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.uniform(-9, 9)), float(rng.uniform(-9, 9)), float(rng.uniform(1, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "op_id long, LATITUDE double, LONGITUDE double, CFEM double")
    sums = geo.row_sums(df)
    assert geo.moran(df, rows=sums).first().morans_i == pytest.approx(geo.simple_moran(df, rows=sums).first().morans_i)
