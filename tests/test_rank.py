"""Order statistics against NumPy and the plain global window."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from garimpo.operators import rank


def frame(spark, values):
    return spark.createDataFrame([(i, f"k{i:05d}", float(v)) for i, v in enumerate(values)], "i long, k string, v double")


def shapes():
    rng = np.random.default_rng(1)
    yield "spread", rng.lognormal(10, 2, 3000)
    third = rng.normal(size=3000)
    third[:1000] = 0.25  # one value holds a third of all rows
    yield "hot value", third
    yield "constant", np.full(500, 7.0)
    yield "single", np.array([3.0])
    yield "few", np.array([1.0, 2.0, 2.0, 10.0])


@pytest.mark.parametrize("name,values", list(shapes()))
def test_quantiles_match_numpy(spark, name, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.95, 1.0]
    got = {r.prob: r.quantile for r in rank.exact_quantiles(frame(spark, values), "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_per_group_and_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.normal(5, 1, 31)]
    rows += [("a", None), ("b", float("nan")), (None, 1.0), ("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.prob): r.quantile for r in rank.exact_quantiles(df, "v", [0.25, 0.5], ("g",)).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g and v is not None and v == v]
        for p in (0.25, 0.5):
            assert got[g, p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert {g for g, _ in got} == {"a", "b", "c"}


def test_quantiles_of_many_groups_stay_distributed(spark, monkeypatch):
    monkeypatch.setattr(rank, "TARGETS_ON_DRIVER", 3)
    df = spark.range(2000).select((F.col("id") % 50).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: r.quantile for r in rank.exact_quantiles(df, "v", [0.5], ("g",)).collect()}
    assert got == {g: float(np.median(np.arange(g, 2000, 50))) for g in range(50)}


@pytest.mark.parametrize("name,values", list(shapes()))
@pytest.mark.parametrize("descending", [False, True])
def test_global_rank_equals_plain_window(spark, name, values, descending):
    df = frame(spark, values)
    got = rank.global_rank(df, "v", "k", descending, running="v")
    value = F.desc("v") if descending else F.asc("v")
    whole = Window.orderBy(value, "k")
    want = df.select("k", "v", F.row_number().over(whole).alias("row"), F.rank().over(Window.orderBy(value)).alias("first"))
    rows = sorted(want.collect(), key=lambda r: r.row)
    a = {r.k: (r.row_rank, r.value_rank) for r in got.collect()}
    assert a == {r.k: (r.row, r.first) for r in rows}
    totals, so_far = {r.k: r.running_total for r in got.collect()}, Fraction(0)
    for r in rows:
        so_far += Fraction(r.v)
        # a decimal has twelve digits behind the point, the rest of each value is added as a double
        assert totals[r.k] == pytest.approx(float(so_far), rel=1e-13, abs=1e-9)


def test_running_total_of_values_beyond_the_decimal(spark):
    values = [1e27, 2.0, 3.5, 1e30, -4.0]
    got = rank.global_rank(frame(spark, values), "v", "k", running="v")
    totals = [r.running_total for r in sorted(got.collect(), key=lambda r: r.row_rank)]
    assert totals == [-4.0, -2.0, 1.5, 1e27 + 1.5, 1e30 + 1e27]


def test_hot_value_is_split_by_key(spark):
    values = [5.0] * 4000 + list(range(100))
    got = rank.global_rank(frame(spark, values), "v", "k")
    assert got.rdd.getNumPartitions() > 0
    assert {r.row_rank for r in got.collect()} == set(range(1, 4101))


def test_rank_does_not_depend_on_partitioning(spark):
    df = frame(spark, np.random.default_rng(3).normal(size=500))
    one = rank.global_rank(df.repartition(1), "v", "k").orderBy("k").collect()
    many = rank.global_rank(df.repartition(17), "v", "k").orderBy("k").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in many]


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, "b"), (2.0, "b"), (5.0, "b"), (None, "b")], "v double, g string")
    got = {r.g: (r.n, r.rank_sum, r.tie_term) for r in rank.average_ranks(df, "v", "g").collect()}
    assert got == {"a": (2, 1 + 3.0, 8.0), "b": (3, 3.0 + 3.0 + 5.0, 16.0)}


def test_no_row_level_single_partition(spark, ops):
    ranked = rank.global_rank(ops, "CFEM", "op_id")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    # the only unpartitioned window runs over range counts, below an aggregate
    for line in plan.split("Window")[1:]:
        spec = line.split("\n")[0]
        if "[_range" not in spec:
            assert "_n" in spec or "_s" in spec
