import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import skyline as sky


def dominates(a, b):
    return (a <= b).all() and (a < b).any()


def brute_ranks(costs):
    ranks = np.full(len(costs), -1)
    level = 0
    while (ranks < 0).any():
        left = np.flatnonzero(ranks < 0)
        ranks[[i for i in left if not any(dominates(costs[j], costs[i]) for j in left if j != i)]] = level
        level += 1
    return ranks


def brute_crowding(costs, keys):
    n, out = len(costs), np.zeros(len(costs))
    if n <= 2:
        return np.full(n, np.inf)
    for m in range(costs.shape[1]):
        order = np.lexsort((keys, costs[:, m]))
        span = costs[order[-1], m] - costs[order[0], m]
        span = span if span > 0 else 1.0
        out[order[[0, -1]]] = np.inf
        for k in range(1, n - 1):
            out[order[k]] += (costs[order[k + 1], m] - costs[order[k - 1], m]) / span
    return out


def table(spark, costs):
    rows = [(i, *map(float, c)) for i, c in enumerate(costs)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double").repartition(5)


@pytest.fixture(scope="module", params=["smooth", "classes", "opposed"])
def costs(request):
    rng = np.random.default_rng(5)
    if request.param == "smooth":
        return rng.random((150, 3)).round(3)
    if request.param == "classes":
        # A third of the rows are copies of one vector.
        c = rng.integers(0, 4, (150, 3)).astype(float)
        c[:50] = [1.0, 0.0, 2.0]
        return c
    x = rng.random(150).round(3)
    return np.column_stack([x, 1 - x, np.zeros(150)])


@pytest.mark.parametrize("block", [8192, 16])
def test_skyline_and_ranks(spark, costs, block):
    df = table(spark, costs)
    want = brute_ranks(costs)
    got = sorted(r["id"] for r in sky.skyline(df, ["a", "b", "c"], block).collect())
    assert got == sorted(np.flatnonzero(want == 0))
    ranks = {r["id"]: r["front"] for r in sky.front_ranks(df, ["a", "b", "c"], block_rows=8192).collect()}
    assert ranks == dict(enumerate(want))


def test_peeling_many_blocks(spark):
    costs = np.random.default_rng(6).random((90, 3)).round(2)
    want = brute_ranks(costs)
    got = {r["id"]: r["front"] for r in sky.front_ranks(table(spark, costs), ["a", "b", "c"], block_rows=60).collect()}
    assert got == dict(enumerate(want))
    capped = {r["id"]: r["front"] for r in sky.front_ranks(table(spark, costs), ["a", "b", "c"], max_rank=1).collect()}
    assert capped == {i: (int(r) if r <= 1 else None) for i, r in enumerate(want)}


@pytest.mark.parametrize("window", [200_000, 7])
def test_crowding(spark, costs, window):
    want = brute_crowding(costs, np.arange(len(costs)))
    got = {r["id"]: r["crowding"] for r in sky.crowding_distance(table(spark, costs), ["a", "b", "c"], "id", window).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(costs))], want, rtol=1e-9)


def test_small_fronts_are_infinite(spark):
    got = sky.crowding_distance(table(spark, np.array([[1, 2, 3], [3, 2, 1]])), ["a", "b", "c"], "id").collect()
    assert [r["crowding"] for r in got] == [float("inf")] * 2
    assert sky.most_spread(sky.crowding_distance(table(spark, np.random.default_rng(1).random((30, 3))), ["a", "b", "c"], "id"), "id", 20).count() == 20


def test_missing_costs_are_beaten_by_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, None, 5.0), (4, float("nan"), 9.0)], "id int, a double, b double")
    assert sorted(r["id"] for r in sky.skyline(df, ["a", "b"]).collect()) == [1, 3, 4]
    ranks = {r["id"]: r["front"] for r in sky.front_ranks(df, ["a", "b"]).collect()}
    assert ranks == {1: 0, 2: 1, 3: 0, 4: 0}
    assert df.where(F.col("a").isNull()).count() == 1


def test_crowding_of_a_long_value_list_over_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    costs = np.column_stack([rng.integers(0, 400, 900), rng.integers(0, 3, 900), rng.random(900).round(2)]).astype(float)
    monkeypatch.setattr(sky, "RANGE_ROWS", 90)
    got = {r["id"]: r["crowding"] for r in sky.crowding_distance(table(spark, costs), ["a", "b", "c"], "id", 8).collect()}
    np.testing.assert_allclose([got[i] for i in range(900)], brute_crowding(costs, np.arange(900)), rtol=1e-9)


def test_crowding_deals_a_frequent_value_over_the_tasks(spark):
    """Rows are joined with their neighbours by key too: rows of one value alone do not meet in one task."""
    df = spark.range(20_000).select("id", F.lit(1.0).alias("a"), F.rand(1).alias("b"))
    plan = sky.crowding_distance(df, ["a", "b"], "id")._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "value" in line]
    assert joins and all("key__" in line for line in joins)


def test_crowding_with_repeated_missing_and_infinite_rows(spark):
    inf = float("inf")
    rows = [(1, 1.0, 5.0), (1, 1.0, 5.0), (2, 2.0, 5.0), (2, 4.0, 7.0), (None, 3.0, 6.0), (3, 3.0, 9.0), (4, inf, 9.5), (5, None, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = {(r["id"], r["a"]): r["crowding"] for r in sky.crowding_distance(df, ["a", "b"], "id").collect()}
    assert len(got) == 7 and got[5, None] == 0.0 and got[None, 3.0] == 0.0
    assert got[1, 1.0] == got[4, inf] == inf


def test_several_fronts_are_peeled_in_a_round(spark, monkeypatch):
    costs = np.random.default_rng(12).random((700, 3)).round(3)
    rounds = []
    whole = sky._front_vectors
    monkeypatch.setattr(sky, "_front_vectors", lambda *a: rounds.append(1) or whole(*a))
    ranks = {r["id"]: r["front"] for r in sky.front_ranks(table(spark, costs), ["a", "b", "c"], block_rows=300).collect()}
    assert ranks == dict(enumerate(brute_ranks(costs)))
    assert not rounds


@pytest.mark.parametrize("shape", ["smooth", "chain", "copies"])
def test_ranks_of_small_blocks_take_few_steps(spark, monkeypatch, shape):
    """Blocks far smaller than a front: the written steps follow the ranges, not the fronts."""
    rng = np.random.default_rng(14)
    costs = rng.random((300, 3)).round(2)
    if shape == "chain":
        costs = np.sort(costs, axis=0) + rng.integers(0, 2, (300, 3)) * 0.01
    elif shape == "copies":
        costs = rng.integers(-2, 3, (300, 3)).astype(float)
        costs[:20, 1], costs[20:40, 0] = np.inf, -np.inf
    steps, cut = [], sky.cut
    monkeypatch.setattr(sky, "cut", lambda df: steps.append(1) or cut(df))
    monkeypatch.setattr(sky, "RANGE_BLOCKS", 3)
    want = brute_ranks(costs)
    got = {r["id"]: r["front"] for r in sky.front_ranks(table(spark, costs), ["a", "b", "c"], block_rows=20).collect()}
    assert got == dict(enumerate(want)) and len(steps) <= 2 + sky.RANGES
    capped = {r["id"]: r["front"] for r in sky.front_ranks(table(spark, costs), ["a", "b", "c"], max_rank=2, block_rows=20).collect()}
    assert capped == {i: (int(r) if r <= 2 else None) for i, r in enumerate(want)}
