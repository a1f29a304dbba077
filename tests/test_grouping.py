import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import grouping as G


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", int(v), i) for i, v in enumerate(rng.integers(0, 40, 700))]
    rows += [(f"g{i % 30}", int(v), i) for i, v in enumerate(rng.integers(0, 40, 300))] + [(None, 3, 5), (None, 1, 6)]
    return spark.createDataFrame(rows, "g string, v int, i int")


def both(spark, run):
    plain = run()
    spark.conf.set(G.HOT_ROWS_SETTING, "25")
    try:
        split = run()
    finally:
        spark.conf.unset(G.HOT_ROWS_SETTING)
    return sorted(map(tuple, plain), key=str), sorted(map(tuple, split), key=str)


def test_positions_do_not_depend_on_the_skew_path(spark, skewed):
    plain, split = both(spark, lambda: G.positions(skewed, ["g"], [F.col("v"), F.col("i")], "p", "n").collect())
    assert len(plain) == 1002 and plain == split


def test_ranks_and_quantiles_do_not_depend_on_the_skew_path(spark, skewed):
    plain, split = both(spark, lambda: G.lowest_fraction(skewed, ["g"], F.col("v"), "r").collect())
    assert plain == split
    plain, split = both(spark, lambda: G.quantiles(skewed, ["g"], "v", {"a": 0.25, "b": 0.9}).select(
        "g", F.round("a", 9), F.round("b", 9)).collect())
    assert plain == split


def test_quantiles_match_numpy(spark, skewed):
    got = {r["g"]: r["q"] for r in G.quantiles(skewed, ["g"], "v", {"q": 0.9}).collect()}
    hot = [r["v"] for r in skewed.where("g = 'hot'").collect()]
    assert got["hot"] == pytest.approx(np.quantile(hot, 0.9))


@pytest.mark.parametrize("limit", ["1000000", "25"])
def test_quantiles_without_a_unit(spark, skewed, limit):
    spark.conf.set(G.HOT_ROWS_SETTING, limit)
    rows = skewed.where("g is not null").withColumn("u", F.col("i") % 7)
    got = {(r["g"], r["u"]): r["q"] for r in G.quantiles_without(rows, ["g"], "u", "v", ["i"], {"q": 0.9}).collect()}
    spark.conf.unset(G.HOT_ROWS_SETTING)
    data = rows.collect()
    for (g, u), q in got.items():
        rest = [r["v"] for r in data if r["g"] == g and r["u"] != u]
        assert q == pytest.approx(np.quantile(rest, 0.9))


def test_shuffling_rows_changes_nothing(spark, skewed):
    a = G.ordinal_fraction(skewed, ["g"], [F.col("v"), F.col("i")], "r").collect()
    b = G.ordinal_fraction(skewed.repartition(7, "i"), ["g"], [F.col("v"), F.col("i")], "r").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_top_k_is_limited_before_the_shuffle(spark, skewed):
    plan = G.top_k(skewed, ["g"], [F.col("v"), F.col("i")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
