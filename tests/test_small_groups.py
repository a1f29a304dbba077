"""Groups that fit an array or a window meet without a shuffle of their own, with the results of the longer ways."""

import re

import numpy as np
import pytest

from rankloom.operators import features as X
from rankloom.operators.grouping import robust_z


@pytest.fixture()
def space(spark):
    rng = np.random.default_rng(5)
    rows = [(g if g else None, i, str(rng.integers(0, 3)) if g != 2 else "a", *map(float, rng.integers(0, 4, 3) / 10)) for g in range(5) for i in range(14)]
    return spark.createDataFrame(rows, "g long, i long, run string, a double, b double, c double").repartition(3)


def same(first, second):
    first, second = ({(r["g"], r["i"]): r.asDict() for r in df.collect()} for df in (first, second))
    assert first.keys() == second.keys() and len(first) == 70
    assert all(first[k][c] == pytest.approx(second[k][c]) for k in first for c in second[k])


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range|RoundRobin)partitioning", df._jdf.queryExecution().sparkPlan().toString())) or len(
        re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]))


@pytest.mark.parametrize("find", [
    lambda df: X.cross_run_features(df, ["g"], ["a", "b", "c"], "run", "i"),
    lambda df: X.density_features(df, ["g"], ["a", "b", "c"], "i")])
def test_small_groups_take_one_shuffle_and_equal_the_blocks(space, monkeypatch, find):
    short = find(space)
    assert shuffles(short) == 1
    monkeypatch.setattr(X, "HELD", 0)
    same(short, find(space))


def test_scaled_columns_take_one_shuffle_and_equal_the_hot_way(spark, space):
    df = space.where("g is not null")
    short = robust_z(df, ["g"], {"a": "za", "b": "zb"})
    assert shuffles(short) == 1
    spark.conf.set("spark.rankloom.hotGroupRows", "5")
    try:
        longer = robust_z(df, ["g"], {"a": "za", "b": "zb"}).collect()
    finally:
        spark.conf.unset("spark.rankloom.hotGroupRows")
    want = {(r["g"], r["i"]): (r["za"], r["zb"]) for r in longer}
    assert {(r["g"], r["i"]): (pytest.approx(r["za"]), pytest.approx(r["zb"])) for r in short.collect()} == want


def test_pose_pairs_take_one_shuffle_and_equal_the_blocks(spark, monkeypatch):
    from rankloom.operators import consensus as Q

    rng = np.random.default_rng(8)
    unit = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = []
    for g in range(4):
        for i in range(12):
            m = list(unit)
            m[0], m[3], m[7] = (-1.0 if i % 5 == 0 else 1.0), *map(float, rng.uniform(0, 4, 2))
            rows.append((g, i, m, [(0.0, 0.0, 0.0), (1.0, 2.0, 3.0)], 0.5, 1.0, 1.5))
    df = spark.createDataFrame(rows, "g long, candidate_index long, transform array<double>, sample array<struct<x:double,y:double,z:double>>, sx double, sy double, sz double")
    short = Q.pose_pairs(df.repartition(3), ["g"], 2.0)
    assert shuffles(short) == 1
    monkeypatch.setattr(Q, "HELD", 0)
    first, second = ({(r["g"], r["candidate_index"], r["other"]): r["gap_mm"] for r in d.collect()} for d in (short, Q.pose_pairs(df, ["g"], 2.0)))
    assert first.keys() == second.keys() and len(first) > 48
    assert all(first[k] == pytest.approx(second[k]) for k in first)


def test_blended_choices_do_not_multiply_rows(spark):
    from rankloom.operators import selection as S

    rng = np.random.default_rng(9)
    rows = [(int(g), int(i), float(a), float(b), float(i)) for g in range(4) for i, (a, b) in enumerate(rng.integers(0, 5, (9, 2)))]
    df = spark.createDataFrame(rows, "g long, candidate_index long, a double, b double, e double")
    got = {(r["g"], r["alpha"]): r["e"] for r in S.blended_choices(df, ["g"], "a", "b", [0.0, 0.3, 1.0], "e").collect()}
    want = {}
    for r in S.rank_blend(df, ["g"], "a", "b", [0.0, 0.3, 1.0]).collect():
        key, score = (r["g"], r["alpha"]), (round(r["blend_score"], 9), r["candidate_index"])
        want[key] = min(want.get(key, (score, r["e"])), (score, r["e"]))
    assert got == {k: v[1] for k, v in want.items()}
