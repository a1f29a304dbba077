"""Context columns of groups that meet whole equal those by blocks and joins; many columns are rounded as one array."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import features as X
from rankloom.plans.bindings import all_rounded, rounded

KEYS = ["case_id", "jaw"]


@pytest.fixture()
def pool(spark):
    rng = np.random.default_rng(3)
    rows = []
    for case, size in ((1, 9), (2, 14), (3, 1), (4, 14), (None, 5)):
        for i in range(size):
            turn = float(rng.integers(0, 4)) * 10
            c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
            shift = [float(v) for v in rng.integers(0, 4, 3)]
            matrix = [c, -s, 0.0, shift[0], s, c, 0.0, shift[1], 0.0, 0.0, 1.0, shift[2], 0.0, 0.0, 0.0, 1.0]
            rows.append((case, "upper", i, "A" if case == 4 else str(rng.integers(0, 3)), float(rng.integers(0, 5)), float(rng.integers(0, 9)) / 7,
                         None if i % 3 else "axial_lower_1", "full" if i % 2 else "low", matrix, shift, [0.5, 1.0, 2.0]))
    return spark.createDataFrame(rows, """case_id long, jaw string, candidate_index long, candidate_run string, selection_score_mm double, fit_score_mm double,
        target string, source_variant string, transform array<double>, predicted_full_centroid array<double>, jaw_reference_center array<double>""").repartition(3)


@pytest.mark.parametrize("held", [0, 10])
def test_groups_that_meet_whole_equal_the_blocks(pool, monkeypatch, held):
    def read():
        df, names = X.context_features(pool, KEYS, region_view=True)
        assert len(names) == 102
        return {(r["case_id"], r["candidate_index"]): [r[n] for n in names] for r in df.collect()}

    short = read()
    monkeypatch.setattr(X, "HELD", held)
    longer = read()
    assert short.keys() == longer.keys() and len(short) == 43
    assert all(short[k] == pytest.approx(longer[k]) for k in short)


def test_groups_that_meet_whole_are_shuffled_once_and_not_written(pool, monkeypatch):
    monkeypatch.setattr(X, "cut_lineage", lambda df: pytest.fail("wide columns were written"))
    df, _ = X.context_features(pool, KEYS)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("collect_list") == 2  # one aggregate, partial and final


def test_rounded_columns_as_one_array(spark):
    values = [0.0, -0.0, 2.5e-6, -2.5e-6, 1.000005, -7.1234567891, 1e13, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(i, v, None if v is None else -3.0 * v) for i, v in enumerate(values)], "i int, a double, b double")
    got = all_rounded(df, ["i"], ["a", "b"], 9, 5).orderBy("i").collect()
    want = df.select("i", *[rounded(rounded(F.col(c), 9), 5).alias(c) for c in "ab"]).orderBy("i").collect()
    assert [repr(r) for r in got] == [repr(r) for r in want]
    assert "CASE WHEN" not in all_rounded(df, ["i"], ["a", "b"], 5)._jdf.queryExecution().optimizedPlan().toString()
