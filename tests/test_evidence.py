"""Consensus of small groups against the joins for larger ones."""

import numpy as np
import pytest

from rankloom.operators import consensus as Q


def test_small_groups_take_no_checkpoint_and_equal_the_joins(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        for i in range(14):
            m = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
            m[0], m[3], m[7] = (-1.0 if i % 6 == 0 else 1.0), *map(float, rng.uniform(0, 5, 2))
            rows.append((g, i, m, [(0.0, 0.0, 0.0), (1.0, 2.0, 3.0)], 0.5, 1.0, 1.5, "ab"[i % 2], "xyz"[i % 3], int(i % 4) - 1, "l", float(rng.uniform(0, 2))))
    df = spark.createDataFrame(rows, "g long, candidate_index long, transform array<double>, sample array<struct<x:double,y:double,z:double>>, sx double, sy double, "
                               "sz double, view string, family string, threshold_cell int, side string, selection double")
    written, cut = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda d: written.append(1) or cut(d))
    find = lambda: {r["g"]: r.asDict() for r in Q.evidence_consensus(df, ["g"], 2.0, 1.9, {"evidence": 2, "views": 2}).collect()}
    small = find()
    assert not written
    monkeypatch.setattr(Q, "GRAPH", 0)
    wide = find()
    assert written and small.keys() == wide.keys() and small
    for g, row in small.items():
        assert row == {k: pytest.approx(v) for k, v in wide[g].items()}
