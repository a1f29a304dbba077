"""Pseudo targets and the sweep of two families take no sort or shuffle of their own beyond the groups, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import consensus as Q
from rankloom.operators import contents as C


def poses(spark, seed, n=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = np.eye(4)
        m[:3, 3] = rng.integers(0, 4, 3)
        m[0, 0] = 1 if i % 3 else -1
        rows.append((f"c{i % 4}", "upper", i, i // 4 + 1, m.reshape(-1).tolist()))
    return spark.createDataFrame(rows, "case_id string, jaw string, candidate_index int, place int, transform array<double>")


def test_packed_points_equal_rows(spark, monkeypatch):
    labels = poses(spark, 2).where("place = 1").select("case_id", "jaw", "transform", F.lit(0.5).alias("predicted_tre_mm"), F.lit(0.9).alias("confidence"),
                                                       F.when(F.col("case_id") == "c3", "none").otherwise("s").alias("set_id"))
    points = spark.createDataFrame([("s", float(i), float(i * i % 5), 1.0) for i in range(7)], "set_id string, x double, y double, z double")

    def read():
        out = C.pseudo_targets(poses(spark, 1), labels, points, ["case_id", "jaw"], "set_id", "hypot")
        return out, {r["candidate_index"]: r["pseudo_tre_mm"] for r in out.collect()}

    out, packed = read()
    assert "Aggregate [case_id" not in out._jdf.queryExecution().optimizedPlan().toString() and len(packed) == 18
    monkeypatch.setattr(C, "PACKED", 0)
    assert packed == pytest.approx(read()[1])


def test_sweep_does_not_multiply_pairs(spark):
    a, b = poses(spark, 3), poses(spark, 4).where("place <= 5")
    out = Q.cross_family_sweep(a, b, ["case_id", "jaw"], [F.lit(0.0)] * 3, [1, 6], [0.0, 1.0])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate") and "a_transform" in out.columns
    got = {(r["case_id"], r["top"], r["weight"]): (r["a_index"], r["b_index"]) for r in out.collect()}
    sides = [df.collect() for df in (a, b)]
    sign = lambda m: np.sign(np.linalg.det(np.array(m).reshape(4, 4)[:3, :3]))
    anchors = [np.array(v) for v in [(0, 0, 0), (20, 0, 0), (-20, 0, 0), (0, 20, 0), (0, -20, 0), (0, 0, 20), (0, 0, -20)]]
    want = {}
    for top in (1, 6):
        for weight in (0.0, 1.0):
            for x in sides[0]:
                for y in sides[1]:
                    if x["case_id"] != y["case_id"] or sign(x["transform"]) != sign(y["transform"]) or x["place"] > top or y["place"] > top:
                        continue
                    m, n = (np.array(r["transform"]).reshape(4, 4) for r in (x, y))
                    gap = np.mean([np.linalg.norm((m - n)[:3, :3] @ p + (m - n)[:3, 3]) for p in anchors])
                    cost = gap + weight * ((x["place"] - 1) / max(min(6, top) - 1, 1) + (y["place"] - 1) / max(min(5, top) - 1, 1))
                    entry = (round(cost, 9), round(gap, 9), x["place"], y["place"], x["candidate_index"], y["candidate_index"])
                    key = (x["case_id"], top, weight)
                    want[key] = min(want.get(key, entry), entry)
    assert got == {k: v[4:] for k, v in want.items()} and got
