import numpy as np
import pytest

from rankloom.operators import registration as R
from rankloom.operators import spatial as X
from rankloom.operators import voxels as V


def cloud(spark, seed, n, copies=0):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)).round(3)
    if copies:
        p[:copies] = p[0]
    rows = [("s", i, *map(float, v)) for i, v in enumerate(p)]
    return p, spark.createDataFrame(rows, "set_id string, point_id long, x double, y double, z double")


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 4)
    monkeypatch.setattr(X, "FANOUT", 3)


def test_nearest_equals_brute_force_over_several_levels(spark, small_blocks):
    assert X.levels_for(160) >= 2
    q, qd = cloud(spark, 1, 90, copies=30)
    t, td = cloud(spark, 2, 160, copies=50)
    got = {r["point_id"]: r["distance"] for r in X.nearest(qd, td, ["set_id"]).collect()}
    want = np.linalg.norm(q[:, None] - t[None], axis=2).min(axis=1)
    assert len(got) == 90 and all(got[i] == pytest.approx(want[i]) for i in range(90))


def test_counts_equal_brute_force_over_several_levels(spark, small_blocks):
    p, d = cloud(spark, 3, 120, copies=40)
    got = {r["point_id"]: (r["within_0"], r["within_1"]) for r in X.near_counts(d, d, ["set_id"], ["x", "y", "z"], [0.5, 4.0]).collect()}
    gap = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert all(got[i] == ((gap[i] <= 0.5).sum(), (gap[i] <= 4.0).sum()) for i in range(120))


def test_nearest_other_point_sees_copies(spark, small_blocks):
    p, d = cloud(spark, 4, 60, copies=5)
    got = {r["point_id"]: r["distance"] for r in X.nearest(d, d, ["set_id"], exclude_self=True).collect()}
    gap = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    assert all(got[i] == pytest.approx(gap[i].min()) for i in range(60))


def test_trim_rules_never_keep_more_than_there_is(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(X.keep_rows(F.lit(10), 0.7, 32, "floor").alias("a"), X.keep_rows(F.lit(101), 0.2, 1, "ceil").alias("b"))
    assert tuple(df.first()) == (10, 21)


def test_alignment_recovers_a_small_motion(spark):
    p, target = cloud(spark, 5, 120)
    a = np.radians(4.0)
    rot = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    moved = (p - [0.05, -0.02, 0.03]) @ rot
    source = spark.createDataFrame([("s", i, *map(float, v)) for i, v in enumerate(moved)], target.schema)
    job = spark.createDataFrame([("j", "s", np.eye(4).reshape(-1).tolist())], "job_id string, set_id string, transform array<double>")
    out = R.trimmed_alignment(job, source, target, (1.0, 0.5), 3).first()["transform"]
    full = np.array(out).reshape(4, 4)
    back = moved @ full[:3, :3].T + full[:3, 3]
    assert np.abs(back - p).max() < 0.05


def flood(cells, connectivity):
    left, out = set(cells), []
    steps = V.offsets(connectivity)
    while left:
        stack, part = [left.pop()], set()
        while stack:
            at = stack.pop()
            part.add(at)
            for o in steps:
                n = tuple(a + b for a, b in zip(at, o))
                if n in left:
                    left.remove(n)
                    stack.append(n)
        out.append(frozenset(part))
    return set(out)


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_equal_flood_fill(spark, connectivity):
    rng = np.random.default_rng(6)
    cells = {tuple(map(int, c)) for c in np.argwhere(rng.random((9, 9, 9)) < 0.25)} | {(20 + i, 0, 0) for i in range(40)}
    df = spark.createDataFrame([("c", *c) for c in sorted(cells)], "case_id string, i int, j int, k int")
    groups = {}
    for r in V.connected_components(df, ["case_id"], connectivity).collect():
        groups.setdefault(r["label"], set()).add((r["i"], r["j"], r["k"]))
    assert {frozenset(g) for g in groups.values()} == flood(cells, connectivity)


def test_nearest_in_many_dimensions(spark):
    """More blocks than one level holds, in twelve dimensions with clusters: the bound of each query drops far blocks."""
    import numpy as np

    from rankloom.operators.spatial import nearest

    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 12))
    points = np.concatenate([c + 0.05 * draw.normal(size=(130, 12)) for c in centres])
    dims = [f"d{i}" for i in range(12)]
    rows = [("s", i, *map(float, p)) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "set_id string, point_id long, " + ", ".join(f"{d} double" for d in dims))
    got = {r["point_id"]: r["distance"] for r in nearest(frame, frame, ["set_id"], dims, exclude_self=True).collect()}
    gaps = ((points ** 2).sum(1)[:, None] - 2 * points @ points.T + (points ** 2).sum(1)[None, :])
    np.fill_diagonal(gaps, np.inf)
    assert len(got) == len(points)
    assert np.allclose([got[i] for i in range(len(points))], np.sqrt(np.maximum(gaps.min(1), 0)), atol=1e-6)


def test_long_top_lists_are_salted(spark):
    from pyspark.sql import functions as F

    from rankloom.operators.grouping import top_k

    rows = spark.range(6000).select((F.col("id") % 2).alias("g"), F.pmod(F.col("id") * 7919, F.lit(6007)).alias("v"))
    for k in (1000, 1500):
        got = top_k(rows, ["g"], [F.col("v")], k).groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("m")).collect()
        lists = {g: sorted(r["v"] for r in rows.where(F.col("g") == g).collect())[:k] for g in (0, 1)}
        assert {r["g"]: (r["n"], r["m"]) for r in got} == {g: (k, v[-1]) for g, v in lists.items()}
    plan = top_k(rows, ["g"], [F.col("v")], 1500)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2
