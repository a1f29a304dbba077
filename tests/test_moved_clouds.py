"""Blocks of moved sources against blocks of targets, next to plain numpy."""

import numpy as np

from rankloom.operators import registration as R
from rankloom.operators.moved_clouds import meet, source_blocks, target_blocks


def test_moved_points_meet_their_nearest_targets_in_blocks(spark):
    """Several blocks on both sides, a reflected and a turned job, ties by copies and by symmetry. Before, pairs were joined point by point."""
    rng = np.random.default_rng(4)
    source = rng.normal(size=(1300, 3)) * (3, 1, 2)
    goal = np.round(rng.normal(size=(900, 3)) * (3, 1, 2), 1)  # a coarse grid: many copies and equal distances
    rows = [("a", i, *map(float, p)) for i, p in enumerate(source)]
    goals = [("a", 5000 - i, *map(float, p)) for i, p in enumerate(goal)] + [("b", 1, 0.0, 0.0, 0.0)]
    columns = "set_id string, point_id long, x double, y double, z double"
    turn = [0.0, -1.0, 0.0, 0.5, 1.0, 0.0, 0.0, -0.25, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
    flip = [-1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    jobs = spark.createDataFrame([("t", "a", turn), ("f", "a", flip), ("none", "b", flip)], "job_id string, set_id string, transform array<double>")
    held = source_blocks(spark.createDataFrame(rows, columns)), target_blocks(spark.createDataFrame(goals, columns))
    assert held[0].rows.count() == 3 and held[1].rows.where("set_id = 'a'").count() >= 3
    found = meet(jobs, *held).toPandas()
    assert len(found) == 2 * len(source)
    for name, m in (("t", turn), ("f", flip)):
        part = found[found.job_id == name].sort_values("point_id")
        moved = source @ np.reshape(m, (4, 4))[:3, :3].T + np.reshape(m, (4, 4))[:3, 3]
        assert np.allclose(part[["x", "y", "z"]], moved, atol=1e-12)
        gap = np.linalg.norm(part[["x", "y", "z"]].to_numpy()[:, None] - goal[::-1], axis=2)  # lowest id first
        assert np.allclose(part.distance, gap.min(1), atol=1e-12)
        clear = np.sum(gap < gap.min(1)[:, None] + 1e-9, 1) == 1  # rounding decides between others
        assert np.array_equal(part[["u", "v", "w"]].to_numpy()[clear], goal[::-1][gap.argmin(1)][clear])


def test_tied_targets_go_to_the_lowest_id(spark):
    columns = "set_id string, point_id string, x double, y double, z double"
    unit = [float(i % 5 == 0) for i in range(16)]
    jobs = spark.createDataFrame([("j", "a", unit)], "job_id string, set_id string, transform array<double>")
    goals = spark.createDataFrame([("a", "c", -1.0, 0.0, 0.0), ("a", "b", 1.0, 0.0, 0.0), ("a", "d", 1.0, 0.0, 0.0)], columns)
    row = meet(jobs, source_blocks(spark.createDataFrame([("a", "s", 0.0, 0.0, 0.0)], columns)), target_blocks(goals)).first()
    assert (row.point_id, row.distance, row.u) == ("s", 1.0, 1.0)


def test_hot_sets_align_as_others_do(spark):
    """Above the limit of a hot group ranks go through ordered parts."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 3))
    columns = "set_id string, point_id long, x double, y double, z double"
    target = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(points)], columns)
    source = spark.createDataFrame([("a", i, *map(float, p + (0.05, -0.02, 0.01))) for i, p in enumerate(points)], columns)
    unit = [float(i % 5 == 0) for i in range(16)]
    jobs = spark.createDataFrame([("j", "a", unit)], "job_id string, set_id string, transform array<double>")
    plain = R.trimmed_alignment(jobs, source, target, (0.5,), 2).first()
    spark.conf.set("spark.rankloom.hotGroupRows", "100")
    try:
        hot = R.trimmed_alignment(jobs, source, target, (0.5,), 2).first()
    finally:
        spark.conf.unset("spark.rankloom.hotGroupRows")
    assert hot.correspondences == plain.correspondences > 100
    assert np.allclose(hot["transform"], plain["transform"], atol=1e-9)


def test_targets_of_a_set_are_copied_once_for_many_blocks(spark, monkeypatch):
    """Before, each block of moved sources took a copy of every target block it might meet through the shuffle."""
    from rankloom.operators import moved_clouds

    rng = np.random.default_rng(6)
    columns = "set_id string, point_id long, x double, y double, z double"
    points = rng.normal(size=(700, 3))
    target = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(points)] + [("a", 900, float("nan"), 0.0, 0.0), ("n", 1, float("nan"), 0.0, 0.0)], columns)
    source = spark.createDataFrame([("a", i, *map(float, p + 0.001)) for i, p in enumerate(points)] + [("a", 800, float("nan"), 0.0, 0.0), ("n", 1, 0.0, 0.0, 0.0)], columns)
    unit = [float(i % 5 == 0) for i in range(16)]
    jobs = spark.createDataFrame([(f"j{i}", "a", unit) for i in range(9)] + [("k", "n", unit)], "job_id string, set_id string, transform array<double>")
    met = []
    plain = moved_clouds.search

    def watched(kind):
        found = plain(kind)

        def count(left, right):
            import pyarrow as pa

            out = found(left, right)
            return pa.table([*out.columns[:3], pa.array([float(right.num_rows)] * out.num_rows), *out.columns[4:]], schema=kind) if met else out

        return count

    monkeypatch.setattr(moved_clouds, "search", watched)
    held = source_blocks(source), target_blocks(target)
    rows = meet(jobs, *held).toPandas()
    assert len(rows) == 9 * 701 + 1
    assert rows[(rows.point_id == 800) | (rows.set_id == "n")].distance.isna().all()
    clear = rows[(rows.point_id < 700) & (rows.set_id == "a")]
    assert np.allclose(clear[["u", "v", "w"]], points[clear.point_id])
    met.append(True)
    copies = meet(jobs, *held).toPandas().groupby("job_id").distance.first()
    assert (copies.drop("k") == held[1].rows.where("set_id = 'a'").count()).all()
