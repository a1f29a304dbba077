"""Candidate generation and surface matches next to plain numpy runs."""

import numpy as np
import pytest

from rankloom.operators import generation as G
from rankloom.operators import registration as R
from rankloom.sources.stages import SettingsChanged, Stages, cached_bundles


def turn(a, b, c):
    a, b, c = np.radians([a, b, c])
    x = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    y = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    z = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return z @ y @ x


def arch(n, seed, twist=0.0):
    rng = np.random.default_rng(seed)
    t = np.linspace(-1.2, 1.05, n)
    r = 35 + 2.5 * np.sin((2.7 + twist) * t)
    return np.column_stack([r * np.sin(t), 0.55 * r * np.cos(t), 2.2 * np.sin(3.1 * t) + 3 * t]) + rng.normal(scale=0.02, size=(n, 3))


def cloud(*named):
    """Rows (names..., point_id, x, y, z)."""
    return [(*name, i, *map(float, p)) for name, points in named for i, p in enumerate(points)]


def nearest(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1)


def two_way(a, b, m):
    moved = a @ m[:3, :3].T + m[:3, 3]
    there, back = np.sort(nearest(moved, b)), np.sort(nearest(b, moved))

    def mean(d, f):
        return d[:min(len(d), max(32, int(len(d) * f)))].mean()

    return (mean(there, 0.7) + 0.5 * mean(back, 0.35)) / 1.5


def matrix(row):
    return np.array(row.transform).reshape(4, 4)


PLAN = G.Plan(parities=(1,), refine=2, schedule=(4.0, 1.0), rounds=2, least=16)


@pytest.fixture(scope="module")
def job(spark):
    target = arch(160, 1)
    rot, shift = turn(12, -8, 21), np.array([5.0, -9.0, 2.0])
    source = (target - shift) @ rot  # moved by (rot, shift) it is the target
    other = arch(150, 2, 0.6)
    sources = spark.createDataFrame(cloud((("a", "full"), source[::2]), (("a", "half"), source[:90]), (("b", "full"), other[::2] + 40), (("c", "full"), other),
                                          (("d", "full"), [[0.0, float("nan"), 0.0]] * 40)), "set_id string, variant string, point_id long, x double, y double, z double")
    targets = spark.createDataFrame(cloud((("a", "t1"), target), (("a", "t2"), arch(120, 3, 0.3)), (("b", "t1"), other), (("b", "tiny"), other[:2]), (("d", "t1"), other)),
                                    "set_id string, target string, point_id long, x double, y double, z double")
    wanted = spark.createDataFrame([(s,) for s in "abcd"], "set_id string")
    return {"wanted": wanted, "sources": sources, "targets": targets, "source": source, "target": target, "rot": rot, "shift": shift}


def test_generation_ranks_reports_and_resumes(spark, job, tmp_path):
    folder = str(tmp_path / "run")
    first = G.generate(job["wanted"].where("set_id <> 'b'"), job["sources"], job["targets"], folder, PLAN)
    rows = first.candidates.collect()
    assert {(r.set_id, r.target, r.variant) for r in rows} == {("a", t, v) for t in ("t1", "t2") for v in ("full", "half")}
    assert len(rows) == 2 * 2 * PLAN.refine and sorted(r.unsupervised_rank for r in rows) == list(range(1, 9))
    best = first.best.collect()[0]
    assert best.target == "t1"
    assert np.allclose(matrix(best)[:3, :3], job["rot"], atol=0.02) and np.allclose(matrix(best)[:3, 3], job["shift"], atol=0.5)
    clouds = {"full": job["source"][::2], "half": job["source"][:90], "t1": job["target"], "t2": arch(120, 3, 0.3)}
    for r in rows:
        assert r.selection_score_mm == pytest.approx(two_way(clouds[r.variant], clouds[r.target], matrix(r)), abs=1e-6)
    assert {(r.set_id, r.stage, r.error) for r in first.failures.collect()} == {
        ("c", "target_extraction", "no target"), ("d", "source", "coordinates that are not finite")}
    pieces = {s: Stages(spark, folder, G.asdict(PLAN)).pieces(s) for s in ("registered", "rescored")}
    second = G.generate(job["wanted"], job["sources"], job["targets"], folder, PLAN)
    now = {(r.set_id, r.job_id): r.rank_score_mm for r in second.candidates.collect()}
    assert {k: v for k, v in now.items() if k[0] == "a"} == {(r.set_id, r.job_id): r.rank_score_mm for r in rows}
    assert {k[0] for k in now} == {"a", "b"}
    assert ("b", "tiny", "fewer than 3 points") in {(r.set_id, r.target, r.error) for r in second.failures.collect()}
    for stage, old in pieces.items():
        made = Stages(spark, folder, G.asdict(PLAN))
        assert len(made.pieces(stage)) == len(old) + 1
        assert sum(r.n for r in made.keys(stage).groupBy("set_id").count().withColumnRenamed("count", "n").collect()) == 2
    with pytest.raises(SettingsChanged):
        G.generate(job["wanted"], job["sources"], job["targets"], folder, G.Plan(refine=3))


def test_prior_basin_and_local_targets(spark, job, tmp_path):
    from dataclasses import replace

    plan = replace(PLAN, refine=1, basin_top=2, basin_choice="source-diverse", basin_samples=6, basin_stages=((4.0, 2.0),), basin_refine=2,
                   basin_schedule=(2.0,), basin_rounds=1, adaptive_top=1, adaptive_least=20, adaptive_schedule=(2.0,), adaptive_radius=4.0, rounds=1)
    only = job["wanted"].where("set_id = 'a'")
    prior = spark.createDataFrame([("a", 1, [float(v) for v in job["rot"].ravel()])], "set_id string, parity int, rotation array<double>")
    regions = job["targets"].where("set_id = 'a' AND target = 't1'").withColumn("target", G.F.lit("roi"))
    made = G.generate(only, job["sources"], job["targets"], str(tmp_path / "deep"), plan, priors=prior, regions=regions)
    rows = made.candidates.collect()
    kinds = {r.method for r in rows}
    assert {"pca", "prior"} <= kinds and any(k.endswith("+adaptive") for k in kinds) and any(k.endswith("+basin") for k in kinds)
    assert any(r.target.startswith("roi_from_") for r in rows)
    assert all(r.rank_score_mm == pytest.approx(r.selection_score_mm + plan.prior_penalty * r.prior_angle_deg, abs=1e-8) for r in rows)
    before = {r.job_id: r.fit_score_mm for r in rows}
    for r in rows:
        if r.method.endswith("+basin"):
            assert r.fit_score_mm <= before[r.job_id.removesuffix("/basin")] + 1e-9
    assert made.best.collect()[0].prior_angle_deg < 2


def test_halving_finds_the_exhaustive_best(spark, job):
    source = job["sources"].where("set_id = 'a' AND variant = 'full'").drop("variant")
    target = job["targets"].where("set_id = 'a' AND target = 't1'").drop("target")
    settings = {"parities": (1, -1), "refine": 2, "schedule": (6.0, 3.0, 1.5), "rounds": 2, "least": 16}
    whole = R.register(source, target, samples=(), coarse=0, **settings).where("rank = 1").collect()[0]
    quick = R.register(source, target, samples=(24, 48), coarse=40, **settings).where("rank = 1").collect()[0]
    assert quick.parity == whole.parity == 1
    assert np.allclose(quick.transform, whole.transform, atol=0.02) and quick.score == pytest.approx(whole.score, abs=2e-3)


def test_surface_matches(spark):
    reference = arch(240, 17)
    rot, shift = turn(22, -14, 31), np.array([17.0, -24.0, 8.0])
    query = ((reference[::2] - shift) @ rot) + np.random.default_rng(9).normal(scale=0.015, size=(120, 3))
    known = np.eye(4)
    known[:3, 3] = [80, 90, 40]
    near_miss = reference.copy()
    near_miss[:60] += 6.0
    points = spark.createDataFrame(cloud((("q1",), query), (("q2",), query), (("q3",), query), (("q4",), query)), "query_id string, point_id long, x double, y double, z double")
    queries = spark.createDataFrame([("q1", "upper", "ABC", None), ("q2", "upper", "other", "pay"), ("q3", "lower", "abc", "pay"), ("q4", "upper", "miss", None)],
                                    "query_id string, jaw string, raw_digest string, payload_digest string")
    flat = [float(v) for v in known.ravel()]
    entries = spark.createDataFrame([("e1", "upper", "abc", "pay", 0.2, flat), ("e2", "upper", "abc", None, 4.0, flat), ("e3", "upper", "miss", None, 0.1, flat), ("e4", "upper", "abc", None, None, flat)],
                                    "entry_id string, jaw string, raw_digest string, payload_digest string, predicted_mm double, transform array<double>")
    surfaces = spark.createDataFrame(cloud((("e1",), reference[1::2]), (("e2",), reference), (("e3",), near_miss), (("e4",), reference[:20])),
                                     "entry_id string, point_id long, x double, y double, z double")
    pairs = {(r.query_id, r.entry_id, r.match_kind) for r in G.content_pairs(queries, entries, 1.5).collect()}
    assert pairs == {("q1", "e1", "raw"), ("q1", "e4", "raw"), ("q2", "e1", "payload"), ("q4", "e3", "raw")}
    limits = G.MatchLimits(refine=1, least=24)
    found = {r.query_id: r for r in G.surface_matches(queries, points, entries, surfaces, limits, (3.0, 1.0), 2).collect()}
    assert set(found) == {"q1", "q2"}  # q3 is the other side, q4 fails the gates
    truth = known.copy()
    truth[:3, :3], truth[:3, 3] = rot, shift + known[:3, 3]
    # entry and query hold every second point, so a slide by one point of the reference fits as well as the truth
    spacing = np.linalg.norm(np.diff(reference, axis=0), axis=1).mean()
    for q, kind in (("q1", "raw"), ("q2", "payload")):
        assert found[q].match_kind == kind and found[q].entry_id == "e1"
        m = matrix(found[q])
        assert np.linalg.norm(query @ (m - truth)[:3, :3].T + (m - truth)[:3, 3], axis=1).mean() < 1.2 * spacing


def test_bundles_are_built_once(spark, tmp_path):
    built = []

    def build(rows):
        built.append(sorted(r.volume for r in rows.select("volume").collect()))
        return rows.select("bundle_key", G.F.length("volume").alias("size"))

    requests = spark.createDataFrame([(1, "v1", "upper"), (2, "v1", "upper"), (3, "v2", None)], "id int, volume string, jaw string")
    stages = Stages(spark, str(tmp_path / "cache"), strict=False)
    keyed, rows = cached_bundles(stages, requests, ["volume", "jaw"], {"points": 8}, build)
    assert keyed.select("bundle_key").distinct().count() == rows.count() == 2
    cached_bundles(stages, requests, ["volume", "jaw"], {"points": 8}, build)
    cached_bundles(stages, requests.union(spark.createDataFrame([(4, "v3", "upper")], requests.schema)), ["volume", "jaw"], {"points": 8}, build)
    cached_bundles(stages, requests.where("id = 1"), ["volume", "jaw"], {"points": 9}, build)
    assert built == [["v1", "v2"], ["v3"], ["v1"]]


def test_cut_short_pieces_are_not_read(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "s"), {"a": 1})
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    keys.write.parquet(f"{stages.folder}/one/rows/p-cut")  # rows without a commit line
    assert stages.rows("one") is None and stages.pending("one", keys, ["k"]).count() == 2
    got = stages.advance("one", keys, ["k"], lambda missing: missing.where("k = 1").withColumn("v", G.F.lit("x")))
    assert [tuple(r) for r in got.collect()] == [(1, "x")]
    assert stages.pending("one", keys, ["k"]).isEmpty()  # 2 was asked for and gave nothing
    assert stages.advance("one", keys, ["k"], lambda missing: 1 / 0).count() == 1
