"""Small fixtures with closed-form expectations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import keys as K
from rankloom.functions import matrix as M
from rankloom.operators import contents as C
from rankloom.operators import evaluation as E
from rankloom.operators import poses as P
from rankloom.operators import selection as S
from rankloom.operators import summaries as Z


def pose(axis, degrees, shift=(0, 0, 0), reflect=False):
    a = np.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    rot = {"z": [[c, -s, 0], [s, c, 0], [0, 0, 1]], "x": [[1, 0, 0], [0, c, -s], [0, s, c]]}[axis]
    full = np.eye(4)
    full[:3, :3] = np.array(rot) @ np.diag([-1.0 if reflect else 1.0, 1, 1])
    full[:3, 3] = shift
    return full.reshape(-1).tolist()


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} array<double>" for k in values))
    return tuple(df.select(*columns).first())


def test_rotation_errors(spark):
    unit = pose("z", 0)
    for a, b, want in ((pose("z", 37), unit, 37), (pose("x", 23, reflect=True), pose("x", 0, reflect=True), 23), (pose("z", 0, reflect=True), unit, 90)):
        assert one(spark, M.rotation_error_deg("a", "b"), a=a, b=b)[0] == pytest.approx(want)
    assert one(spark, M.translation_error("a", "b"), a=pose("z", 12, (3, 4, 0)), b=unit)[0] == pytest.approx(5)


def test_matrix_algebra_matches_numpy(spark):
    a, b = pose("z", 30, (1, 2, 3), True), pose("x", -70, (4, -5, 6))
    got = one(spark, M.compose("a", "b"), M.invert("a"), a=a, b=b)
    want = [np.reshape(a, (4, 4)) @ np.reshape(b, (4, 4)), np.linalg.inv(np.reshape(a, (4, 4)))]
    assert np.allclose(got[0], want[0].reshape(-1)) and np.allclose(got[1], want[1].reshape(-1))


def test_matrix_contract(spark):
    scaled = (np.reshape(pose("z", 10), (4, 4)) * np.array([[1.1], [1.1], [1.1], [1]])).reshape(-1).tolist()
    assert one(spark, M.contract_violations("a"), M.contract_violations("b"), a=pose("z", 5, reflect=True), b=scaled)[0] == 0
    assert one(spark, M.contract_violations("a"), a=scaled)[0] > 0


def test_key_round_trip_and_rejects(spark):
    df = spark.createDataFrame([(pose("z", 33, (1, 2, 3)),)], "m array<double>").select(M.encode_key("m").alias("k"))
    assert np.allclose(df.select(M.decode_key("k")).first()[0], pose("z", 33, (1, 2, 3)), atol=1e-6)
    bad = spark.createDataFrame([("1,2,3",), (",".join(["nan"] * 16),)], "k string").select(M.decode_key("k").alias("m"))
    assert [r["m"] for r in bad.collect()] == [None, None]


@pytest.mark.parametrize("degrees", [0.0, 1e-6, 90.0, 180.0])
def test_halfway_pose(spark, degrees):
    df = spark.createDataFrame([(pose("x", 0), pose("x", degrees, (2, 0, 0)))], "a array<double>, b array<double>")
    out = P.interpolate_poses(df, "a", "b", [F.lit(0.0)] * 3, [0.5]).first()["pose"]
    got, want = np.reshape(out, (4, 4)), np.reshape(pose("x", degrees / 2, (1, 0, 0)), (4, 4))
    flipped = np.reshape(pose("x", -degrees / 2, (1, 0, 0)), (4, 4))
    assert np.allclose(got, want, atol=1e-6) or (degrees == 180.0 and np.allclose(got, flipped, atol=1e-6))


def test_mode_ranks(spark):
    rows = [("direct", 2.0, 1.0), ("direct_probability", 1.0, 2.0), ("direct_guided", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "mode string, translation double, rotation double")
    got = E.rank_modes(df, [], "mode", "translation", "rotation", F.length("mode")).orderBy("place").collect()
    assert [(r["mode"], r["average_rank"]) for r in got] == [("direct", 1.5), ("direct_probability", 1.5), ("direct_guided", 3.0)]


def test_seed_vote(spark):
    costs = [[0, 1, 2], [0, 2, 1], [2, 0, 1]]
    rows = [("c", s, i, float(v)) for s, row in enumerate(costs) for i, v in enumerate(row)]
    df = spark.createDataFrame(rows, "case_id string, seed int, candidate_index int, cost double")
    assert S.majority_winner(df, ["case_id"], "seed", "cost").first()["candidate_index"] == 0
    best = S.seed_aggregates(df, ["case_id"], "seed", "cost").orderBy("vote_score").first()
    assert (best["candidate_index"], best["votes"]) == (0, 2)


def test_blend_ends(spark):
    df = spark.createDataFrame([("c", i, float(i), float(2 - i)) for i in range(3)], "case_id string, candidate_index int, a double, b double")
    out = S.rank_blend(df, ["case_id"], "a", "b", [0.0, 1.0])
    best = {r["alpha"]: r["i"] for r in out.groupBy("alpha").agg(F.min_by("candidate_index", "blend_score").alias("i")).collect()}
    assert best == {0.0: 2, 1.0: 0}
    with pytest.raises(ValueError):
        S.rank_blend(df, ["case_id"], "a", "b", [1.5])


def test_joint_pair_overrides_single_scores(spark):
    rows = [("c", "upper", 0, 0.0, 0.0), ("c", "upper", 1, 10.0, 0.1), ("c", "lower", 0, 20.0, 0.0), ("c", "lower", 1, 0.0, 0.1)]
    data = [(c, j, i, s, 1, pose("z", 0, (x, 0, 0)), n) for n, (c, j, i, x, s) in zip((1, 2, 1, 2), rows)]
    df = spark.createDataFrame(data, "case_id string, jaw string, candidate_index int, score double, chirality int, transform array<double>, place int")
    unit = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    got = S.joint_pairs(df, "case_id", unit, [F.lit(0.0)] * 3, angle_weight=0.0, shift_weight=1.0).first()
    assert (got["upper_candidate_index"], got["lower_candidate_index"]) == (0, 1)


def test_run_balance(spark):
    rows = [("c", r, i, float(i % 25)) for r in "ab" for i in range(25 * (r == "b"), 25 * (1 + (r == "b")))]
    df = spark.createDataFrame(rows, "case_id string, run string, candidate_index int, score double")
    got = S.run_balanced_top(df, ["case_id"], "run", "score", 40).groupBy("run").count().collect()
    assert {r["run"]: r["count"] for r in got} == {"a": 20, "b": 20}


def test_leakage(spark):
    groups = spark.createDataFrame([("val", "a"), ("u1", "a"), ("u2", "b"), ("t", "a")], "case_id string, content_group string")
    pseudo = spark.createDataFrame([("u1", "x", "exact"), ("u2", "x", "exact"), ("u3", "t", "exact"), ("u4", "x", "other")],
                                   "case_id string, source string, teacher string")
    held = spark.createDataFrame([("val",)], "case_id string")
    out = C.leakage_safe(pseudo, groups, held, "case_id", "source", {"exact": True}, False)
    assert [r["case_id"] for r in out.collect()] == ["u2"]


def test_folds_keep_mixed_groups_whole(spark):
    rows = [(f"g{i // 3}", 1 if i % 2 else -1) for i in range(90)]
    df = spark.createDataFrame(rows, "content_group string, sign int")
    out = C.grouped_folds(df, "content_group", 5, 1, "sign").collect()
    assert len(out) == 30 == len({r["content_group"] for r in out})
    sizes = [sum(r["size"] for r in out if r["fold"] == f) for f in range(5)]
    assert sum(sizes) == 90 and max(sizes) - min(sizes) <= 6


@pytest.mark.parametrize("deltas, chosen", [((-.12, -.08, -.10, -.09, -.11), True), ((-1, .1, .1, .1, .1), False)])
def test_robust_decision(spark, deltas, chosen):
    df = spark.createDataFrame([(f"g{i}", float(d)) for i, d in enumerate(deltas)], "g string, delta double")
    assert E.robust_decision(df, "g", 200).first()["selected"] is chosen


def test_route_gate(spark):
    df = spark.createDataFrame([(2.0, 4.0, 0.5, 0.9)], "first_predicted double, second_predicted double, first_error double, second_error double")
    got = {(r["cap"], r["advantage"]): r["takes_first"] for r in E.route_grid_rows(df, [3.0, 1.5], [1.0, 2.5]).collect()}
    assert got == {(3.0, 1.0): True, (1.5, 1.0): False, (3.0, 2.5): False, (1.5, 2.5): False}


def test_cluster_bootstrap_uses_content_groups(spark):
    rows = [("a", .5), ("a", .7), ("a", 1.0), ("a", 1.2), ("c", 4.0), ("c", 4.2)]
    df = spark.createDataFrame(rows, "g string, e double")
    out = E.interval_report(E.cluster_bootstrap(df, "g", "e", F.col("e") <= 2, 100, 3)).first()
    assert out["p90_high"] <= 1.2 and out["samples"] < 100


def test_signed_rank_exact(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4, 5)], "m string, d double")
    out = Z.signed_rank(df, ["m"], "d").first()
    assert (out["rank_sum_up"], out["rank_sum_down"], out["p_value"]) == (15.0, 0.0, 0.0625)


def test_text_rules(spark):
    df = spark.createDataFrame([("pca_low_0.25", 150.0, "teacher_3_oof"), ("full", 250.0, "a_1_2")], "v string, t double, f string")
    got = df.select(K.source_fraction("v"), K.source_side("v"), K.threshold_bucket("t"), K.fold_number("f")).collect()
    assert [tuple(r) for r in got] == [(0.25, "low", 200, 3), (1.0, "full", 200, None)]


def test_stable_seed(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7|001|upper").digest()[:4], "little")
    got = spark.range(1).select(K.stable_seed(F.lit("7|001|upper")), K.stable_seed(F.lit("7|001|upper"), False)).first()
    assert tuple(got) == (want & 0x7FFFFFFF, want)


def test_pair_search_widens_only_without_a_pair(spark):
    data = []
    for case, far_sign in (("near", 1), ("far", -1)):
        for place in (1, 2, 3):
            data.append((case, "upper", place, float(place), 1, pose("z", 0), place))
            data.append((case, "lower", place, float(place), 1 if place == 3 else far_sign, pose("z", 0), place))
    df = spark.createDataFrame(data, "case_id string, jaw string, candidate_index int, score double, chirality int, transform array<double>, place int")
    unit = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    got = {r["case_id"]: (r["upper_candidate_index"], r["lower_candidate_index"], r["widened"])
           for r in S.joint_pairs(df, "case_id", unit, [F.lit(0.0)] * 3, top=2).collect()}
    assert got == {"near": (1, 1, False), "far": (1, 3, True)}


def test_defaults_and_config_keys(spark):
    df = spark.createDataFrame([("1.5", '{"a": {"b": 2}}'), ("", "{}"), (None, None)], "n string, j string")
    got = df.select(K.number("n", 7.0).alias("n"), K.json_or("j", "$.a.b", "none").alias("j")).collect()
    assert [tuple(r) for r in got] == [(1.5, "2"), (7.0, "none"), (7.0, "none")]
    row = spark.range(1).select(K.config_key(b=F.lit(1), a=F.lit("x")), K.protocol_parity(F.lit(266), F.lit(266), F.lit(200), F.lit(0.3)),
                                K.protocol_parity(F.lit(266), F.lit(266), F.lit(201), F.lit(0.3))).first()
    assert tuple(row) == ('{"a":"x","b":1}', -1, 1)


def test_consensus_counts_each_evidence_cell_once(spark):
    from rankloom.operators import consensus as Q

    cells = [("A", 1000), ("A", 1200), ("B", 1400), ("C", 1600)]
    rows = [("c", "upper", i, pose("z", 0, (x, 0, 0)), 0.1, view, "tracked", t, "full") for i, ((view, t), x) in enumerate(zip(cells, (0.0, 0.2, 0.1, 20.0)))]
    df = spark.createDataFrame(rows, "case_id string, jaw string, candidate_index int, transform array<double>, selection double, "
                                     "view string, family string, threshold_cell int, side string")
    sample = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")) for x in (0.0, 1.0)])
    df = df.withColumns({"sample": sample, "sx": F.lit(0.5), "sy": F.lit(0.0), "sz": F.lit(0.0)})
    got = Q.evidence_consensus(df, ["case_id", "jaw"], 1.0, 1.0, {"evidence": 2, "views": 2}).first()
    assert (got["evidence"], got["views"], got["thresholds"]) == (3, 2, 3)
    assert got["candidate_index"] == 2 and got["max_disagreement_mm"] == pytest.approx(0.2)
