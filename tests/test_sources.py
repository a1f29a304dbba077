import gzip
import json

import numpy as np
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.sources import binary as B
from rankloom.sources import files as A

UNIT = np.eye(4, dtype=int).tolist()


def test_manifest_scan_and_csv(spark, tmp_path):
    case = tmp_path / "in" / "Train-Labeled" / "001"
    case.mkdir(parents=True)
    for name in ("CBCT.nii.gz", "ios_upper.stl", "upper_gt.npy"):
        (case / name).write_bytes(b"x")
    got = {r["jaw"]: r for r in A.build_manifest(spark, str(tmp_path / "in")).collect()}
    assert got["upper"]["complete"] and not got["lower"]["complete"] and got["upper"]["case_id"] == "001"
    (tmp_path / "m.csv").write_text("﻿split,case_id,jaw,cbct_path,ios_path\nV,001,upper,a,b\n", encoding="utf-8")
    row = A.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert row["split"] == "V" and row["case_id"] == "001" and row["complete"] and row["transform_path"] is None


def test_candidate_scan_numbers_rows_over_runs(spark, tmp_path):
    runs = []
    for run, count in (("r1", 2), ("r2", 1)):
        folder = tmp_path / run / "001_x_upper"
        folder.mkdir(parents=True)
        rows = [{"selection_score_mm": 1, "transform": UNIT, "target_metadata": {"mode": "threshold"}} for _ in range(count)]
        (folder / "candidates.json").write_text(json.dumps(rows))
        runs.append(str(tmp_path / run))
    (tmp_path / "r2" / "002_lower").mkdir()
    (tmp_path / "r2" / "002_lower" / "candidates.json").write_text('[{"selection_score_mm": 1}, {"selec')
    rows, bad = A.read_candidates(spark, runs)
    got = rows.orderBy("candidate_index").collect()
    assert [r["path"].rsplit("/", 2)[1] for r in bad.collect()] == ["002_lower"]
    assert [(r["case_id"], r["jaw"], r["candidate_index"], r["candidate_run"]) for r in got] == [
        ("001_x", "upper", 0, runs[0]), ("001_x", "upper", 1, runs[0]), ("001_x", "upper", 2, runs[1])]
    assert got[0]["transform"] == np.eye(4).reshape(-1).tolist() and got[0]["target_metadata"]["mode"] == "threshold"


def test_results_are_checked(spark, tmp_path):
    good = {"record": {"case_id": "001", "jaw": "upper"}, "target": {"name": "t"}, "registration": {"transform": UNIT, "score": 1},
            "selection": {"target_mode": "m"}, "metrics": {}}
    for folder, payload in (("001_upper", good), ("002_upper", good), ("003_upper", {"record": {"case_id": "003", "jaw": "upper"}})):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "result.json").write_text(json.dumps(payload))
    (tmp_path / "004_upper").mkdir()
    (tmp_path / "004_upper" / "result.json").write_text('{"record": {"case')
    ok, bad = A.read_results(spark, str(tmp_path))
    assert [r["case_id"] for r in ok.collect()] == ["001"]
    assert {r["folder"]: r["reason"] for r in bad.collect()} == {"002_upper": "wrong_case", "003_upper": "section_missing", "004_upper": "unreadable"}


def test_hash_cache_scores_and_priors(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"/A//b.nii": {"size": 3, "mtime_ns": 4, "sha256": "ff"}}))
    row = A.read_hash_cache(spark, str(tmp_path / "c.json")).first()
    assert (row["path"], row["size"], row["content_hash"]) == ("/a/b.nii", 3, "ff")
    scores = spark.createDataFrame([("001", "upper", "vote", 0, 0.5, 1.0, "r")], schemas.SCORES)
    A.write_csv(scores, str(tmp_path / "s"), ["ensemble_method"])
    assert A.read_csv(spark, str(tmp_path / "s" / "ensemble_method=vote"), schemas.struct(
        **{f.name: f.dataType for f in schemas.SCORES if f.name != "ensemble_method"}), ["case_id", "jaw"]).first()["case_id"] == "001"
    A.write_priors(spark.createDataFrame([("upper", [1.0] * 9, 3)], "jaw string, mean_rotation array<double>, training_count int"), str(tmp_path / "p"))
    assert A.read_priors(spark, str(tmp_path / "p")).columns == ["jaw", "mean_rotation"]


def test_candidate_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "candidate_run string, case_id string, jaw string, v int, _h int"
    A.write_candidates(spark.createDataFrame([("r", "001", "upper", 1, 0), ("r", "002", "upper", 2, 0)], schema), path)
    A.write_candidates(spark.createDataFrame([("r", "002", "upper", 3, 0)], schema), path)
    got = spark.read.schema("v int, candidate_run string, case_id string, jaw string").parquet(path)
    assert sorted((r["case_id"], r["v"]) for r in got.collect()) == [("001", 1), ("002", 3)] and "_h" not in got.columns


def test_binary_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.eye(4))
    np.save(tmp_path / "b.npy", np.eye(3))
    got = {r["path"].rsplit("/", 1)[1]: r["transform"] for r in B.read_matrices(spark, str(tmp_path)).collect()}
    assert got["a.npy"] == np.eye(4).reshape(-1).tolist() and got["b.npy"] is None
    record = np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("tag", "<u2")])
    faces = np.zeros(2, record)
    faces["corner"][0], faces["corner"][1] = [[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[1, 0, 0], [0, 1, 0], [1, 1, 2]]
    (tmp_path / "m.stl").write_bytes(b"\0" * 80 + np.uint32(2).tobytes() + faces.tobytes())
    mesh = B.read_meshes(spark, str(tmp_path))
    assert mesh.count() == 4 and B.mesh_bounds(mesh).first()["high_z"] == 2.0
    header = bytearray(352)
    header[40:56] = np.array([3, 2, 2, 2, 1, 1, 1, 1], "<i2").tobytes()
    header[70:72], header[108:112] = np.int16(4).tobytes(), np.float32(352).tobytes()
    header[280:328] = np.array([2, 0, 0, 1, 0, 2, 0, 1, 0, 0, 2, 1], "<f4").tobytes()
    body = bytes(header) + np.arange(8, dtype="<i2").tobytes()
    (tmp_path / "v.nii.gz").write_bytes(gzip.compress(body))
    vox = B.read_volumes(spark, str(tmp_path), 6.0).collect()
    assert sorted((r["i"], r["j"], r["k"], r["hu"]) for r in vox) == [(0, 1, 1, 6.0), (1, 1, 1, 7.0)]
    assert B.read_volume_headers(spark, str(tmp_path)).first()["affine"][0] == 2.0
    (tmp_path / "t.stl").write_text("solid s\n facet normal 0 0 1\n outer loop\n vertex 0 0 0\n vertex 1 0 0\n vertex 0 2.5e0 0\n endloop\n endfacet\nendsolid\n")
    (tmp_path / "cut.stl").write_bytes(b"\0" * 80 + np.uint32(9).tobytes())
    (tmp_path / "cut.nii").write_bytes(b"x" * 20)
    assert B.read_meshes(spark, str(tmp_path), "t.stl").agg({"y": "max"}).first()[0] == 2.5
    assert B.read_meshes(spark, str(tmp_path)).select("path").distinct().count() == 2
    assert [r["path"].rsplit("/", 1)[1] for r in B.rejected(B.files_below(spark, str(tmp_path), "*.stl"), "mesh").collect()] == ["cut.stl"]
    assert B.read_volume_headers(spark, str(tmp_path)).count() == 1 and B.rejected(B.files_below(spark, str(tmp_path), "*.nii*"), "header").count() == 1


def test_payload_hash_ignores_packing(spark, tmp_path):
    for name, stamp in (("a.gz", 1), ("b.gz", 99)):
        (tmp_path / name).write_bytes(gzip.compress(b"same bytes", mtime=stamp))
    first = B.payload_hashes(spark, str(tmp_path), "*.gz")
    assert first.select("digest").distinct().count() == 1 and B.file_hashes(spark, str(tmp_path), "*.gz").select("digest").distinct().count() == 2
    cache = first.withColumn("digest", F.lit("cached"))
    assert {r["digest"] for r in B.payload_hashes(spark, str(tmp_path), "*.gz", cache).collect()} == {"cached"}


def test_labels_to_candidates_and_volumes(spark):
    labels = spark.createDataFrame([("001", "upper", "t", 0.9, np.eye(4).reshape(-1).tolist()), ("002", "upper", "t", 0.9, np.eye(4).reshape(-1).tolist())],
                                   "case_id string, jaw string, teacher string, confidence double, transform array<double>")
    good, bad = A.candidates_from_labels(labels, spark.createDataFrame([("001", "upper", 1.0, 2.0, 3.0)], "case_id string, jaw string, cx double, cy double, cz double"))
    assert good.first()["predicted_full_centroid"] == [1.0, 2.0, 3.0] and bad.first()["case_id"] == "002"
    rows = spark.createDataFrame([("1", 0, "a", None, "v1"), ("1", 1, "b", "a", None), ("1", 2, "c", "zz", None), ("2", 0, "a", "q", None)],
                                 "case_id string, candidate_index int, target string, coarse_target string, volume_path string")
    got = A.resolve_volumes(rows, ["case_id"], "dflt").orderBy("case_id", "candidate_index").collect()
    assert [r["resolved_volume"] for r in got] == ["v1", "v1", "v1", "dflt"]


def test_audits_and_case_discovery(spark, tmp_path):
    import pytest

    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "audit.json").write_text(json.dumps([{"case_id": "001", "jaw": "upper", "method": run, "predicted_tre_mm": 1}]))
    rows, bad = A.read_audits(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")])
    got = rows.orderBy("run_order").collect()
    assert bad.isEmpty()
    assert [(r["method"], r["predicted_tre_mm"]) for r in got] == [("r1", 1.0), ("r2", 1.0)]
    case = tmp_path / "in" / "V" / "009"
    case.mkdir(parents=True)
    for name in ("cbct.nii.gz", "ios_upper.stl"):
        (case / name).write_bytes(b"x")
    with pytest.raises(ValueError, match="without a mesh"):
        A.discover_cases(spark, str(tmp_path / "in"))
    (case / "lower.stl").write_bytes(b"x")
    assert A.discover_cases(spark, str(tmp_path / "in")).count() == 2


def test_ensemble_is_saved_with_its_feature_order(spark, tmp_path):
    from rankloom.operators import models as L

    rows = spark.createDataFrame([("c", "upper", i, float(i), float(i % 3), 1.0) for i in range(12)],
                                 "case_id string, jaw string, candidate_index int, a double, b double, weight double")
    model = L.fit_regression(rows.withColumn("e", F.col("a")), ["b", "a"], "e", 1, trees=2, depth=2)
    L.save_ensemble({"m1": model}, str(tmp_path), ["b", "a"], spark, target="log1p")
    assert L.load_features(spark, str(tmp_path), "m1") == ["b", "a"]


def test_ordered_sink(spark, tmp_path):
    rows = spark.createDataFrame([(i * 7919 % 1000, str(i)) for i in range(1000)], "v int, t string").repartition(8)
    A.write_csv(rows, str(tmp_path / "o"), order=["v"])
    read = [line.split(",")[0] for part in sorted((tmp_path / "o").glob("part-*")) for line in part.read_text().splitlines()[1:]]
    assert [int(v) for v in read] == sorted(int(v) for v in read) and len(read) == 1000
