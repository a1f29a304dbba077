"""Candidate features, group context and reranking models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import features as X
from ..operators import models as L
from ..operators import selection as S
from ..session import cut_lineage
from .bindings import CANDIDATES_SQL, GROUP, all_rounded, candidates, posed, r6, rounded, with_sql
from .registry import query

ID = [*GROUP, "candidate_index"]


def rich(spark, folder):
    """Candidates with matrix, centroids, metadata of every mode and a few support columns."""
    return enriched(candidates(spark, folder))


def enriched(rows):
    rows = posed(rows)
    fifth = F.pmod("candidate_index", F.lit(5))
    mode = (F.when(F.contains("target", F.lit("adaptive")), "adaptive_threshold_roi").when(F.contains("target", F.lit("aggregate")), "threshold_aggregate")
            .when(fifth == 0, "crown_probability").when(fifth == 1, "crown_localizer").when(fifth == 2, "crown_guided_cbct")
            .when(F.pmod("candidate_index", F.lit(11)) == 3, "toothseg").otherwise("threshold"))
    fourth = F.pmod("candidate_index", F.lit(4))
    meta = F.struct(
        mode.alias("mode"), F.when(fourth == 1, "upper").when(fourth == 2, "both").alias("axial_assignment"),
        F.col("threshold"), (F.col("selection_score_mm") * 100).alias("component_voxels"), F.lit(2).alias("aggregate_count"),
        F.lit(0.4).alias("minimum_probability"), F.lit("top_voxels").alias("selection"), F.lit(2000).alias("requested_voxels"),
        F.lit(4.5).alias("guidance_radius_mm"), F.lit(8).alias("detected_teeth"), F.lit(0.25).alias("crown_fraction"))
    return rows.withColumns({
        "target_metadata": meta,
        "predicted_full_centroid": F.array("selection_score_mm", "fit_p90_mm", "fit_score_mm"),
        "jaw_reference_center": F.array(F.lit(25.0), F.lit(4.0), F.lit(5.0)),
        "crown_symmetric_trim20_mm": F.when(F.col("fit_p90_mm") > 2, F.col("fit_p90_mm")),
        "crown_centroid_error_mm": F.when(F.col("fit_p90_mm") > 2, F.col("selection_score_mm")),
        "full_trim_20_mm": F.when(F.col("fit_p90_mm") > 3, F.col("fit_p90_mm")),
        "crown_refinement_improvement_mm": F.when(F.col("fit_p90_mm") < 1, F.col("fit_score_mm")),
        "crown_refinement_center_motion_mm": F.when(F.col("fit_p90_mm") < 4, F.col("fit_p90_mm")),
    })


RICH_SQL = """r AS (SELECT *, CASE WHEN contains(target, 'adaptive') THEN 'adaptive_threshold_roi' WHEN contains(target, 'aggregate') THEN 'threshold_aggregate'
  WHEN candidate_index % 5 = 0 THEN 'crown_probability' WHEN candidate_index % 5 = 1 THEN 'crown_localizer' WHEN candidate_index % 5 = 2 THEN 'crown_guided_cbct'
  WHEN candidate_index % 11 = 3 THEN 'toothseg' ELSE 'threshold' END AS mode,
  CASE candidate_index % 4 WHEN 1 THEN 'upper' WHEN 2 THEN 'both' ELSE '' END AS assignment FROM cand)"""
# Base features that the candidates of the given tables do not fill: the value of a missing one.
ABSENT = {"full_trim_10": 10, "full_trim_35": 10, "full_distance_median": 20, "full_distance_p90": 40, "full_overlap_1mm": 0, "full_overlap_2mm": 0,
          "full_overlap_3mm": 0, "full_target_coverage_2mm": 0, "full_normal_abs_cosine": 0, "crown_source_trim20": 10, "crown_target_trim20": 10,
          "crown_source_median": 20, "crown_target_median": 20, "crown_source_overlap_2mm": 0, "crown_target_coverage_2mm": 0,
          "crown_refinement_initial_trim20": 10, "crown_refinement_angle_scaled": 0, "crown_refinement_alpha": 0}
BASE_SQL = {
    "selection_score": "selection_score_mm", "source_fit": "fit_score_mm", "initial_fit": "0", "fit_median": "0", "fit_p90": "fit_p90_mm",
    "overlap_2mm": "0", "target_fit": "0", "target_coverage_1mm": "0", "target_coverage_2mm": "target_coverage_2mm",
    "correspondences_scaled": "0", "prior_angle_scaled": "0",
    "center_dx_scaled": "(selection_score_mm - 25) / 50", "center_dy_scaled": "(fit_p90_mm - 4) / 50", "center_dz_scaled": "(fit_score_mm - 5) / 50",
    "center_distance_scaled": "sqrt(pow((selection_score_mm - 25) / 50, 2) + pow((fit_p90_mm - 4) / 50, 2) + pow((fit_score_mm - 5) / 50, 2))",
    "threshold_scaled": "CASE WHEN mode = 'crown_probability' THEN 0.4 ELSE threshold / 2000 END",
    "component_log_voxels_scaled": "ln(1 + selection_score_mm * 100) / 12",
    "target_aggregate": "(mode IN ('crown_probability', 'threshold_aggregate'))::INTEGER",
    "aggregate_count_scaled": "CASE mode WHEN 'crown_probability' THEN 0.5 WHEN 'crown_guided_cbct' THEN 0.75 ELSE 0.5 END",
    "target_adaptive": "(mode = 'adaptive_threshold_roi')::INTEGER",
    "axial_assignment_requested": "(assignment = jaw OR assignment = '' AND mode = 'threshold')::INTEGER",
    "axial_assignment_opposite": "(assignment <> '' AND assignment <> jaw)::INTEGER",
    "source_fraction": "CASE source_variant WHEN 'full' THEN 1.0 WHEN 'pca_low_0.25' THEN 0.25 ELSE 0.5 END",
    "source_low": "contains(source_variant, 'low')::INTEGER", "source_high": "contains(source_variant, 'high')::INTEGER", "method_basin": "0",
    "chirality_negative": "(chirality < 0)::INTEGER", "full_trim_20": "CASE WHEN fit_p90_mm > 3 THEN fit_p90_mm ELSE 10 END",
    "full_geometry_available": "(fit_p90_mm > 3)::INTEGER",
    "proper_rotation_00": "cos(radians(turn_deg))", "proper_rotation_01": "-sin(radians(turn_deg))", "proper_rotation_02": "0",
    "proper_rotation_10": "sin(radians(turn_deg))", "proper_rotation_11": "cos(radians(turn_deg))", "proper_rotation_12": "0",
    "proper_rotation_20": "0", "proper_rotation_21": "0", "proper_rotation_22": "1",
    "crown_symmetric_trim20": "CASE WHEN fit_p90_mm > 2 THEN fit_p90_mm ELSE 10 END",
    "crown_centroid_error_scaled": "CASE WHEN fit_p90_mm > 2 THEN selection_score_mm / 50 ELSE 1 END",
    "crown_consistency_available": "(fit_p90_mm > 2)::INTEGER",
    "crown_refinement_improvement": "CASE WHEN fit_p90_mm < 1 THEN fit_score_mm ELSE 0 END",
    "crown_refinement_center_motion_scaled": "CASE WHEN fit_p90_mm < 4 THEN fit_p90_mm / 5 ELSE 0 END",
    "crown_refinement_available": "(fit_p90_mm < 1)::INTEGER",
    "target_crown_mask": "(mode = 'crown_localizer')::INTEGER", "target_crown_probability": "(mode = 'crown_probability')::INTEGER",
    "target_crown_guided": "(mode = 'crown_guided_cbct')::INTEGER",
    **{name: str(value) for name, value in ABSENT.items()},
}


@query("base_features", with_sql(CANDIDATES_SQL, RICH_SQL, body="SELECT case_id, jaw, candidate_index, " + ", ".join(
    f"round(({BASE_SQL[name]})::DOUBLE, 5) AS {name}" for name in X.FEATURE_NAMES) + " FROM r"))
def base_features(spark, folder):
    rows, names = X.base_features(rich(spark, folder))
    return all_rounded(rows, ID, names, 5)


@query("modality_features", with_sql(CANDIDATES_SQL, RICH_SQL, body="""
SELECT case_id, jaw, candidate_index, (mode = 'toothseg')::INTEGER::DOUBLE AS target_toothseg, CASE WHEN mode = 'toothseg' THEN 0.5::DOUBLE ELSE 0 END AS toothseg_detected_fraction,
  CASE WHEN mode = 'toothseg' THEN 0.25::DOUBLE ELSE 0 END AS toothseg_crown_fraction FROM r"""))
def modality_features(spark, folder):
    rows, names = X.modality_features(rich(spark, folder))
    return rows.select(*ID, *names)


SPACE_SQL = """sp AS (SELECT case_id, jaw, candidate_index, candidate_run, (selection_score_mm - 25) / 50 AS d0, (fit_p90_mm - 4) / 50 AS d1, (fit_score_mm - 5) / 50 AS d2,
  cos(radians(turn_deg)) AS d3, -sin(radians(turn_deg)) AS d4 FROM cand),
q AS (SELECT case_id, jaw, """ + ", ".join(
    f"quantile_cont(d{i}, 0.5) AS m{i}, greatest(quantile_cont(d{i}, 0.75) - quantile_cont(d{i}, 0.25), 1e-6::DOUBLE) AS s{i}" for i in range(5)) + """ FROM sp GROUP BY ALL),
z AS (SELECT case_id, jaw, candidate_index, candidate_run, """ + ", ".join(f"greatest(least((d{i} - m{i}) / s{i}, 8), -8) AS z{i}" for i in range(5)) + """ FROM sp JOIN q USING (case_id, jaw)),
pr AS (SELECT a.case_id, a.jaw, a.candidate_index, a.candidate_run AS ra, b.candidate_run AS rb, b.candidate_index AS other,
  sqrt((pow(a.z0-b.z0,2)+pow(a.z1-b.z1,2)+pow(a.z2-b.z2,2)+2*pow(a.z3-b.z3,2)+2*pow(a.z4-b.z4,2))/12) AS dist
  FROM z a JOIN z b ON a.case_id = b.case_id AND a.jaw = b.jaw AND a.candidate_index <> b.candidate_index)"""


@query("neighbour_density", with_sql(CANDIDATES_SQL, SPACE_SQL, body="""
SELECT z.case_id, z.jaw, z.candidate_index, round(coalesce(min(dist), 0), 5) AS nearest,
  round(count(*) FILTER (WHERE dist <= 0.25) / greatest(count(dist), 1)::DOUBLE, 5) AS density_025
FROM z LEFT JOIN pr ON pr.case_id = z.case_id AND pr.jaw = z.jaw AND pr.candidate_index = z.candidate_index GROUP BY ALL"""))
def neighbour_density(spark, folder):
    space, dims = described(spark, folder)
    out = X.density_features(space, GROUP, dims)
    return out.select(*ID, rounded("nearest", 5).alias("nearest"), rounded("density_025", 5).alias("density_025"))


def described(spark, folder):
    rows, _ = X.base_features(rich(spark, folder))
    space, dims = X.descriptor_space(rows, GROUP)
    return space.select(*ID, "candidate_run", *dims), dims


@query("cross_run_support", with_sql(CANDIDATES_SQL, SPACE_SQL, """n AS (SELECT case_id, jaw, candidate_index, rb, min(dist) AS d FROM pr WHERE ra <> rb GROUP BY ALL),
g AS (SELECT case_id, jaw, candidate_index, min(d) AS lo, avg(d) AS mean, avg((d <= 0.25)::INTEGER) AS share FROM n GROUP BY ALL)""", body="""
SELECT case_id, jaw, candidate_index, (lo IS NOT NULL)::INTEGER::DOUBLE AS run_available, round(coalesce(lo, 8), 5) AS run_nearest, round(coalesce(mean, 8), 5) AS run_mean,
  round(coalesce(share, 0), 5) AS run_share_025 FROM z LEFT JOIN g USING (case_id, jaw, candidate_index)"""))
def cross_run_support(spark, folder):
    space, dims = described(spark, folder)
    out = X.cross_run_features(space, GROUP, dims, "candidate_run")
    return out.select(*ID, "run_available", *[rounded(c, 5).alias(c) for c in ("run_nearest", "run_mean", "run_share_025")])


@query("support_context", with_sql(CANDIDATES_SQL, """s AS (SELECT *, CASE WHEN fit_p90_mm > 2 THEN fit_p90_mm ELSE 10 END AS sy, CASE WHEN fit_p90_mm > 2 THEN selection_score_mm / 50 ELSE 1 END AS ce FROM cand),
q AS (SELECT case_id, jaw, quantile_cont(sy, 0.5) AS m, greatest(quantile_cont(sy, 0.75) - quantile_cont(sy, 0.25), 1e-6::DOUBLE) AS w FROM s GROUP BY ALL)""", body="""
SELECT case_id, jaw, candidate_index, round(percent_rank() OVER (PARTITION BY case_id, jaw ORDER BY sy), 6) AS context_crown_symmetric_rank,
  round(percent_rank() OVER (PARTITION BY case_id, jaw ORDER BY ce), 6) AS context_crown_centroid_rank, round(greatest(least((sy - m) / w, 8), -8), 6) AS context_crown_symmetric_robust_z
FROM s JOIN q USING (case_id, jaw)"""))
def support_context(spark, folder):
    rows, _ = X.base_features(rich(spark, folder))
    out, _ = X.support_context(rows, GROUP)
    return out.select(*ID, *[r6(c).alias(c) for c in ("context_crown_symmetric_rank", "context_crown_centroid_rank", "context_crown_symmetric_robust_z")])


SUPPORT_RANKS = dict(zip(
    ("context_crown_symmetric_rank", "context_crown_centroid_rank", "context_crown_overlap_deficit_rank", "context_crown_coverage_deficit_rank",
     "context_crown_refinement_gain_rank", "context_crown_refinement_motion_rank"),
    ("crown_symmetric_trim20", "crown_centroid_error_scaled", "1 - crown_source_overlap_2mm", "1 - crown_target_coverage_2mm",
     "-crown_refinement_improvement", "crown_refinement_center_motion_scaled"), strict=True))
SCALED = {**dict(zip(X.CONTEXT_NAMES[7:14], X.RANKED, strict=True)),
          "context_crown_symmetric_robust_z": "crown_symmetric_trim20", "context_crown_centroid_robust_z": "crown_centroid_error_scaled"}
CONTEXT_SQL = (
    "b AS (SELECT *, " + ", ".join(f"({BASE_SQL[n]})::DOUBLE AS b_{n}" for n in X.FEATURE_NAMES) + " FROM r)",
    "rk AS (SELECT case_id, jaw, candidate_index, " + ", ".join(
        f"percent_rank() OVER (PARTITION BY case_id, jaw ORDER BY {e}) AS {n}" for n, e in {
            **{n: f"b_{c}" for n, c in zip(X.CONTEXT_NAMES[:7], X.RANKED, strict=True)},
            **{n: e.replace("crown_", "b_crown_") for n, e in SUPPORT_RANKS.items()}}.items()) + " FROM b)",
    "qs AS (SELECT case_id, jaw, " + ", ".join(
        f"quantile_cont(b_{c}, 0.5) AS m_{c}, greatest(quantile_cont(b_{c}, 0.75) - quantile_cont(b_{c}, 0.25), 1e-6::DOUBLE) AS s_{c}" for c in SCALED.values()) + " FROM b GROUP BY ALL)",
    """sh AS (SELECT case_id, jaw, candidate_index, count(*) OVER (PARTITION BY case_id, jaw)::DOUBLE AS n, count(*) OVER (PARTITION BY case_id, jaw, target) AS nt,
  count(*) OVER (PARTITION BY case_id, jaw, source_variant) AS ns, count(*) OVER (PARTITION BY case_id, jaw, target, source_variant) AS np FROM b)""",
    """ds AS (SELECT z.case_id, z.jaw, z.candidate_index, coalesce(min(dist), 0) AS near, count(*) FILTER (WHERE dist <= 0.10) / greatest(count(dist), 1)::DOUBLE AS d10,
  count(*) FILTER (WHERE dist <= 0.25) / greatest(count(dist), 1)::DOUBLE AS d25 FROM z LEFT JOIN pr ON pr.case_id = z.case_id AND pr.jaw = z.jaw AND pr.candidate_index = z.candidate_index GROUP BY ALL)""",
    "nr AS (SELECT case_id, jaw, candidate_index, rb, min(dist) AS d FROM pr WHERE ra <> rb GROUP BY ALL)",
    "g AS (SELECT case_id, jaw, candidate_index, min(d) AS lo, avg(d) AS mean, avg((d <= 0.10)::INTEGER) AS s10, avg((d <= 0.25)::INTEGER) AS s25 FROM nr GROUP BY ALL)",
)
CONTEXT_VALUES = {
    **{n: f"b_{n}" for n in X.FEATURE_NAMES}, **{n: f"rk.{n}" for n in (*X.CONTEXT_NAMES[:7], *SUPPORT_RANKS)},
    **{n: f"greatest(least((b_{c} - m_{c}) / s_{c}, 8), -8)" for n, c in SCALED.items()},
    "context_same_target_fraction": "nt / n", "context_same_source_fraction": "ns / n", "context_same_target_source_fraction": "np / n",
    "context_opposite_axial_target": "(CASE WHEN assignment <> '' THEN assignment IN ('upper', 'lower') AND assignment <> b.jaw ELSE contains(target, 'axial_' || CASE b.jaw WHEN 'upper' THEN 'lower' ELSE 'upper' END || '_') END)::INTEGER",
    "context_jaw_upper": "(b.jaw = 'upper')::INTEGER", "context_transform_nearest_distance": "near", "context_transform_density_0p10": "d10",
    "context_transform_density_0p25": "d25", "context_cross_run_available": "(lo IS NOT NULL)::INTEGER", "context_cross_run_nearest_distance": "coalesce(lo, 8)",
    "context_cross_run_mean_nearest_distance": "coalesce(mean, 8)", "context_cross_run_support_0p10": "coalesce(s10, 0)", "context_cross_run_support_0p25": "coalesce(s25, 0)",
    "context_roi_view": "0", "context_roi_low_profile": "0",
}


@query("context_features", with_sql(CANDIDATES_SQL, RICH_SQL, SPACE_SQL, *CONTEXT_SQL, body="SELECT b.case_id, b.jaw, b.candidate_index, " + ", ".join(
    f"round(round(({e})::DOUBLE, 9), 5) AS {n}" for n, e in CONTEXT_VALUES.items()) + """ FROM b JOIN rk USING (case_id, jaw, candidate_index) JOIN qs USING (case_id, jaw)
  JOIN sh USING (case_id, jaw, candidate_index) JOIN ds USING (case_id, jaw, candidate_index) LEFT JOIN g USING (case_id, jaw, candidate_index)"""))
def context_features(spark, folder):
    rows, names = X.context_features(candidates(spark, folder), GROUP, region_view=True, prepare=enriched)
    assert len(names) == 102
    return all_rounded(X.align_features(rows.select(*ID, *names), names), ID, names, 9, 5)


@query("usable_scores", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, score, bool_and(CASE score WHEN 'rank_score_mm' THEN prior_accepted = 1 ELSE true END) AS usable
FROM cand, (SELECT unnest(['rank_score_mm', 'selection_score_mm']) AS score) GROUP BY ALL"""))
def usable_scores(spark, folder):
    rows = candidates(spark, folder).withColumn("rank_score_mm", F.when(F.col("prior_accepted") == 1, F.col("fit_score_mm")))
    return X.usable_scores(rows, GROUP, ["rank_score_mm", "selection_score_mm"])


@query("target_transform", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, candidate_index, round(ln(1 + mean_tre_mm), 6) AS log_target, round(sqrt(mean_tre_mm), 6) AS sqrt_target, round(mean_tre_mm, 6) AS back FROM cand"""))
def target_transform(spark, folder):
    rows = candidates(spark, folder)
    return rows.select(*ID, r6(K.to_target("mean_tre_mm", "log1p")).alias("log_target"), r6(K.to_target("mean_tre_mm", "sqrt")).alias("sqrt_target"),
                       r6(K.from_target(K.to_target("mean_tre_mm", "log1p"), "log1p")).alias("back"))


FEATURES = ["selection_score_mm", "fit_score_mm", "fit_p90_mm", "target_coverage_2mm", "turn_deg"]


@query("pair_table", with_sql(CANDIDATES_SQL, """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS r FROM cand) WHERE r <= 5),
p AS (SELECT a.case_id, a.jaw, a.candidate_index AS i, b.candidate_index AS j, a.mean_tre_mm AS ea, b.mean_tre_mm AS eb, a.fit_score_mm - b.fit_score_mm AS df FROM t a JOIN t b
  ON a.case_id = b.case_id AND a.jaw = b.jaw AND a.candidate_index < b.candidate_index AND abs(ln(1 + a.mean_tre_mm) - ln(1 + b.mean_tre_mm)) >= 0.2::DOUBLE),
k AS (SELECT *, count(*) OVER (PARTITION BY case_id, jaw) AS n FROM (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY sha256('0|' || case_id || '|' || jaw || '|' || i || '|' || j), i, j) AS r FROM p) WHERE r <= 6)""", body="""
SELECT case_id, jaw, i AS candidate_index, j AS other, s AS sign, (CASE WHEN s > 0 THEN ea < eb ELSE eb < ea END)::INTEGER::DOUBLE AS label,
  round(1 / (2.0::DOUBLE * n), 6) AS weight, round(df * s, 6) AS fit_difference FROM k, (SELECT unnest([1.0, -1.0]::DOUBLE[]) AS s)"""))
def pair_table(spark, folder):
    rows = S.top_by_score(candidates(spark, folder), GROUP, "selection_score_mm", 5)
    out = L.pair_table(rows, GROUP, FEATURES, "mean_tre_mm", 0.2, 6)
    return out.select(*ID, F.col("_j").alias("other"), "sign", "label", r6("weight").alias("weight"), r6("fit_score_mm").alias("fit_difference"))


@query("group_weights", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, candidate_index, round(CASE WHEN case_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * target_coverage_2mm * CASE candidate_run WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.5 END::DOUBLE END
  / count(*) OVER (PARTITION BY case_id, jaw), 6) AS weight FROM cand"""))
def group_weights(spark, folder):
    rows = candidates(spark, folder)
    times = K.mapped("candidate_run", {"A": 1.0, "N": 0.8}, 0.5)
    out = L.group_weights(rows, GROUP, F.pmod("case_id", F.lit(2)) == 0, 0.5, F.col("target_coverage_2mm"), times)
    return out.select(*ID, r6("weight").alias("weight"))


def training_rows(spark, folder, *more):
    rows = L.group_weights(candidates(spark, folder), GROUP).withColumn("fold", F.pmod("case_id", F.lit(2)).cast("int"))
    return cut_lineage(rows.select(*ID, "fold", "weight", "mean_tre_mm", *[f for f in FEATURES if f != "mean_tre_mm"], *more))


def oof_regression(rows, trees=4, depth=4, seeds=(1, 2), kind="forest"):
    return L.out_of_fold(
        rows, "fold", [0, 1], seeds,
        lambda train, seed: L.fit_regression(train, FEATURES, "mean_tre_mm", seed, kind=kind, trees=trees, depth=depth),
        lambda model, held, seed: L.score_regression({seed: model}, held, FEATURES, [*ID, "mean_tre_mm"]))


@query("out_of_fold_scores")
def out_of_fold_scores(spark, folder):
    rows = training_rows(spark, folder)
    predictions = oof_regression(rows)
    gaps = L.coverage_gaps(rows, predictions, ID, 2)
    if not gaps.isEmpty():
        raise ValueError("some rows have no prediction")
    return L.selected_errors(predictions, rows, GROUP, "mean_tre_mm", "vote").select(*GROUP, "candidate_index", "ensemble_method", "mean_tre_mm")


@query("random_tree_scores")
def random_tree_scores(spark, folder):
    rows = training_rows(spark, folder)
    predictions = oof_regression(rows, kind="random_trees", seeds=(1,))
    return L.selected_errors(predictions, rows, GROUP, "mean_tre_mm", "vote").select(*GROUP, "candidate_index", "ensemble_method", "mean_tre_mm")


@query("grid_sweep")
def grid_sweep(spark, folder):
    rows = training_rows(spark, folder)
    configs = [{"trees": 2, "depth": 2}, {"trees": 3, "depth": 4}]
    return L.grid_sweep(configs, lambda c: L.selected_errors(
        oof_regression(rows, c["trees"], c["depth"], (1,)), rows, GROUP, "mean_tre_mm", "mean"), "mean_tre_mm")


@query("pair_ensemble")
def pair_ensemble(spark, folder):
    """Pool, regression and pairwise scores, blend and joint pair for every case.

    Matrices are made for the pool alone, and both score tables are written once. The pairs keep the layout of the candidates, on which the draws of the forest hang.
    """
    rows = training_rows(spark, folder, "candidate_run", "chirality")
    regression = {s: L.fit_regression(rows, FEATURES, "mean_tre_mm", s, trees=4, depth=4) for s in (1, 2)}
    subset = S.top_by_score(candidates(spark, folder), GROUP, "selection_score_mm", 5)
    pairs = cut_lineage(L.pair_table(subset, GROUP, FEATURES, "mean_tre_mm", 0.2, 10))
    pairwise = {s: L.fit_pairwise(pairs, FEATURES, s, trees=4, depth=4) for s in (1,)}
    pool = cut_lineage(posed(S.run_balanced_top(rows, GROUP, "candidate_run", "selection_score_mm", 10)))
    by_regression = S.seed_aggregates(cut_lineage(L.score_regression(regression, pool, FEATURES, ID)), GROUP, "seed", "cost")
    by_pairs = S.seed_aggregates(cut_lineage(L.score_pairwise(pairwise, pool, GROUP, FEATURES, 6)), GROUP, "seed", "cost")
    scores = by_regression.select(*ID, F.col("vote_score").alias("first")).join(by_pairs.select(*ID, F.col("median_cost").alias("second")), ID)
    blended = S.rank_blend(scores, GROUP, "first", "second", [0.575], bounded=True)
    ranked = cut_lineage(S.top_by_score(blended.join(pool.select(*ID, "chirality", "transform"), ID).withColumnRenamed("blend_score", "score"), GROUP, "score", 10))
    one, zero = F.lit(1.0), F.lit(0.0)
    identity = [one, zero, zero, zero, one, zero, zero, zero, one]
    out = S.joint_pairs(ranked, "case_id", identity, [zero, zero, zero])
    return out.select("case_id", "upper_candidate_index", "lower_candidate_index", r6("objective").alias("objective"), "widened")


@query("lowest_predicted", with_sql(CANDIDATES_SQL, """w AS (SELECT case_id, jaw, candidate_run, min(fit_score_mm) AS predicted FROM cand GROUP BY ALL)""", body="""
SELECT case_id, jaw, candidate_run, round(predicted, 6) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY predicted, candidate_run) AS r FROM w) WHERE r = 1"""))
def lowest_predicted(spark, folder):
    per = candidates(spark, folder).groupBy(*GROUP, "candidate_run").agg(F.min("fit_score_mm").alias("predicted"))
    out = L.lowest_predicted(per, GROUP, "predicted", "candidate_run")
    return out.select(*GROUP, "candidate_run", r6("predicted").alias("predicted"))
