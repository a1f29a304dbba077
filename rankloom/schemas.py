"""Explicit schemas; nothing is inferred, so zero-padded ids stay text and matrices stay double."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


MATRIX = T.ArrayType(T.ArrayType(_D))
VECTOR = T.ArrayType(_D)

MANIFEST = struct(split=_S, case_id=_S, jaw=_S, cbct_path=_S, ios_path=_S, transform_path=_S, complete=_S)

METADATA = struct(
    mode=_S, threshold=_D, component_voxels=_L, support_voxels=_L, aggregate_count=_I, axial_assignment=_S, volume_path=_S,
    source_volume_path=_S, minimum_probability=_D, selection=_S, requested_voxels=_L, guidance_radius_mm=_D, detected_teeth=_I,
    crown_fraction=_D, coarse_target=_S,
)

CANDIDATE = struct(
    unsupervised_rank=_I, target=_S, source_variant=_S, method=_S, chirality=_I, selection_score_mm=_D, rank_score_mm=_D,
    prior_angle_deg=_D, prior_accepted=_I, fit_score_mm=_D, fit_score_initial_mm=_D, fit_median_mm=_D, fit_p90_mm=_D,
    overlap_2mm=_D, target_trimmed_score_mm=_D, target_coverage_1mm=_D, target_coverage_2mm=_D, correspondences=_I,
    transform=MATRIX, transform_initial=MATRIX, source_full_centroid=VECTOR, predicted_full_centroid=VECTOR,
    jaw_reference_center=VECTOR, target_metadata=METADATA, source_candidate_run=_S, mean_tre_mm=_D,
)

RESULT = struct(
    record=struct(case_id=_S, jaw=_S, split=_S), target=struct(name=_S),
    registration=struct(transform=MATRIX, score=_D), selection=struct(target_mode=_S, chirality_mode=_S), metrics=struct(mean_tre_mm=_D),
)

AUDIT = struct(case_id=_S, jaw=_S, method=_S, predicted_tre_mm=_D, full_p90_mm=_D, target=_S, roi_used=_B)
HASH_ENTRY = struct(size=_L, mtime_ns=_L, sha256=_S)
SCORES = struct(case_id=_S, jaw=_S, ensemble_method=_S, candidate_index=_I, ensemble_score=_D, mean_tre_mm=_D, candidate_run=_S)
