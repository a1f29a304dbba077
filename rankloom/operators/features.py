"""Feature columns of candidates and their context inside the case group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import keys as K
from ..functions import matrix as M
from ..session import cut_lineage
from .grouping import hot_groups, hot_limit, join_null_safe, largest_group, lowest_fraction, robust_z
from .held_context import context_udf
from .spatial import HELD, held_pairs, near_counts, nearest

# The names under which features are recorded with a model, in order.
FEATURE_NAMES = [
    "selection_score", "source_fit", "initial_fit", "fit_median", "fit_p90", "overlap_2mm", "target_fit", "target_coverage_1mm",
    "target_coverage_2mm", "correspondences_scaled", "prior_angle_scaled", "center_dx_scaled", "center_dy_scaled", "center_dz_scaled",
    "center_distance_scaled", "threshold_scaled", "component_log_voxels_scaled", "target_aggregate", "aggregate_count_scaled",
    "target_adaptive", "axial_assignment_requested", "axial_assignment_opposite", "source_fraction", "source_low", "source_high",
    "method_basin", "chirality_negative", "full_trim_10", "full_trim_20", "full_trim_35", "full_distance_median", "full_distance_p90",
    "full_overlap_1mm", "full_overlap_2mm", "full_overlap_3mm", "full_target_coverage_2mm", "full_normal_abs_cosine",
    "full_geometry_available", "proper_rotation_00", "proper_rotation_01", "proper_rotation_02", "proper_rotation_10",
    "proper_rotation_11", "proper_rotation_12", "proper_rotation_20", "proper_rotation_21", "proper_rotation_22",
    "crown_source_trim20", "crown_target_trim20", "crown_symmetric_trim20", "crown_source_median", "crown_target_median",
    "crown_source_overlap_2mm", "crown_target_coverage_2mm", "crown_centroid_error_scaled", "crown_consistency_available",
    "crown_refinement_initial_trim20", "crown_refinement_improvement", "crown_refinement_center_motion_scaled",
    "crown_refinement_angle_scaled", "crown_refinement_alpha", "crown_refinement_available", "target_crown_mask",
    "target_crown_probability", "target_crown_guided",
]
CONTEXT_NAMES = [
    "context_selection_rank", "context_source_fit_rank", "context_target_fit_rank", "context_full_trim20_rank",
    "context_full_median_rank", "context_full_p90_rank", "context_prior_angle_rank", "context_selection_robust_z",
    "context_source_fit_robust_z", "context_target_fit_robust_z", "context_full_trim20_robust_z", "context_full_median_robust_z",
    "context_full_p90_robust_z", "context_prior_angle_robust_z", "context_same_target_fraction", "context_same_source_fraction",
    "context_same_target_source_fraction", "context_opposite_axial_target", "context_jaw_upper",
    "context_transform_nearest_distance", "context_transform_density_0p10", "context_transform_density_0p25",
    "context_cross_run_available", "context_cross_run_nearest_distance", "context_cross_run_mean_nearest_distance",
    "context_cross_run_support_0p10", "context_cross_run_support_0p25", "context_crown_symmetric_rank",
    "context_crown_centroid_rank", "context_crown_overlap_deficit_rank", "context_crown_coverage_deficit_rank",
    "context_crown_symmetric_robust_z", "context_crown_centroid_robust_z", "context_crown_refinement_gain_rank",
    "context_crown_refinement_motion_rank",
]
REGION_NAMES = ["context_roi_view", "context_roi_low_profile"]
MODALITY_NAMES = ["target_toothseg", "toothseg_detected_fraction", "toothseg_crown_fraction"]

ROTATION = [n for n in FEATURE_NAMES if n.startswith("proper_rotation_")]
OFFSETS = ["center_dx_scaled", "center_dy_scaled", "center_dz_scaled"]

# Feature, the candidate column it is read from, the value that stands for a missing one, the divisor.
NUMBERS = [
    ("selection_score", "selection_score_mm", 0.0, 1.0), ("source_fit", "fit_score_mm", 0.0, 1.0), ("initial_fit", "fit_score_initial_mm", 0.0, 1.0),
    ("fit_median", "fit_median_mm", 0.0, 1.0), ("fit_p90", "fit_p90_mm", 0.0, 1.0), ("overlap_2mm", "overlap_2mm", 0.0, 1.0),
    ("target_fit", "target_trimmed_score_mm", 0.0, 1.0), ("target_coverage_1mm", "target_coverage_1mm", 0.0, 1.0),
    ("target_coverage_2mm", "target_coverage_2mm", 0.0, 1.0), ("correspondences_scaled", "correspondences", 0.0, 5000.0),
    ("prior_angle_scaled", "prior_angle_deg", 0.0, 180.0), ("full_trim_10", "full_trim_10_mm", 10.0, 1.0),
    ("full_trim_20", "full_trim_20_mm", 10.0, 1.0), ("full_trim_35", "full_trim_35_mm", 10.0, 1.0),
    ("full_distance_median", "full_distance_median_mm", 20.0, 1.0), ("full_distance_p90", "full_distance_p90_mm", 40.0, 1.0),
    ("full_overlap_1mm", "full_overlap_1mm", 0.0, 1.0), ("full_overlap_2mm", "full_overlap_2mm", 0.0, 1.0),
    ("full_overlap_3mm", "full_overlap_3mm", 0.0, 1.0), ("full_target_coverage_2mm", "full_target_coverage_2mm", 0.0, 1.0),
    ("full_normal_abs_cosine", "full_normal_abs_cosine", 0.0, 1.0), ("crown_source_trim20", "crown_source_trim20_mm", 10.0, 1.0),
    ("crown_target_trim20", "crown_target_trim20_mm", 10.0, 1.0), ("crown_symmetric_trim20", "crown_symmetric_trim20_mm", 10.0, 1.0),
    ("crown_source_median", "crown_source_median_mm", 20.0, 1.0), ("crown_target_median", "crown_target_median_mm", 20.0, 1.0),
    ("crown_source_overlap_2mm", "crown_source_overlap_2mm", 0.0, 1.0), ("crown_target_coverage_2mm", "crown_target_coverage_2mm", 0.0, 1.0),
    ("crown_centroid_error_scaled", "crown_centroid_error_mm", 50.0, 50.0),
    ("crown_refinement_initial_trim20", "crown_refinement_initial_trim20_mm", 10.0, 1.0),
    ("crown_refinement_improvement", "crown_refinement_improvement_mm", 0.0, 1.0),
    ("crown_refinement_center_motion_scaled", "crown_refinement_center_motion_mm", 0.0, 5.0),
    ("crown_refinement_angle_scaled", "crown_refinement_angle_deg", 0.0, 10.0), ("crown_refinement_alpha", "crown_refinement_alpha", 0.0, 1.0),
]
# Availability flag and the column whose presence it states; mode flag and the mode it stands for.
AVAILABLE = {"full_geometry_available": "full_trim_20_mm", "crown_consistency_available": "crown_symmetric_trim20_mm",
             "crown_refinement_available": "crown_refinement_improvement_mm"}
MODES = {"target_crown_mask": "crown_localizer", "target_crown_probability": "crown_probability", "target_crown_guided": "crown_guided_cbct"}


class Candidate:
    """Columns of a candidate table with a default for those a run does not have."""

    def __init__(self, df: DataFrame):
        self.have = set(df.columns)
        meta = df.schema["target_metadata"].dataType.names if "target_metadata" in self.have else []
        self.meta = {n: f"target_metadata.{n}" for n in meta}

    def raw(self, name: str, kind: str = "double") -> Column:
        if name in self.have:
            return F.col(name).cast(kind)
        return F.col(self.meta[name]).cast(kind) if name in self.meta else F.lit(None).cast(kind)

    def number(self, name: str, default: float) -> Column:
        return F.coalesce(self.raw(name), F.lit(float(default)))

    def text(self, name: str) -> Column:
        return F.coalesce(self.raw(name, "string"), F.lit(""))


def base_features(df: DataFrame, jaw: str = "jaw") -> tuple[DataFrame, list[str]]:
    """The 65 base columns of a candidate under their recorded names, as one projection.

    A candidate column of the same name as a feature is replaced by it.
    """
    c = Candidate(df)
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    out: dict[str, Column] = {name: c.number(column, default) / scale for name, column, default, scale in NUMBERS}
    for axis, name in enumerate(OFFSETS):
        pair = [F.get(F.col(n), F.lit(axis)) if n in c.have else F.lit(None).cast("double") for n in ("predicted_full_centroid", "jaw_reference_center")]
        out[name] = F.coalesce((pair[0] - pair[1]) / 50.0, F.lit(0.0))
    out["center_distance_scaled"] = M.norm([out[n] for n in OFFSETS])
    mode, top = c.text("mode"), c.text("selection") == "top_voxels"
    probability, guided = mode == "crown_probability", mode == "crown_guided_cbct"
    out["threshold_scaled"] = F.when(probability, c.number("minimum_probability", 0.0)).otherwise(c.number("threshold", 0.0) / 2000.0)
    out["component_log_voxels_scaled"] = F.log1p(F.coalesce(c.raw("component_voxels"), c.raw("support_voxels"), F.lit(0.0))) / 12.0
    ranked = probability & top
    out["target_aggregate"] = flag(ranked | F.contains(mode, F.lit("aggregate")))
    out["aggregate_count_scaled"] = (
        F.when(ranked, c.number("requested_voxels", 0.0) / 4000.0).when(guided, c.number("guidance_radius_mm", 0.0) / 6.0)
        .otherwise(c.number("aggregate_count", 0.0) / 4.0))
    out["target_adaptive"] = flag(F.contains(mode, F.lit("adaptive")))
    assigned = F.when((c.text("axial_assignment") == "") & (mode == "threshold"), F.col(jaw)).otherwise(c.text("axial_assignment"))
    out["axial_assignment_requested"] = flag((assigned != "") & (assigned == F.col(jaw)))
    out["axial_assignment_opposite"] = flag((assigned != "") & (assigned != F.col(jaw)))
    variant = c.text("source_variant")
    out["source_fraction"] = K.source_fraction(variant)
    out["source_low"], out["source_high"] = flag(F.contains(variant, F.lit("low"))), flag(F.contains(variant, F.lit("high")))
    out["method_basin"] = flag(F.contains(c.text("method"), F.lit("basin")))
    out["chirality_negative"] = flag(M.det_sign("transform") < 0)
    out |= dict(zip(ROTATION, M.proper_rotation("transform"), strict=True))
    out |= {name: flag(c.raw(column).isNotNull()) for name, column in AVAILABLE.items()}
    out |= {name: flag(mode == value) for name, value in MODES.items()}
    return df.withColumns({n: out[n].cast("double") for n in FEATURE_NAMES}), list(FEATURE_NAMES)


def modality_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Three more columns for tooth-wise segmentations, 0 for every other mode; the base columns stay."""
    c = Candidate(df)
    own = c.text("mode") == "toothseg"
    values = (F.lit(1.0), c.number("detected_teeth", 0.0) / 16.0, c.number("crown_fraction", 0.0))
    return df.withColumns({n: F.when(own, v).otherwise(0.0) for n, v in zip(MODALITY_NAMES, values, strict=True)}), list(MODALITY_NAMES)


def frequency_shares(
    df: DataFrame, keys: Sequence[str], target: str = "target", source: str = "source_variant"
) -> DataFrame:
    """Share of the group with the same target, source and (target, source).

    One count per (group, target, source) feeds all three shares; only these
    small tables are joined back.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, target, source).agg(F.count(F.lit(1)).alias("_pair"))
    totals = cells.groupBy(*keys).agg(F.sum("_pair").alias("_all"))
    out = join_null_safe(df, cells, [*keys, target, source], "left")
    for column, name in ((target, "_target"), (source, "_source")):
        part = cells.groupBy(*keys, column).agg(F.sum("_pair").alias(name))
        out = join_null_safe(out, part, [*keys, column], "left")
    out = join_null_safe(out, totals, keys, "left")
    return (
        out.withColumn("target_share", F.col("_target") / F.col("_all"))
        .withColumn("source_share", F.col("_source") / F.col("_all"))
        .withColumn("pair_share", F.col("_pair") / F.col("_all"))
        .drop("_pair", "_all", "_target", "_source")
    )


def lowest_fractions(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Several shared-place ranks over one partitioning: one shuffle for all of them."""
    if hot_groups(df, keys, hot_limit(df)).isEmpty():
        group = W.partitionBy(*keys)
        return df.withColumns({n: F.percent_rank().over(group.orderBy(e)) for n, e in columns.items()})
    for name, expr in columns.items():
        df = cut_lineage(lowest_fraction(df, keys, expr, name))  # one written step per rank
    return df


def descriptor_space(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Twelve robustly scaled pose columns, divided by sqrt(12) so distances are per-dimension."""
    columns = [*OFFSETS, *ROTATION]
    out = robust_z(df, keys, {c: f"_d{i}" for i, c in enumerate(columns)})
    names = [f"_d{i}" for i in range(len(columns))]
    return out.withColumns({n: F.col(n) / (len(columns) ** 0.5) for n in names}), names


def density_features(space: DataFrame, keys: Sequence[str], dims: Sequence[str], ident: str = "candidate_index") -> DataFrame:
    """Nearest other row and share of other rows within 0.10 and 0.25, per row."""
    keys = list(keys)
    if largest_group(space, keys) <= HELD:
        sq, others = F.col("_sq"), F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
        return held_pairs(space, keys, dims, ident).groupBy(*keys, F.col("q_id").alias(ident)).agg(
            F.coalesce(F.sqrt(F.min(F.when(F.col("q_id") != F.col("t_id"), sq))), F.lit(0.0)).alias("nearest"),
            *[((F.count_if(sq <= r * r) - 1) / others).alias(name) for r, name in ((0.10, "density_010"), (0.25, "density_025"))])
    near = nearest(space, space, keys, dims, ident, ident, exclude_self=True).select(*keys, ident, F.col("distance").alias("nearest"))
    counts = near_counts(space, space, keys, dims, [0.10, 0.25], ident, ident)
    sizes = space.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = join_null_safe(join_null_safe(counts, near, [*keys, ident], "left"), sizes, keys, "left")
    others = F.greatest(F.col("_n") - 1, F.lit(1))
    return out.select(*keys, ident, F.coalesce("nearest", F.lit(0.0)).alias("nearest"),
                      ((F.col("within_0") - 1) / others).alias("density_010"), ((F.col("within_1") - 1) / others).alias("density_025"))


def cross_run_features(space: DataFrame, keys: Sequence[str], dims: Sequence[str], run: str, ident: str = "candidate_index") -> DataFrame:
    """Distance to the closest row of every other run: available, minimum, mean, shares within 0.10 and 0.25.

    Each row is searched against each other run of its group as a set of its own.
    A group with a single run gets (0, 8, 8, 0, 0).
    """
    keys = list(keys)
    defaults = {"run_available": 0.0, "run_nearest": 8.0, "run_mean": 8.0, "run_share_010": 0.0, "run_share_025": 0.0}
    if largest_group(space, keys) <= HELD:
        pairs = held_pairs(space, keys, dims, ident, [run])
        other = F.when(~F.col(f"q_{run}").eqNullSafe(F.col(f"t_{run}")), F.col("_sq"))
        per = pairs.groupBy(*keys, F.col("q_id").alias(ident), f"t_{run}").agg(F.sqrt(F.min(other)).alias("distance"))
        return per.groupBy(*keys, ident).agg(*[F.coalesce(e, F.lit(defaults[n])).alias(n) for n, e in _run_summary().items()])
    runs = space.select(*keys, F.col(run).alias("_other")).distinct()
    asks = join_null_safe(space.select(*keys, run, ident, *dims), runs, keys, "inner").where(~F.col(run).eqNullSafe(F.col("_other")))
    targets = space.select(*keys, F.col(run).alias("_other"), ident, *dims)
    per = nearest(asks, targets, [*keys, "_other"], dims, ident, ident)
    table = per.groupBy(*keys, ident).agg(*[e.alias(n) for n, e in _run_summary().items()])
    out = join_null_safe(space.select(*keys, ident), table, [*keys, ident], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def _run_summary() -> dict[str, Column]:
    d = F.col("distance")
    return {"run_available": F.max(F.when(d.isNotNull(), 1.0)), "run_nearest": F.min(d), "run_mean": F.avg(d),
            "run_share_010": F.avg((d <= 0.10).cast("double")), "run_share_025": F.avg((d <= 0.25).cast("double"))}


#: Columns that are ranked and scaled within the group, in the order of CONTEXT_NAMES.
RANKED = ("selection_score", "source_fit", "target_fit", "full_trim_20", "full_distance_median", "full_distance_p90", "prior_angle_scaled")


def support_context(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Ranks and scaled values of the support columns (deficits, negated gain)."""
    ranks, scaled = support_ranks(), SUPPORT_SCALED
    out = robust_z(lowest_fractions(df, keys, ranks), keys, scaled)
    return out, CONTEXT_NAMES[27:]


SUPPORT_SCALED = {"crown_symmetric_trim20": "context_crown_symmetric_robust_z", "crown_centroid_error_scaled": "context_crown_centroid_robust_z"}


def support_ranks() -> dict[str, Column]:
    return {
        "context_crown_symmetric_rank": F.col("crown_symmetric_trim20"), "context_crown_centroid_rank": F.col("crown_centroid_error_scaled"),
        "context_crown_overlap_deficit_rank": 1.0 - F.col("crown_source_overlap_2mm"),
        "context_crown_coverage_deficit_rank": 1.0 - F.col("crown_target_coverage_2mm"),
        "context_crown_refinement_gain_rank": -F.col("crown_refinement_improvement"),
        "context_crown_refinement_motion_rank": F.col("crown_refinement_center_motion_scaled"),
    }


def run_name(df: DataFrame, run: str = "candidate_run") -> Column:
    """The run a candidate was found in, else the one it was listed in, else empty."""
    names = [F.col(n).cast("string") for n in ("source_candidate_run", run) if n in df.columns]
    return F.coalesce(*names, F.lit(""))


def context_features(
    df: DataFrame, keys: Sequence[str], run: str = "candidate_run", jaw: str = "jaw", ident: str = "candidate_index",
    region_view: bool = False, prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, list[str]]:
    """All base and context columns of a candidate table and their names in order (100, or 102).

    Groups of at most HELD rows meet whole, in one shuffle by the keys: only the values that a context needs are turned into arrays, and the
    wide columns are made from the candidates again behind it. Larger groups alone take blocks, whose columns are joined to the wide ones.
    ``prepare`` adds columns to each row from its other columns; what it adds is made anew and not carried.
    """
    keys = list(keys)
    names = [*FEATURE_NAMES, *CONTEXT_NAMES, *(REGION_NAMES if region_view else [])]
    large = hot_groups(df, keys, HELD)
    if large.isEmpty():
        return _held_context(df, keys, run, jaw, region_view, prepare), names
    large = cut_lineage(large.select(*keys))
    small = _held_context(join_null_safe(df, large, keys, "left_anti"), keys, run, jaw, region_view, prepare)
    return small.unionByName(_wide_context(prepare(join_null_safe(df, large, keys, "left_semi")), keys, run, jaw, ident, region_view)), names


def _own_context(df: DataFrame, run: str, jaw: str, region_view: bool) -> dict[str, Column]:
    """Context columns that a candidate alone tells."""
    c = Candidate(df)
    out = {"context_opposite_axial_target": K.opposite_target("target", c.text("axial_assignment"), jaw).cast("double"),
           "context_jaw_upper": (F.col(jaw) == "upper").cast("double")}
    if region_view:
        name = F.lower(run_name(df, run))
        path = F.lower(F.coalesce(c.raw("source_volume_path", "string"), c.raw("volume_path", "string"), F.lit("")))
        out["context_roi_view"] = (F.contains(name, F.lit("roi")) | F.contains(path, F.lit("roi"))).cast("double")
        out["context_roi_low_profile"] = (F.contains(name, F.lit("lowadaptive")) | F.contains(name, F.lit("roi_low"))).cast("double")
    return out


def _held_context(df: DataFrame, keys: list[str], run: str, jaw: str, region_view: bool, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The context of groups of at most HELD rows, by one aggregate over their keys."""
    rest = [c for c in df.columns if c not in keys]
    ranks = {**{n: F.col(v) for n, v in zip(CONTEXT_NAMES[:7], RANKED, strict=True)}, **support_ranks()}
    scaled = {**dict(zip(RANKED, CONTEXT_NAMES[7:14], strict=True)), **SUPPORT_SCALED}
    dims = [*OFFSETS, *ROTATION]
    whole = prepare(df.select("*", F.struct(*rest).alias("_row")))
    based, _ = base_features(whole.withColumn("_run", run_name(whole, run)), jaw)
    numbers = F.array(*ranks.values(), *[F.col(c) for c in dims])
    each = based.select(*keys, F.struct("_row", numbers.alias("v"), F.col("_run").alias("r"), F.col("target").cast("string").alias("t"),
                                        F.col("source_variant").cast("string").alias("s")).alias("_e"))
    groups = each.groupBy(*keys).agg(F.collect_list("_e").alias("_all"))
    # the scaled columns are ranked as they are, and stand first
    found = context_udf(len(ranks), list(range(len(scaled))), len(dims))("_all.v", "_all.r", "_all.t", "_all.s")
    rows = groups.select(*keys, "_all._row", found.alias("found")).select(*keys, F.inline(F.arrays_zip("_row", "found")))
    made = [*ranks, *scaled.values(), *CONTEXT_NAMES[14:17], *CONTEXT_NAMES[19:27]]
    rows = prepare(rows.select(*keys, "_row.*", *[F.get("found", F.lit(i)).alias(n) for i, n in enumerate(made)]))
    return base_features(rows.withColumns(_own_context(rows, run, jaw, region_view)), jaw)[0].select(*_wide_columns(prepare(df), region_view))


def _wide_columns(df: DataFrame, region_view: bool) -> list[str]:
    made = [*FEATURE_NAMES, *CONTEXT_NAMES, *(REGION_NAMES if region_view else [])]
    return [*[c for c in df.columns if c not in made], *made]


def _wide_context(df: DataFrame, keys: list[str], run: str, jaw: str, ident: str, region_view: bool) -> DataFrame:
    """The context of groups of any size; blocks are computed on the key columns and what they need, and joined once."""
    rows, _ = base_features(df, jaw)
    rows = rows.withColumns({"_run": run_name(df, run), **_own_context(df, run, jaw, region_view)})
    rows = cut_lineage(rows)  # the projection is read by every block below
    needed = ["crown_symmetric_trim20", "crown_centroid_error_scaled", "crown_source_overlap_2mm", "crown_target_coverage_2mm",
              "crown_refinement_improvement", "crown_refinement_center_motion_scaled"]
    block = rows.select(*keys, ident, "target", "source_variant", *RANKED, *needed)
    block = lowest_fractions(block, keys, {n: F.col(v) for n, v in zip(CONTEXT_NAMES[:7], RANKED, strict=True)})
    block = robust_z(block, keys, dict(zip(RANKED, CONTEXT_NAMES[7:14], strict=True)))
    shares = dict(zip(("target_share", "source_share", "pair_share"), CONTEXT_NAMES[14:17], strict=True))
    block = frequency_shares(block, keys).withColumnsRenamed(shares)
    block, support = support_context(block, keys)
    space, dims = descriptor_space(rows.select(*keys, ident, "_run", *OFFSETS, *ROTATION), keys)
    slim = cut_lineage(space.select(*keys, ident, "_run", *dims))
    near = density_features(slim, keys, dims, ident)
    near = near.withColumnsRenamed(dict(zip(("nearest", "density_010", "density_025"), CONTEXT_NAMES[19:22], strict=True)))
    across = cross_run_features(slim, keys, dims, "_run", ident)
    across = across.withColumnsRenamed(dict(zip(("run_available", "run_nearest", "run_mean", "run_share_010", "run_share_025"), CONTEXT_NAMES[22:27], strict=True)))
    block = block.select(*keys, ident, *CONTEXT_NAMES[:17], *support)
    for part in (near, across, block):
        rows = join_null_safe(rows, part, [*keys, ident], "left")
    return rows.select(*_wide_columns(df, region_view))


def align_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The recorded features by name, in recorded order; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"features not available: {missing}")
    return df.select(*[c for c in df.columns if c not in names], *names)


def usable_scores(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Per group and score column: whether every row has it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).isNotNull().alias("has")) for s in scores]))
    return df.select(*keys, pairs.alias("_p")).groupBy(*keys, F.col("_p.score").alias("score")).agg(F.bool_and("_p.has").alias("usable"))
