"""Candidate generation: every set's sources against all its targets, stage by stage, and the transfer of known poses between surfaces.

Each stage is one batch over all pairs that are left; what cannot be aligned is told apart before it and ends in a table of failures, so one bad
set never stops the others. Stages are committed in a folder: a run that was cut short goes on with the keys that are missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..session import cut_lineage
from ..sources.stages import Stages
from .grouping import largest_group, positions, top_k
from .registration import basin_search, paired_clouds, register, score_jobs, trimmed_alignment, two_way_rescored
from .selection import first_per_key
from .spatial import hashed_sample, two_way_score, within_radius

PAIR = ("set_id", "target", "variant")
FAMILIES = ("adaptive", "tracked", "aggregate")


@dataclass(frozen=True)
class Plan:
    """Settings of a run; the defaults are those of the recorded method."""

    parities: tuple[int, ...] = (1, -1)
    refine: int = 4
    schedule: tuple[float, ...] = (8.0, 5.0, 3.0, 2.0, 1.25)
    rounds: int = 8
    least: int = 32
    fewest: int = 3  # points that a source or target needs
    most_targets: int = 1000
    adaptive_top: int = 2
    adaptive_radius: float = 6.0
    adaptive_schedule: tuple[float, ...] = (4.0, 2.5, 1.5, 1.0)
    adaptive_least: int = 128  # points of a local target
    basin_top: int = 0
    basin_choice: str = "global"  # or "source-diverse", "source-target-diverse"
    basin_samples: int = 384
    basin_stages: tuple[tuple[float, float], ...] = ((12.0, 8.0), (6.0, 4.0), (3.0, 2.0))
    basin_refine: int = 8
    basin_schedule: tuple[float, ...] = (4.0, 2.0, 1.25)
    basin_rounds: int = 5
    prior_penalty: float = 0.002
    prior_limit: float = 90.0
    seed: int = 0


class Generated(NamedTuple):
    candidates: DataFrame
    best: DataFrame
    failures: DataFrame


def usable(points: DataFrame, keys: Sequence[str], fewest: int) -> DataFrame:
    """(keys, fault): null for a cloud that can be aligned, else why it can't."""
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sums = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum((~finite).cast("long")).alias("_odd"))
    fault = F.when(F.col("_odd") > 0, "coordinates that are not finite").when(F.col("_n") < fewest, F.lit(f"fewer than {fewest} points"))
    return sums.select(*keys, fault.alias("fault"))


def job_table(wanted: DataFrame, sources: DataFrame, targets: DataFrame, plan: Plan, ranks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs to align, failures): all source variants of a wanted set with its targets, the first ``most_targets`` by ``ranks``.

    ``ranks`` holds (set_id, target, rank_score); targets without one come first, ties go by name.
    """
    sets = wanted.select("set_id").distinct()
    s = usable(sources, ["set_id", "variant"], plan.fewest).join(sets, "set_id", "left_semi")
    t = usable(targets, ["set_id", "target"], plan.fewest).join(sets, "set_id", "left_semi")
    score = F.lit(0.0)
    if ranks is not None:
        t = t.join(ranks.select("set_id", "target", "rank_score"), ["set_id", "target"], "left")
        score = F.coalesce("rank_score", F.lit(0.0))
    good_s = s.where(F.col("fault").isNull()).select("set_id", "variant")
    good_t = top_k(t.where(F.col("fault").isNull()), ["set_id"], [score, F.col("target")], plan.most_targets).select("set_id", "target")
    none = F.lit(None).cast("string")
    bad = [
        sets.join(t, "set_id", "left_anti").select("set_id", none.alias("target"), none.alias("variant"), F.lit("target_extraction").alias("stage"), F.lit("no target").alias("error")),
        sets.join(s, "set_id", "left_anti").select("set_id", none.alias("target"), none.alias("variant"), F.lit("source").alias("stage"), F.lit("no source").alias("error")),
        t.where("fault IS NOT NULL").select("set_id", "target", none.alias("variant"), F.lit("target_extraction").alias("stage"), F.col("fault").alias("error")),
        s.where("fault IS NOT NULL").select("set_id", none.alias("target"), "variant", F.lit("source").alias("stage"), F.col("fault").alias("error")),
    ]
    failures = bad[0]
    for part in bad[1:]:
        failures = failures.unionByName(part)
    return good_t.join(good_s, "set_id"), failures


def _goal(*columns: str) -> Column:
    return F.concat_ws("/", *columns)


def _clouds(sources: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and targets under one name each, as the batch alignment wants them."""
    xyz = ["x", "y", "z"]
    return (sources.select(_goal("set_id", "variant").alias("set_id"), "point_id", *xyz),
            targets.select(_goal("set_id", "target").alias("set_id"), "point_id", *xyz))


def _only(points: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.join(pairs.select(*keys).distinct(), list(keys), "left_semi")


RESULT = ("goal_id", "method", "parity", "transform_initial", "transform", "score_initial", "score", "median", "p90", "within_2", "correspondences")


def registered(pairs: DataFrame, sources: DataFrame, targets: DataFrame, plan: Plan, chirality: DataFrame | None = None, priors: DataFrame | None = None) -> DataFrame:
    """Alignments of all pairs: the best starts of each parity and, where a set has one, the start centred on its prior rotation.

    ``chirality`` (set_id, parity) narrows the parities of a set; ``priors`` (set_id, parity, rotation: nine numbers) adds a start.
    """
    pairs = cut_lineage(pairs.select(*PAIR))
    source, target = (cut_lineage(c) for c in _clouds(_only(sources, pairs, ["set_id", "variant"]), _only(targets, pairs, ["set_id", "target"])))
    asked = pairs.withColumn("parity", F.explode(F.array(*[F.lit(p) for p in plan.parities])))
    if chirality is not None:
        hint = chirality.select("set_id", F.col("parity").alias("_hint"))
        asked = asked.join(hint, "set_id", "left").where(F.col("_hint").isNull() | (F.col("_hint") == F.col("parity"))).drop("_hint")
    names = {"source_id": _goal("set_id", "variant"), "_target": _goal("set_id", "target")}
    asked = cut_lineage(asked.withColumns(names).drop("set_id").withColumnRenamed("_target", "set_id").select("set_id", "source_id", "parity"))
    extra = None
    if priors is not None:
        at = {tag: cloud.groupBy("set_id").agg(*[F.avg(c).alias(f"_{tag}{c}") for c in "xyz"]).withColumnRenamed("set_id", name)
              for tag, cloud, name in (("s", source, "source_id"), ("t", target, "_target"))}
        rows = pairs.join(priors.select("set_id", "parity", "rotation"), "set_id").withColumns(names).join(at["s"], "source_id").join(at["t"], "_target")
        start = M.centred_start([F.col("rotation")[i] for i in range(9)], F.col("parity") < 0, [F.col(f"_s{c}") for c in "xyz"], [F.col(f"_t{c}") for c in "xyz"])
        extra = rows.select(_goal("_target", "source_id", F.lit("prior")).alias("job_id"), F.col("_target").alias("set_id"), "source_id", "parity",
                            F.slice(start, 1, 16).alias("transform"))
    out = register(source, target, plan.parities, plan.refine, extra, plan.schedule, plan.rounds, plan.least, asked)
    back = pairs.withColumns(names)
    out = out.withColumnRenamed("set_id", "_target").join(back, ["_target", "source_id"])
    return out.withColumnRenamed("_target", "goal_id").select(*PAIR, "job_id", *RESULT)


def accepted_first(rows: DataFrame, angle: Column, limit: float) -> DataFrame:
    """Rows within the limit of the prior angle, of sets that have such rows; all rows of the others."""
    marked = rows.withColumn("_ok", (angle <= limit).cast("int"))
    any_ok = marked.groupBy("set_id").agg(F.max("_ok").alias("_any"))
    return marked.join(any_ok, "set_id").where((F.col("_any") == 0) | (F.col("_ok") == 1)).drop("_ok", "_any")


def diverse_first(rows: DataFrame, count: int, choice: str) -> DataFrame:
    """The ``count`` best rows of each set; the diverse choices take the best of each variant (and kind of target) before any other."""
    order = [F.col("score"), F.col("job_id")]
    if choice == "global":
        return top_k(rows, ["set_id"], order, count)
    if choice not in ("source-diverse", "source-target-diverse"):
        raise ValueError(f"unknown choice {choice}")
    family = F.lit("other")
    for name in reversed(FAMILIES):
        family = F.when(F.col("target").contains(name), name).otherwise(family)
    kinds = ["set_id", "variant"] + (["_family"] if choice == "source-target-diverse" else [])
    ranked = positions(rows.withColumn("_family", family), kinds, order, "_p")
    return top_k(ranked, ["set_id"], [F.col("_p") > 1, *order], count).drop("_family", "_p")


def local_jobs(rows: DataFrame, regions: DataFrame, plan: Plan) -> DataFrame:
    """The best rows of each set, once for each of its ``regions`` (set_id, target, point_id, x, y, z); goal_id is new for each."""
    best = top_k(rows, ["set_id"], [F.col("score"), F.col("job_id")], plan.adaptive_top)
    jobs = best.join(regions.select("set_id", F.col("target").alias("region")).distinct(), "set_id")
    return cut_lineage(jobs.withColumns({"goal_id": F.concat_ws("/", "job_id", "region"), "source_id": _goal("set_id", "variant")}))


def local_targets(rows: DataFrame, sources: DataFrame, regions: DataFrame, plan: Plan) -> DataFrame:
    """(set_id, goal_id, point_id, x, y, z): points of a region near the moved source of a row, where there are enough of them."""
    jobs = local_jobs(rows, regions, plan)
    source = sources.join(jobs.select("set_id", "variant", "goal_id", "transform"), ["set_id", "variant"])
    at = M.apply_point("transform", F.col("x"), F.col("y"), F.col("z"))
    moved = cut_lineage(source.select("goal_id", "point_id", *[a.alias(c) for a, c in zip(at, "xyz", strict=True)]))
    around = jobs.select("goal_id", "set_id", "region").join(regions.withColumnRenamed("target", "region"), ["set_id", "region"])
    around = cut_lineage(around.select("set_id", "goal_id", "point_id", "x", "y", "z"))
    local = within_radius(around, moved, ["goal_id"], plan.adaptive_radius)
    enough = local.groupBy("goal_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= plan.adaptive_least)
    return local.join(enough, "goal_id", "left_semi").select("set_id", "goal_id", "point_id", "x", "y", "z")


def adapted(rows: DataFrame, sources: DataFrame, regions: DataFrame, local: DataFrame, plan: Plan) -> DataFrame:
    """Best rows of each set aligned again, each to its local targets, as method "<method>+adaptive" and target "<region>_from_<target>"."""
    jobs = local_jobs(rows, regions, plan).join(local.select("goal_id").distinct(), "goal_id", "left_semi")
    source = cut_lineage(_only(sources, jobs, ["set_id", "variant"]).select(_goal("set_id", "variant").alias("set_id"), "point_id", "x", "y", "z"))
    target = cut_lineage(local.select(F.col("goal_id").alias("set_id"), "point_id", "x", "y", "z"))
    start = jobs.select(F.col("goal_id").alias("job_id"), F.col("goal_id").alias("set_id"), "source_id", "transform")
    refined = trimmed_alignment(start, source, target, plan.adaptive_schedule, plan.rounds, least=plan.least)
    keep = jobs.select("set_id", F.concat_ws("_from_", "region", "target").alias("target"), "variant", "goal_id", F.concat("method", F.lit("+adaptive")).alias("method"),
                       "parity", F.col("transform").alias("transform_initial"), F.col("score").alias("score_initial"))
    out = score_jobs(refined, source, target).drop("set_id", "source_id").withColumn("goal_id", F.col("job_id"))
    return out.join(keep, "goal_id").select(*PAIR, "job_id", *RESULT)


def deepened(rows: DataFrame, sources: DataFrame, goals: DataFrame, plan: Plan) -> DataFrame:
    """The chosen rows after a perturbation search, as method "<method>+basin"; ``goals`` holds the target points by goal_id."""
    chosen = cut_lineage(diverse_first(rows, plan.basin_top, plan.basin_choice))
    source = cut_lineage(_only(sources, chosen, ["set_id", "variant"]).select(_goal("set_id", "variant").alias("set_id"), "point_id", "x", "y", "z"))
    target = cut_lineage(_only(goals, chosen, ["goal_id"]).withColumnRenamed("goal_id", "set_id"))
    jobs = chosen.select("job_id", F.col("goal_id").alias("set_id"), _goal("set_id", "variant").alias("source_id"), "transform")
    found = basin_search(jobs, source, target, plan.basin_samples, plan.basin_stages, plan.basin_refine, plan.basin_schedule, plan.basin_rounds, plan.least, plan.seed)
    final = score_jobs(found.drop("score"), source, target).drop("set_id", "source_id")
    keep = chosen.select("job_id", *PAIR, "goal_id", "method", "parity", F.col("transform").alias("transform_initial"), F.col("score").alias("score_initial"))
    return final.join(keep, "job_id").withColumns({"job_id": F.concat("job_id", F.lit("/basin")), "method": F.concat("method", F.lit("+basin"))}).select(*PAIR, "job_id", *RESULT)


def generate(
    wanted: DataFrame, sources: DataFrame, targets: DataFrame, folder: str, plan: Plan | None = None, ranks: DataFrame | None = None,
    chirality: DataFrame | None = None, priors: DataFrame | None = None, regions: DataFrame | None = None,
) -> Generated:
    """Candidates of all wanted sets, the best of each, and what failed.

    ``wanted`` (set_id), ``sources`` (set_id, variant, point_id, x, y, z), ``targets`` (set_id, target, point_id, x, y, z). Stages: registered, local_targets and adaptive
    (with ``regions``), basin (with ``basin_top``) and rescored, each committed under ``folder`` for the sets it was made for; a later run with the same
    plan only makes what is missing, another plan is refused. All candidates of a set are ranked by two-way score plus a penalty on the angle to
    the set's prior rotation, rows beyond its limit only where a set has no others. A set without points, with points that are not finite or
    without a result is a row of failures (set_id, target, variant, stage, error) and leaves the others alone.
    """
    plan = plan or Plan()
    spark = wanted.sparkSession
    stages = Stages(spark, folder, asdict(plan))
    pairs, bad = job_table(wanted, sources, targets, plan, ranks)
    pairs, bad = cut_lineage(pairs), cut_lineage(bad)
    sets = pairs.select("set_id").distinct()
    none = spark.createDataFrame([], "set_id string, _prior array<double>")
    prior = none if priors is None else priors.select("set_id", F.col("rotation").alias("_prior")).dropDuplicates(["set_id"])

    def angled(rows: DataFrame) -> tuple[DataFrame, Column]:
        met = rows.join(prior, "set_id", "left")
        turn = M.geodesic_deg(M.proper_rotation("transform"), [F.col("_prior")[i] for i in range(9)])
        return met, F.when(F.col("_prior").isNull(), F.lit(0.0)).otherwise(turn)

    def accepted(rows: DataFrame) -> DataFrame:
        met, angle = angled(rows)
        return accepted_first(met, angle, plan.prior_limit).select(*rows.columns)

    def of(missing: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(missing.select("set_id"), "set_id", "left_semi")

    rows = stages.advance("registered", sets, ["set_id"], lambda missing: registered(of(missing, pairs), sources, targets, plan, chirality, priors))
    goals = targets.select(_goal("set_id", "target").alias("goal_id"), "point_id", "x", "y", "z")
    if regions is not None:
        base = rows
        local = stages.advance("local_targets", sets, ["set_id"], lambda missing: local_targets(accepted(of(missing, base)), sources, regions, plan))
        rows = rows.unionByName(stages.advance("adaptive", sets, ["set_id"], lambda missing: adapted(
            accepted(of(missing, base)), sources, regions, of(missing, local), plan)))
        goals = goals.unionByName(local.drop("set_id"))
    if plan.basin_top:
        pool = rows
        rows = rows.unionByName(stages.advance("basin", sets, ["set_id"], lambda missing: deepened(accepted(of(missing, pool)), sources, goals, plan)))

    def judge(missing: DataFrame) -> DataFrame:
        met, angle = angled(of(missing, rows))
        met = met.withColumn("prior_angle_deg", angle).drop("_prior").withColumnsRenamed({"set_id": "case", "goal_id": "set_id"})
        met = cut_lineage(met.withColumns({"source_id": _goal("case", "variant"), "fit_score_mm": F.col("score"), "fit_median_mm": F.col("median"), "fit_p90_mm": F.col("p90")}))
        source = sources.select(_goal("set_id", "variant").alias("set_id"), "point_id", "x", "y", "z")
        target = _only(goals, met.select(F.col("set_id").alias("goal_id")), ["goal_id"]).withColumnRenamed("goal_id", "set_id")
        judged = two_way_rescored(met, source, target, F.col("prior_angle_deg"), plan.prior_penalty, plan.prior_limit)
        return judged.drop("source_id").withColumnsRenamed({"set_id": "goal_id", "case": "set_id"})

    judged = stages.advance("rescored", sets, ["set_id"], judge)
    any_ok = judged.groupBy("set_id").agg(F.max("prior_accepted").alias("_any"))
    pool = judged.join(any_ok, "set_id").where((F.col("_any") == 0) | (F.col("prior_accepted") == 1)).drop("_any")
    candidates = positions(pool, ["set_id"], [F.col("rank_score_mm"), F.col("job_id")], "unsupervised_rank")
    void = F.lit(None).cast("string")
    empty = sets.join(judged.select("set_id").distinct(), "set_id", "left_anti").select(
        "set_id", void.alias("target"), void.alias("variant"), F.lit("registration").alias("stage"), F.lit("no candidate").alias("error"))
    return Generated(candidates, candidates.where(F.col("unsupervised_rank") == 1), bad.unionByName(empty))


# ---- known poses of other surfaces of the same scan ---------------------------------


@dataclass(frozen=True)
class MatchLimits:
    """Gates of a surface match; the defaults are those of the recorded method."""

    teacher_mm: float = 1.5
    score_mm: float = 0.8
    median_mm: float = 1.0
    p90_mm: float = 2.0
    overlap: float = 0.95
    coverage: float = 0.95
    sample: int = 6000
    least: int = 32
    refine: int = 12
    results: int = 4


def content_pairs(queries: DataFrame, entries: DataFrame, teacher_mm: float) -> DataFrame:
    """(query_id, entry_id, match_kind) of the same side and scan: equal raw digests, else equal payload digests; weak teachers are no entries.

    ``queries`` (query_id, jaw, raw_digest, payload_digest), ``entries`` (entry_id, the same, predicted_mm; null: 0). Case is ignored, null digests meet nothing.
    Where ids are unique a pair is met once, by its payload or else by its raw digest, and is not shuffled again.
    """
    strong = entries.where(F.coalesce("predicted_mm", F.lit(0.0)) <= teacher_mm)
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    digests = {f"_{c[0]}": F.lower(c) for c in ("raw_digest", "payload_digest")}
    left = queries.select("query_id", "jaw", *[e.alias(n) for n, e in digests.items()], F.pmod(F.xxhash64("query_id"), F.lit(tasks)).alias("_salt"))
    right = strong.select("entry_id", "jaw", *[e.alias(f"{n}e") for n, e in digests.items()])

    def met(own: str) -> DataFrame:
        # a few digests stand for most pairs, so the queries of a digest are dealt over tasks by number
        keys = ["jaw", "_d", "_salt"]
        asked = left.where(F.col(own).isNotNull()).withColumn("_d", F.col(own)).repartition(tasks, *keys)
        salts = F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))
        known = right.where(F.col(f"{own}e").isNotNull()).withColumn("_d", F.col(f"{own}e")).withColumn("_salt", F.explode(salts))
        return asked.join(known.repartition(tasks, *keys), keys)

    same = {n: F.coalesce(F.col(n) == F.col(f"{n}e"), F.lit(False)) for n in digests}
    both = met("_p").select("query_id", "entry_id", F.when(same["_r"], "raw").otherwise("payload").alias("match_kind")).unionByName(
        met("_r").where(~same["_p"]).select("query_id", "entry_id", F.lit("raw").alias("match_kind")))
    if largest_group(queries, ["query_id"]) <= 1 and largest_group(strong, ["entry_id"]) <= 1:
        return both
    return both.groupBy("query_id", "entry_id").agg(F.max("match_kind").alias("match_kind"))  # "raw" is the larger name


def gated_matches(results: DataFrame, limits: MatchLimits) -> DataFrame:
    """Results (query_id, ..., predicted_mm, score, median, p90, within_2, coverage_2) that pass all gates, the best of each query."""
    passed = results.where(
        (F.col("score") <= limits.score_mm) & (F.col("median") <= limits.median_mm) & (F.col("p90") <= limits.p90_mm)
        & (F.col("within_2") >= limits.overlap) & (F.col("coverage_2") >= limits.coverage))
    order = [F.col("predicted_mm") + F.col("p90"), F.col("score"), F.col("p90"), F.col("predicted_mm"), F.col("entry_id")]
    return first_per_key(passed, ["query_id"], order)


def surface_matches(queries: DataFrame, query_points: DataFrame, entries: DataFrame, entry_points: DataFrame, limits: MatchLimits | None = None,
                    schedule: Sequence[float] = (8.0, 5.0, 3.0, 2.0, 1.25), rounds: int = 8, seed: int = 0) -> DataFrame:
    """Pose of every query surface from the best known surface of the same scan: (query_id, entry_id, match_kind, transform and figures).

    Each gate takes pairs out before the next search: scans and teachers by equi join, surfaces with too few points, one-way figures of
    the aligned pairs, then the two-way score of the best few. Surfaces of one scan differ by a proper rigid motion, so reflections are not tried.
    ``entries`` also hold transform; queries are compared on at most ``sample`` hashed points. Queries without a match have no row.
    """
    limits = limits or MatchLimits()
    pairs = content_pairs(queries, entries, limits.teacher_mm)
    big = usable(entry_points.withColumnRenamed("entry_id", "_k"), ["_k"], limits.least).where("fault IS NULL").select(F.col("_k").alias("entry_id"))
    fit = usable(query_points.withColumnRenamed("query_id", "_k"), ["_k"], 3).where("fault IS NULL").select(F.col("_k").alias("query_id"))
    pairs = cut_lineage(pairs.join(big, "entry_id", "left_semi").join(fit, "query_id", "left_semi"))
    xyz = ["x", "y", "z"]
    source = query_points.join(pairs.select("query_id").distinct(), "query_id", "left_semi").select(F.col("query_id").cast("string").alias("set_id"), "point_id", *xyz)
    source = cut_lineage(hashed_sample(source, ["set_id"], "point_id", limits.sample, seed))
    target = cut_lineage(entry_points.join(pairs.select("entry_id").distinct(), "entry_id", "left_semi").select(F.col("entry_id").cast("string").alias("set_id"), "point_id", *xyz))
    asked = pairs.select(F.col("entry_id").cast("string").alias("set_id"), F.col("query_id").cast("string").alias("source_id"))
    aligned = register(source, target, (1,), limits.refine, None, schedule, rounds, limits.least, asked)
    good = aligned.where((F.col("rank") <= limits.results) & (F.col("median") <= limits.median_mm) & (F.col("p90") <= limits.p90_mm) & (F.col("within_2") >= limits.overlap))
    good = cut_lineage(good.select("job_id", "set_id", "source_id", F.col("transform").alias("moved"), "transform", "median", "p90", "within_2", "correspondences"))
    moved, goal = paired_clouds(good, source, target)
    both = two_way_score(moved, goal, ["job_id"], 0.9, 0.9, 1.0).select("job_id", "score", F.col("coverage_2"))
    rows = good.drop("transform").join(both, "job_id")
    rows = rows.join(pairs.withColumns({"set_id": F.col("entry_id").cast("string"), "source_id": F.col("query_id").cast("string")}), ["set_id", "source_id"])
    known = entries.select("entry_id", F.coalesce("predicted_mm", F.lit(0.0)).alias("predicted_mm"), F.col("transform").alias("_known"))
    rows = rows.join(known, "entry_id").withColumn("transform", M.compose("_known", "moved"))
    return gated_matches(rows.select("query_id", "entry_id", "match_kind", "transform", "predicted_mm", "score", "median", "p90", "within_2", "coverage_2"), limits)
