"""Many rigid alignments at once: every round is one search, one ranking and one fit for all jobs.

A job is a row (job_id, set_id, transform): the source points of the set are
moved by the matrix towards the target points of the same set. With a column ``source_id`` the source is
that set of the source points instead, so several sources meet one target. One-way searches of
the jobs of a set share its target, indexed once; two-way scores hold a target per job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions.keys import hash_normal
from ..session import cut_lineage
from .grouping import largest_group, positions, top_k
from .moved_clouds import Blocks, meet, source_blocks, target_blocks
from .poses import interpolate_poses
from .selection import first_per_key
from .spatial import fit_score, hashed_sample, keep_rows, nearest, principal_axes, rigid_fit, support_metrics, two_way_score

ROUND = 9  # scores are compared at nine decimals so that equal poses stay equal


def moved_sources(jobs: DataFrame, source: DataFrame) -> DataFrame:
    link = F.col("source_id" if "source_id" in jobs.columns else "set_id").alias("_source")
    points = source.select(F.col("set_id").alias("_source"), "point_id", "x", "y", "z")
    both = jobs.select("job_id", "set_id", "transform", link).join(points, "_source").drop("_source")
    at = M.apply_point("transform", F.col("x"), F.col("y"), F.col("z"))
    return both.select("job_id", "set_id", "point_id", *[a.alias(c) for a, c in zip(at, "xyz")])


def paired_clouds(jobs: DataFrame, source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moved source points and target points per job, written once: searches read them several times."""
    moved = moved_sources(jobs, source).select("job_id", "point_id", "x", "y", "z")
    goal = jobs.select("job_id", "set_id").join(target, "set_id").select("job_id", "point_id", "x", "y", "z")
    return cut_lineage(moved), cut_lineage(goal)


def score_jobs(jobs: DataFrame, source: DataFrame | Blocks, target: DataFrame | Blocks, trim: float = 0.7) -> DataFrame:
    """One-way fit score of every job (score, median, p90, share within 2)."""
    jobs, source = cut_lineage(jobs), source_blocks(source)
    rows = cut_lineage(meet(jobs, source, target_blocks(target)).select("job_id", "point_id", "distance"))
    out = fit_score(rows, ["job_id"], ["point_id"], [("score", trim)], bounded=source.bounded)
    return jobs.join(out.withColumn("score", F.round("score", ROUND)), "job_id")


def axes_starts(source: DataFrame, target: DataFrame, parities: Sequence[int] = (1,), pairs: DataFrame | None = None) -> DataFrame:
    """24 starts per set and parity: principal axes of the source on signed permutations of the target's.

    ``pairs`` (set_id of the target, source_id, and parity where only some are wanted for a pair) names who meets whom; without it equal sets meet.
    """
    perms = M.signed_permutations()
    parts, ident = [], ["set_id"] if pairs is None else ["set_id", "source_id"]
    for parity in parities:
        flipped = source.withColumn("x", F.col("x") * float(parity))
        s = principal_axes(flipped, ["set_id"]).select("set_id", *[F.col(f"c{c}").alias(f"s{c}") for c in "xyz"], F.col("axes").alias("_s"))
        t = principal_axes(target, ["set_id"]).select("set_id", *[F.col(f"c{c}").alias(f"t{c}") for c in "xyz"], F.col("axes").alias("_t"))
        grid = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.array(*[F.lit(float(v)) for v in p]).alias("p")) for i, p in enumerate(perms)]))
        if pairs is None:
            met = s.join(t, "set_id")
        else:
            asked = pairs.where(F.col("parity") == parity).drop("parity") if "parity" in pairs.columns else pairs
            met = s.withColumnRenamed("set_id", "source_id").join(asked.select("set_id", "source_id"), "source_id").join(t, "set_id")
        rows = met.withColumn("_g", grid)
        p9 = [F.col("_g.p")[i] for i in range(9)]
        first = M.multiply3(M.transpose3([F.col("_t")[i] for i in range(9)]), p9)
        rows = rows.withColumn("_m", M.held(first))
        rot = M.multiply3([F.col("_m")[i] for i in range(9)], [F.col("_s")[i] for i in range(9)])
        rows = rows.withColumn("_r", M.held(rot))
        r = [F.col("_r")[i] for i in range(9)]
        shift = [F.col(f"t{c}") - (r[3 * k] * F.col("sx") + r[3 * k + 1] * F.col("sy") + r[3 * k + 2] * F.col("sz")) for k, c in enumerate("xyz")]
        entries = [e * float(parity) if i % 3 == 0 else e for i, e in enumerate(r)]
        parts.append(rows.select(
            F.concat_ws("/", *ident, F.lit(str(parity)), F.col("_g.n")).alias("job_id"), *ident, F.lit(parity).alias("parity"),
            F.slice(M.from_parts(entries, shift), 1, 16).alias("transform")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def trimmed_alignment(
    jobs: DataFrame, source: DataFrame | Blocks, target: DataFrame | Blocks, schedule: Sequence[float] = (8.0, 5.0, 3.0, 2.0, 1.25),
    rounds: int = 8, trim: float = 0.7, least: int = 32, still: float = 1e-5,
) -> DataFrame:
    """Trimmed iterative alignment of all jobs; adds ``correspondences``.

    At each distance level a job stops early with fewer than ``least`` neighbours
    or when its matrix hardly moves; stopped jobs leave the search by a filter.
    """
    source, target = source_blocks(source), target_blocks(target)
    state = cut_lineage(jobs.withColumn("correspondences", F.lit(0).cast("long")).withColumn("_on", F.lit(True)))
    for level in schedule:
        state = state.withColumn("_on", F.lit(True))
        for _ in range(rounds):
            active = state.where("_on")
            valid = meet(active, source, target).where(F.col("distance") <= level)
            if not source.bounded:
                valid = cut_lineage(valid)  # hot groups are counted and cut into ordered parts
            ranked = positions(valid, ["job_id"], [F.round("distance", 12), F.col("point_id")], "_p", "_n", bounded=source.bounded)
            kept = ranked.where((F.col("_n") >= least) & (F.col("_p") <= keep_rows(F.col("_n"), trim, least, "floor")))
            fits = rigid_fit(kept, ["job_id"], ["x", "y", "z"], ["u", "v", "w"], "_delta")
            delta = [F.col("_delta")[i] for i in range(16)]
            motion = M.norm([delta[i] for i in (3, 7, 11)]) + M.norm([delta[i] - (1.0 if i in (0, 5, 10) else 0.0) for i in M.LINEAR])
            nxt = state.join(fits.withColumnRenamed("pairs", "_c"), "job_id", "left")
            hit = F.col("_delta").isNotNull()
            state = cut_lineage(nxt.select(
                *[c for c in state.columns if c not in ("transform", "correspondences", "_on")],
                F.when(hit, M.compose("_delta", "transform")).otherwise(F.col("transform")).alias("transform"),
                F.coalesce("_c", "correspondences").alias("correspondences"),
                (F.col("_on") & hit & (motion >= still)).alias("_on")))
            if state.where("_on").isEmpty():
                break
    return state.drop("_on")


def perturbed(jobs: DataFrame, centre: DataFrame, samples: int, turn_deg: float, shift: float, stage: int, seed: int = 0) -> DataFrame:
    """The job itself and ``samples`` small random moves of it about its moved centre."""
    ident = [c for c in ("set_id", "source_id") if c in jobs.columns]
    grid = jobs.join(centre.withColumnRenamed("set_id", ident[-1]), ident[-1]).withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(samples))))
    text = F.concat_ws("|", F.lit(f"{seed}/{stage}"), "job_id", "_n")

    def draw(tag: str, scale: float) -> Column:
        return F.when(F.col("_n") == 0, 0.0).otherwise(hash_normal(F.concat(text, F.lit(f"|{tag}"))) * scale)

    turn = turn_deg * 3.141592653589793 / 180.0
    grid = grid.withColumns({**{f"_w{c}": draw(f"w{c}", turn) for c in "xyz"}, **{f"_t{c}": draw(f"t{c}", shift) for c in "xyz"}})
    grid = grid.withColumn("_a", M.norm([F.col(f"_w{c}") for c in "xyz"]))
    axis = [F.when(F.col("_a") > 0, F.col(f"_w{c}") / F.col("_a")).otherwise(1.0 if c == "x" else 0.0) for c in "xyz"]
    grid = grid.withColumns({f"_u{c}": a for c, a in zip("xyz", axis)})
    grid = grid.withColumn("_r", M.held(M.axis_angle_matrix([F.col(f"_u{c}") for c in "xyz"], F.col("_a"))))
    grid = grid.withColumn("_c", M.held(M.apply_point("transform", F.col("sx"), F.col("sy"), F.col("sz"))))
    r, c = [F.col("_r")[i] for i in range(9)], [F.col("_c")[i] for i in range(3)]
    off = [c[k] - (r[3 * k] * c[0] + r[3 * k + 1] * c[1] + r[3 * k + 2] * c[2]) + F.col(f"_t{a}") for k, a in enumerate("xyz")]
    delta = grid.withColumn("_delta", F.slice(M.from_parts(r, off), 1, 16))
    return delta.select(F.concat_ws("#", "job_id", "_n").alias("job_id"), F.col("job_id").alias("start_id"), *ident,
                        M.compose("_delta", "transform").alias("transform"))


def basin_search(
    jobs: DataFrame, source: DataFrame, target: DataFrame, samples: int = 384,
    stages: Sequence[tuple[float, float]] = ((12.0, 8.0), (6.0, 4.0), (3.0, 2.0)), refine: int = 8,
    schedule: Sequence[float] = (4.0, 2.0, 1.25), rounds: int = 5, least: int = 32, seed: int = 0,
) -> DataFrame:
    """Leave a local optimum: perturb, score, refine the best few, keep the best, stage by stage."""
    ident = [c for c in ("set_id", "source_id") if c in jobs.columns]
    centre = source.groupBy("set_id").agg(*[F.avg(c).alias(f"s{c}") for c in "xyz"])
    state = jobs.select("job_id", *ident, "transform")
    source, index = source_blocks(source), target_blocks(target)
    for stage, (turn, shift) in enumerate(stages):
        pool = cut_lineage(perturbed(state, centre, samples, turn, shift, stage, seed))
        scored = score_jobs(pool, source, index)
        best = cut_lineage(top_k(scored, ["start_id"], [F.col("score"), F.col("job_id")], refine).select("job_id", "start_id", *ident, "transform"))
        refined = trimmed_alignment(best, source, index, schedule, rounds, least=least)
        final = score_jobs(refined, source, index)
        chosen = first_per_key(final.select("start_id", *ident, "transform", "score", "correspondences", "job_id"), ["start_id"], [F.col("score"), F.col("job_id")])
        state = cut_lineage(chosen.select(F.col("start_id").alias("job_id"), *ident, "transform", "score", "correspondences"))
    return state


def best_starts(starts: DataFrame, source: DataFrame, index: Blocks, groups: Sequence[str], keep: int, samples: Sequence[int] = (96, 384)) -> DataFrame:
    """The ``keep`` best starts of each group by fit score, found by halving.

    Starts are scored on growing hash samples of their source; the better half of a group, never fewer than twice ``keep``, goes on to the
    next sample, and what is left is scored on all points. A sample as large as the source costs no extra round. ``samples=()`` scores all at once.
    """
    groups = list(groups)
    now = cut_lineage(starts)
    largest = largest_group(source, ["set_id"])
    order = [F.col("score"), F.col("job_id")]
    for size in samples:
        if size >= largest:
            break
        scored = score_jobs(now, cut_lineage(hashed_sample(source, ["set_id"], "point_id", size)), index)
        ranked = positions(scored, groups, order, "_p", "_n")
        half = F.greatest(F.ceil(F.col("_n") / 2), F.lit(2 * keep))
        now = cut_lineage(ranked.where(F.col("_p") <= half).select(*starts.columns))
    return cut_lineage(top_k(score_jobs(now, source, index), groups, order, keep))


def register(
    source: DataFrame, target: DataFrame, parities: Sequence[int] = (1, -1), refine: int = 4, extra: DataFrame | None = None,
    schedule: Sequence[float] = (8.0, 5.0, 3.0, 2.0, 1.25), rounds: int = 8, least: int = 32, pairs: DataFrame | None = None,
    samples: Sequence[int] = (96, 384), coarse: int = 1024,
) -> DataFrame:
    """Ranked alignments of every set (or of every pair of ``pairs``): best starts per parity and given extra starts, refined and rescored.

    One target index serves all searches. Starts are halved on growing samples; all levels but the last two are aligned on at most ``coarse``
    hashed points of a source, which only bring a pose into reach of the last two levels on all points (0: all levels on all points).
    Rows of ``extra`` (job_id, set_id, parity, transform, and source_id with ``pairs``) are refined without a choice, as method "prior".
    """
    index = target_blocks(target)
    ident = ["set_id"] if pairs is None else ["set_id", "source_id"]
    starts = axes_starts(source, target, parities, pairs)
    best = best_starts(starts, source, index, [*ident, "parity"], refine, samples).select(
        "job_id", *ident, "parity", "transform", F.lit("pca").alias("method"), F.col("score").alias("score_initial"))
    if extra is not None:
        given = score_jobs(extra, source, index).select(
            "job_id", *ident, "parity", "transform", F.lit("prior").alias("method"), F.col("score").alias("score_initial"))
        best = best.unionByName(given)
    now = cut_lineage(best.withColumn("transform_initial", F.col("transform")))
    if coarse and len(schedule) > 2:
        few = cut_lineage(hashed_sample(source, ["set_id"], "point_id", coarse))
        now = trimmed_alignment(now, few, index, schedule[:-2], rounds, least=least).drop("correspondences")
        schedule = schedule[-2:]
    held = source_blocks(source)
    refined = trimmed_alignment(now, held, index, schedule, rounds, least=least)
    final = cut_lineage(score_jobs(refined, held, index))
    return positions(final, ident, [F.col("score"), F.col("job_id")], "rank")


def two_way_rescored(jobs: DataFrame, source: DataFrame, target: DataFrame, prior_angle: Column, penalty: float = 0.002, limit: float = 90.0) -> DataFrame:
    """Two-way score, penalty on the prior angle and acceptance of every job."""
    jobs = cut_lineage(jobs)
    moved, goal = paired_clouds(jobs, source, target)
    both = cut_lineage(two_way_score(moved, goal, ["job_id"]))
    out = jobs.drop("score", "median", "p90").join(both, "job_id").withColumn("prior_angle_deg", prior_angle)
    return out.withColumns({
        "selection_score_mm": F.round(F.col("score"), ROUND), "prior_accepted": (F.col("prior_angle_deg") <= limit).cast("int"),
        "rank_score_mm": F.round(F.col("score") + penalty * F.col("prior_angle_deg"), ROUND)})


def rescored(jobs: DataFrame, source: DataFrame, target: DataFrame, prior_angle: Column, penalty: float = 0.002, limit: float = 90.0) -> DataFrame:
    """As ``two_way_rescored``, with the rank among accepted rows of a set."""
    from .selection import accepted_rank

    out = two_way_rescored(jobs, source, target, prior_angle, penalty, limit).withColumn("candidate_index", F.col("job_id"))
    return accepted_rank(out, ["set_id"], "rank_score_mm", "prior_accepted", "unsupervised_rank").drop("candidate_index")


def failures(wanted: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys without any result."""
    return wanted.select(*keys).distinct().join(results.select(*keys).distinct(), list(keys), "left_anti").withColumn("reason", F.lit("no_result"))


def support_refinement(
    jobs: DataFrame, source: DataFrame, target: DataFrame,
    profiles: Sequence[tuple[str, Sequence[float], float]] = (("tight", (3.0, 2.0, 1.25), 0.35), ("wide", (5.0, 3.0, 2.0, 1.25), 0.5)),
    rounds: int = 5, max_motion: float = 8.0, max_angle: float = 15.0, alphas: Sequence[float] = (0.25, 0.5, 0.75, 1.0),
    gain: float = 0.005, least: int = 32,
) -> DataFrame:
    """Refine poses against a support, limit the change, try partial moves, keep those that help.

    Result: one row per improved (job, profile) with the best share ``alpha`` of the move.
    """
    def symmetric(poses: DataFrame) -> DataFrame:
        moved, goal = paired_clouds(poses, source, target)
        return support_metrics(moved, goal, ["job_id"]).select("job_id", F.col("symmetric_trim20").alias("trim20"))

    start = cut_lineage(jobs.select("job_id", "set_id", "transform"))
    first = cut_lineage(symmetric(start)).withColumnRenamed("trim20", "initial_trim20")
    centre = source.groupBy("set_id").agg(*[F.avg(c).alias(f"s{c}") for c in "xyz"])
    parts, held, index = [], source_blocks(source), target_blocks(target)
    for name, schedule, trim in profiles:
        moved = trimmed_alignment(start, held, index, schedule, rounds, trim, least).select("job_id", F.col("transform").alias("refined"))
        parts.append(start.join(moved, "job_id").withColumn("profile", F.lit(name)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    both = both.join(centre, "set_id")
    at = [F.col(f"s{c}") for c in "xyz"]
    before, after = M.apply_point("transform", *at), M.apply_point("refined", *at)
    both = both.withColumn("center_motion_mm", M.norm([a - b for a, b in zip(after, before)])).withColumn(
        "angle_deg", M.geodesic_deg(M.proper_rotation("transform"), M.proper_rotation("refined")))
    both = both.where((F.col("center_motion_mm") <= max_motion) & (F.col("angle_deg") <= max_angle))
    tries = interpolate_poses(both, "transform", "refined", at, alphas, "pose")
    tries = cut_lineage(tries.select(F.col("job_id").alias("start_id"), "set_id", "profile", "alpha", "center_motion_mm", "angle_deg",
                                     F.concat_ws("#", "job_id", "profile", "alpha").alias("job_id"), F.col("pose").alias("transform")))
    table = tries.join(symmetric(tries), "job_id").join(first.withColumnRenamed("job_id", "start_id"), "start_id")
    table = table.withColumn("improvement_mm", F.col("initial_trim20") - F.col("trim20")).where(F.col("improvement_mm") > gain)
    rest = [c for c in table.columns if c not in ("start_id", "profile")]
    return first_per_key(table.select("start_id", "profile", *rest), ["start_id", "profile"], [F.round("trim20", ROUND), F.col("alpha")])


def full_geometry(jobs: DataFrame, source: DataFrame, target: DataFrame, normal_radius: float | None = None) -> DataFrame:
    """Trimmed means at 10, 20 and 35%, median, p90, overlaps, coverage and (optionally) normal agreement."""
    from .spatial import normal_agreement, point_normals

    moved, goal = paired_clouds(jobs, source, target)
    near = cut_lineage(nearest(moved, goal, ["job_id"]))
    trims = [("full_trim_10", 0.10), ("full_trim_20", 0.20), ("full_trim_35", 0.35)]
    out = fit_score(near, ["job_id"], ["point_id"], trims, within=(1.0, 2.0, 3.0), sized_by=moved)
    back = nearest(goal, moved, ["job_id"]).groupBy("job_id").agg(F.avg((F.col("distance") <= 2.0).cast("double")).alias("full_target_coverage_2mm"))
    out = out.join(back, "job_id")
    if normal_radius:
        out = out.join(normal_agreement(near, point_normals(moved, ["job_id"], normal_radius), point_normals(goal, ["job_id"], normal_radius), ["job_id"]), "job_id", "left")
    return jobs.join(out, "job_id")
