"""Agreement between poses of one case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import matrix as M
from ..session import cut_lineage
from .grouping import join_null_safe, largest_group
from .spatial import HELD, hashed_sample, held_pairs, near_pairs


def joint_gate(
    chosen: DataFrame, case: str, mode: str = "none", max_angle: float = 8.0, max_shift: float = 10.0,
    matrix: str = "transform",
) -> DataFrame:
    """Upper/lower agreement of the chosen poses, one row per case, with ``kept``.

    ``none`` keeps everything, ``require`` drops incomplete or failing cases,
    ``filter`` drops only complete cases that fail.
    """
    if mode not in ("none", "filter", "require"):
        raise ValueError(f"unknown joint mode {mode}")
    side = {
        j: chosen.where(F.col("jaw") == j).select(case, F.col(matrix).alias(j)) for j in ("upper", "lower")
    }
    both = side["upper"].join(side["lower"], case, "full_outer")
    complete = F.col("upper").isNotNull() & F.col("lower").isNotNull()
    angle, gap = M.joint_difference("upper", "lower")
    far = F.lit(float("inf"))
    out = both.withColumns({
        "complete": complete,
        "joint_angle_deg": F.when(complete, angle).otherwise(far),
        "joint_translation_mm": F.when(complete, gap).otherwise(far),
    })
    passed = F.col("complete") & (F.col("joint_angle_deg") <= max_angle) & (F.col("joint_translation_mm") <= max_shift)
    out = out.withColumn("joint_passed", passed)
    kept = {
        "none": F.lit(True), "require": F.col("joint_passed"),
        "filter": F.col("joint_passed") | ~F.col("complete"),
    }[mode]
    return out.withColumn("kept", kept).drop("upper", "lower")


# ---- distances between poses --------------------------------------------------


def packed_sample(points: DataFrame, sets: Sequence[str], count: int, seed: int = 0) -> DataFrame:
    """A bounded hash sample of each set as one array of (x, y, z), with its centroid."""
    few = hashed_sample(points, sets, "point_id", count, seed)
    return few.groupBy(*sets).agg(
        F.collect_list(F.struct("x", "y", "z")).alias("sample"), *[F.avg(c).alias(f"s{c}") for c in "xyz"])


def mean_gap(a: str, b: str, sample: str = "sample") -> Column:
    """Mean displacement of the sampled points between two poses."""
    def one(p: Column) -> Column:
        at = [p["x"], p["y"], p["z"]]
        return M.norm([u - v for u, v in zip(M.apply_point(a, *at), M.apply_point(b, *at))])

    total = F.aggregate(sample, F.lit(0.0), lambda acc, p: acc + one(p))
    return total / F.size(sample)


def centred(candidates: DataFrame, keys: list[str], same_parity: bool = True, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Poses with their moved centroid cx, cy, cz, and the keys of the sets in which they may pair."""
    rows = candidates.withColumn("_c", M.held(M.apply_point("transform", F.col("sx"), F.col("sy"), F.col("sz"))))
    rows = rows.withColumns({f"c{a}": F.col("_c")[i] for i, a in enumerate("xyz")}).withColumn("sign", M.det_sign("transform"))
    sets = [*keys, "sign"] if same_parity else keys
    return rows.select(*sets, "candidate_index", "cx", "cy", "cz", "transform", "sample", *keep), sets


def pose_pairs(candidates: DataFrame, keys: Sequence[str], radius: float, same_parity: bool = True) -> DataFrame:
    """Pairs of poses of a group whose mean point displacement is within ``radius``.

    The displacement of the centroid never exceeds the mean displacement, so a
    radius search on moved centroids finds every pair; the exact value is then
    taken on the sample. ``candidates`` carries ``sample``, sx, sy, sz. Small groups
    meet as arrays where they lie, larger ones by blocks.
    """
    keys = list(keys)
    slim, sets = centred(candidates, keys, same_parity)
    if largest_group(slim, sets) <= HELD:
        met = held_pairs(slim, sets, ["cx", "cy", "cz"], "candidate_index", ["transform", "sample"]).where(F.col("_sq") <= radius * radius)
        return gap_pairs(met, keys, radius)
    near = near_pairs(
        slim, slim.select(*sets, F.col("candidate_index").alias("other"), "cx", "cy", "cz", "transform"), sets,
        ["cx", "cy", "cz"], radius, "candidate_index", "other", keep_query=["transform", "sample"], keep_target=["transform"])
    out = near.withColumn("gap_mm", mean_gap("transform", "_t_transform"))
    return out.where(F.col("gap_mm") <= radius).select(*keys, "candidate_index", F.col("_t_other").alias("other"), "gap_mm")


def gap_pairs(met: DataFrame, keys: Sequence[str], radius: float, keep: Sequence[Column] = ()) -> DataFrame:
    """Pairs of ``held_pairs`` within ``radius``. The difference of two matrices and the gap are unfolded, so each is found once a pair."""
    d = F.col("_d")
    apart = F.array(*[F.col("q_transform")[i] - F.col("t_transform")[i] for i in range(12)])
    rows = met.select(*keys, "q_id", "t_id", "q_sample", *keep, F.explode(F.array(apart)).alias("_d"))

    def one(p: Column) -> Column:
        return M.norm([d[4 * k] * p["x"] + d[4 * k + 1] * p["y"] + d[4 * k + 2] * p["z"] + d[4 * k + 3] for k in range(3)])

    total = F.aggregate("q_sample", F.lit(0.0), lambda acc, p: acc + one(p))
    rows = rows.select(*keys, F.col("q_id").alias("candidate_index"), F.col("t_id").alias("other"), *[c for c in rows.columns if c not in (*keys, "q_id", "t_id", "q_sample", "_d")], F.explode(F.array(total / F.size("q_sample"))).alias("gap_mm"))
    return rows.where(F.col("gap_mm") <= radius)


CELL = ("view", "family", "threshold_cell", "side")


COUNTS = ("evidence", "views", "families", "thresholds", "sides")
GRAPH = 256  # rows of a group whose pairs are held as one map


def _wide_support(rows: DataFrame, keys: list[str], radius: float, least: dict[str, int]) -> tuple[DataFrame, Sequence[str]]:
    """Sum and largest of the gaps from every supporting row of a centre to the others, with the counts of the centre."""
    gaps = cut_lineage(pose_pairs(rows, keys, 2.0 * radius))  # read three times below
    facts = rows.select(*keys, F.col("candidate_index").alias("other"), *CELL, F.col("selection").alias("_sel"))
    near = gaps.where(F.col("gap_mm") <= radius).withColumnRenamed("candidate_index", "centre").join(facts, [*keys, "other"])
    support = near.groupBy(*keys, "centre", *CELL).agg(
        F.min(F.struct("gap_mm", "other", "_sel")).alias("_m")).select(*keys, "centre", *CELL, "_m.other", "_m._sel")
    counts = support.groupBy(*keys, "centre").agg(
        F.count(F.lit(1)).alias("evidence"), F.count_distinct("view").alias("views"), F.count_distinct("family").alias("families"),
        F.count_distinct(F.when(F.col("threshold_cell") > 0, F.col("threshold_cell"))).alias("thresholds"),
        F.count_distinct("side").alias("sides"))
    for name in ("evidence", "views", "families", "thresholds", "sides"):
        counts = counts.where(F.col(name) >= least.get(name, 0))
    members = support.join(counts.select(*keys, "centre"), [*keys, "centre"], "left_semi").select(*keys, "centre", "other", "_sel")
    # support size is bounded by the number of evidence cells
    inner = members.withColumnRenamed("other", "candidate_index").join(
        members.select(*keys, "centre", "other"), [*keys, "centre"]).join(gaps, [*keys, "candidate_index", "other"])
    per = inner.groupBy(*keys, "centre", "candidate_index").agg(F.sum("gap_mm").alias("_sum"), F.max("gap_mm").alias("_max"), F.first("_sel").alias("_sel"))
    return per.join(counts, [*keys, "centre"]), COUNTS


def _small_support(rows: DataFrame, keys: list[str], radius: float, least: dict[str, int]) -> tuple[DataFrame, Sequence[str]]:
    """As ``_wide_support`` for groups of at most GRAPH rows: all steps aggregate within the group, which lies in one partition."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    slim, sets = centred(rows, keys, keep=[*CELL, "selection"])
    met = held_pairs(slim, sets, ["cx", "cy", "cz"], "candidate_index", ["transform", "sample", *CELL, "selection"]).where(F.col("_sq") <= 4.0 * radius * radius)
    gaps = gap_pairs(met, keys, 2.0 * radius, [F.col(f"t_{c}").alias(c) for c in CELL] + [F.col("t_selection").alias("_sel")]).withColumnRenamed("candidate_index", "centre")
    cells = gaps.groupBy(*keys, "centre", *CELL).agg(
        F.min(F.when(F.col("gap_mm") <= radius, F.struct("gap_mm", "other", "_sel"))).alias("_m"), F.collect_list(F.struct("other", "gap_mm")).alias("_g"))
    member = F.struct(F.col("_m.other").alias("other"), F.col("_m._sel").alias("_sel"), *CELL)
    centres = cells.groupBy(*keys, "centre").agg(
        F.collect_list(F.when(F.col("_m").isNotNull(), member)).alias("members"), F.map_from_entries(F.flatten(F.collect_list("_g"))).alias("_g"))
    graph = centres.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("centre", "_g"))).alias("_graph"), F.collect_list(F.struct("centre", "members")).alias("_c"))
    each = graph.select(*keys, "_graph", F.inline("_c"))

    def different(value) -> Column:
        return F.size(F.array_distinct(F.array_compact(F.transform("members", value)))).cast("long")

    each = each.withColumns({
        "evidence": F.size("members").cast("long"), "views": different(lambda m: m["view"]), "families": different(lambda m: m["family"]),
        "thresholds": different(lambda m: F.when(m["threshold_cell"] > 0, m["threshold_cell"])), "sides": different(lambda m: m["side"])})
    for name in COUNTS:
        each = each.where(F.col(name) >= least.get(name, 0))
    each = each.select(*keys, "_graph", "centre", *COUNTS, F.transform("members", lambda m: m["other"]).alias("_others"), F.inline("members"))
    own = F.array_compact(F.transform("_others", lambda o: F.col("_graph")[F.col("other")][o]))
    each = each.select(*keys, "centre", *COUNTS, F.col("other").alias("candidate_index"), "_sel", F.explode(F.array(own)).alias("_own"))
    return each.select(*keys, "centre", *COUNTS, "candidate_index", "_sel", F.aggregate("_own", F.lit(0.0), lambda a, g: a + g).alias("_sum"),
                       F.array_max("_own").alias("_max")), COUNTS


def evidence_consensus(
    candidates: DataFrame, keys: Sequence[str], radius: float, max_selection: float, least: dict[str, int],
) -> DataFrame:
    """Pose with the most diverse independent support per group.

    Only rows with a selection score within the limit take part. Around every
    centre the closest row of each evidence cell is support; the centre needs the
    minimum counts in ``least`` (evidence, views, families, thresholds, sides).
    The medoid of the support stands for it and the objective ranks centres.
    """
    keys = list(keys)
    rows = candidates.where(F.col("selection") <= max_selection)
    per, counts = (_small_support if largest_group(rows, keys) <= GRAPH else _wide_support)(rows, keys, radius, least)
    medoid = per.groupBy(*keys, "centre", *counts).agg(
        F.min(F.struct(F.round("_sum", 9), "candidate_index", "_sel")).alias("_m"), F.sum("_sum").alias("_all"), F.max("_max").alias("max_disagreement_mm"))
    table = medoid
    pairs = F.col("evidence") * (F.col("evidence") - 1)
    table = table.withColumn("mean_disagreement_mm", F.when(pairs > 0, F.col("_all") / pairs).otherwise(0.0))
    diversity = (4.0 * F.col("views") + 2.0 * F.col("families") + 0.75 * F.col("thresholds") + 0.35 * F.col("sides") + 0.15 * F.col("evidence"))
    table = table.withColumn("objective", diversity - F.col("mean_disagreement_mm") / radius - 0.5 * F.col("_m._sel"))
    fields = F.struct(F.col("_m.candidate_index").alias("candidate_index"), "centre", "evidence", "views", "families", "thresholds",
                      "sides", "mean_disagreement_mm", "max_disagreement_mm", "objective")
    order = F.struct(-F.round("objective", 9), -F.col("views"), -F.col("families"), -F.col("thresholds"), -F.col("evidence"),
                     F.round("mean_disagreement_mm", 9), F.col("_m._sel"), F.col("centre"))
    return table.groupBy(*keys).agg(F.min_by(fields, order).alias("_b")).select(*keys, "_b.*")


def largest_cliques(edges: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """All largest cliques of every group: (keys, members, size, total), members ascending, total the sum of the gaps of their pairs.

    ``edges`` (keys, a, b, gap_mm), a < b, one row a pair; the edges of one group are few, since they join its runs. A row of a round is a clique
    with the vertices that extend it. It grows by those vertices only that the pivot, the one with most neighbours among
    them, has no edge to, so a group in which all agree takes one row a round; rows that cannot reach the largest clique found, or ``least``, leave.
    """
    keys = list(keys)
    both = edges.select(*keys, F.explode(F.expr("array(struct(a AS v, b AS w, gap_mm), struct(b AS v, a AS w, gap_mm))")).alias("_e")).select(*keys, "_e.*")
    lists = both.groupBy(*keys, "v").agg(F.map_from_entries(F.collect_list(F.struct("w", "gap_mm"))).alias("_g"))
    graph = cut_lineage(lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("v", "_g"))).alias("_graph")))
    none = F.array().cast("array<int>")
    state = graph.select(*keys, none.alias("members"), F.array_sort(F.map_keys("_graph")).alias("open"), F.lit(0.0).alias("total"))
    found, first = None, True
    while first or not state.isEmpty():
        rows = join_null_safe(state, graph, keys, "inner")
        rows = rows.withColumn("_pivot", F.expr("-array_max(transform(open, u -> struct(size(array_intersect(open, map_keys(_graph[u]))) AS n, -u AS u))).u"))
        rows = rows.withColumn("_ways", F.expr("array_except(open, map_keys(_graph[_pivot]))")).select("*", F.posexplode("_ways").alias("_i", "_v"))
        grown = rows.select(
            *keys, F.array_sort(F.concat("members", F.array("_v"))).alias("members"),
            F.expr("array_intersect(array_except(open, slice(_ways, 1, _i)), map_keys(_graph[_v]))").alias("open"),
            F.expr("total + aggregate(members, 0D, (s, r) -> s + _graph[_v][r])").alias("total"))
        grown = cut_lineage(grown.where(F.size("members") + F.size("open") >= least))
        done = grown.where(F.size("open") == 0).drop("open")
        found = done if found is None else found.unionByName(done)
        size = found.groupBy(*keys).agg(F.max(F.size("members")).alias("_best"))
        found = cut_lineage(join_null_safe(found, size, keys, "inner").where(F.size("members") == F.col("_best")).drop("_best"))
        state = join_null_safe(grown.where(F.size("open") > 0), size, keys, "left")
        state = cut_lineage(state.where(F.size("members") + F.size("open") >= F.coalesce("_best", F.lit(least))).drop("_best"))
        first = False
    return found.select(*keys, "members", F.size("members").alias("size"), "total")


def consistent_cluster(
    runs: DataFrame, keys: Sequence[str], run: str, names: Sequence[str] | None, limit: float, least: int,
) -> DataFrame:
    """Largest set of runs whose poses agree pairwise within ``limit`` and share parity, of any number of runs.

    One row per (group, run), of the runs in ``names`` (None: all). Of equally large sets the one with the smallest mean gap counts, then the
    first by run names. Groups in which no ``least`` (2 or more) runs agree have no row.
    """
    keys = list(keys)
    rows = runs.where(F.col(run).isNotNull()) if names is None else runs.where(F.col(run).isin(list(names)))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(run)).alias("_names"))  # runs of a group are few
    rows = join_null_safe(rows, listed, keys, "inner").withColumn("_i", F.array_position("_names", F.col(run)).cast("int")).withColumn("sign", M.det_sign("transform"))
    rows = cut_lineage(rows.select(*keys, "_i", "transform", "sign", "sample"))
    a = rows.select(*keys, F.col("_i").alias("a"), F.col("transform").alias("_ta"), F.col("sign").alias("_sa"), "sample")
    b = rows.select(*keys, F.col("_i").alias("b"), F.col("transform").alias("_tb"), F.col("sign").alias("_sb"))
    pairs = a.join(b, keys).where((F.col("a") < F.col("b")) & (F.col("_sa") == F.col("_sb")))
    pairs = cut_lineage(pairs.withColumn("gap_mm", mean_gap("_ta", "_tb")).where(F.col("gap_mm") <= limit).select(*keys, "a", "b", "gap_mm"))
    table = largest_cliques(pairs, keys, max(least, 2)).withColumn("mean_gap_mm", F.col("total") / (F.col("size") * (F.col("size") - 1) / 2.0))
    order = F.struct(F.round("mean_gap_mm", 9), "members")
    best = table.groupBy(*keys).agg(F.min_by(F.struct("members", "size", "mean_gap_mm"), order).alias("_b")).select(*keys, "_b.*")
    chosen = join_null_safe(best, listed, keys, "inner")
    return chosen.select(*keys, "size", "mean_gap_mm", F.array_join(F.transform("members", lambda i: F.get("_names", i - 1)), ",").alias("runs"))


def cross_family_sweep(
    first: DataFrame, second: DataFrame, keys: Sequence[str], centre: Sequence[Column], tops: Sequence[int],
    weights: Sequence[float], radius: float = 20.0,
) -> DataFrame:
    """Best cross-family pair per group for every (top_k, rank weight), from one pair table.

    Inputs hold ``place`` and are already cut to the largest top_k; the pair table
    has at most top_k * top_k rows per group. Pairs are not multiplied by the settings: a group is aggregated once, where its pairs met,
    with one entry a setting.
    """
    keys = list(keys)

    def side(df: DataFrame, tag: str) -> DataFrame:
        pool = F.count(F.lit(1)).over(W.partitionBy(*keys))  # at most top_k rows
        return df.select(
            *keys, F.col("candidate_index").alias(f"{tag}_index"), F.col("place").alias(f"{tag}_place"), pool.alias(f"{tag}_pool"),
            F.col("transform").alias(f"{tag}_transform"), M.det_sign("transform").alias(f"{tag}_sign"))

    pairs = side(first, "a").join(side(second, "b"), keys).where(F.col("a_sign") == F.col("b_sign"))
    pairs = pairs.withColumn("disagreement_mm", M.anchor_disagreement("a_transform", "b_transform", centre, radius))

    def best(top: int, weight: float) -> Column:
        share = [(F.col(f"{t}_place") - 1) / F.greatest(F.least(F.col(f"{t}_pool"), F.lit(top)) - 1, F.lit(1)) for t in "ab"]
        cost = F.round(F.col("disagreement_mm") + weight * (share[0] + share[1]), 9)
        order = F.struct(cost.alias("cost"), F.round("disagreement_mm", 9), "a_place", "b_place")
        keep = F.struct(F.lit(top).alias("top"), F.lit(weight).alias("weight"), "a_index", "b_index", "a_transform", "b_transform", "disagreement_mm", cost.alias("cost"))
        return F.min_by(keep, F.when((F.col("a_place") <= top) & (F.col("b_place") <= top), order))

    table = pairs.groupBy(*keys).agg(F.array(*[best(k, float(w)) for k in tops for w in weights]).alias("_all"))
    return table.select(*keys, F.explode(F.array_compact("_all")).alias("_p")).select(*keys, "_p.*")
