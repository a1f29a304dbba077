"""Sparse voxel rows: thresholds, components, boundaries, resampling, class maps.

A volume is a table (keys, i, j, k, ...) that keeps only voxels of interest.
Neighbourhoods are equi joins on shifted indices, so the work is spread by
voxel and never by volume.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..session import cut_lineage
from .grouping import join_null_safe, positions, top_k
from .selection import first_per_key

IJK = ("i", "j", "k")


def offsets(connectivity: int, forward: bool = False) -> list[tuple[int, int, int]]:
    """Neighbour shifts of the 6- or 26-neighbourhood; ``forward`` keeps one of each opposite pair."""
    if connectivity not in (6, 26):
        raise ValueError("connectivity must be 6 or 26")
    span = (-1, 0, 1)
    out = [(a, b, c) for a in span for b in span for c in span if (a, b, c) != (0, 0, 0)]
    if connectivity == 6:
        out = [o for o in out if sum(map(abs, o)) == 1]
    return [o for o in out if o > (0, 0, 0)] if forward else out


def shifts(rows: Sequence[tuple[int, int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for v, c in zip(o, IJK)]) for o in rows]))


def threshold_masks(voxels: DataFrame, thresholds: Sequence[float], value: str = "hu") -> DataFrame:
    """One mask per threshold from a single scan; the lowest one is pushed to the source."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    kept = voxels.where(F.col(value) >= min(thresholds)).withColumn("threshold", grid)
    return kept.where(F.col(value) >= F.col("threshold"))


def connected_components(mask: DataFrame, keys: Sequence[str], connectivity: int = 26) -> DataFrame:
    """Label every voxel with the smallest voxel number of its component.

    Edges come from joins on forward shifts. Labels shrink by alternating the
    minimum over neighbours with pointer jumping, so a component of any length
    needs a logarithmic number of rounds. Each round is written to the shared
    checkpoint folder, which keeps the plan short and survives lost executors.
    """
    keys = list(keys)
    nodes = positions(mask.select(*keys, *IJK).distinct(), [], [F.col(c) for c in (*keys, *IJK)], "node")
    nodes = cut_lineage(nodes)
    shifted = nodes.withColumn("_o", shifts(offsets(connectivity, forward=True))).select(
        *keys, F.col("node").alias("a"), *[(F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in IJK])
    half = shifted.join(nodes.withColumnRenamed("node", "b"), [*keys, *IJK]).select("a", "b")
    edges = cut_lineage(half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:
        # smallest label among the neighbours, then hook the root of the own label on it
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        seen = labels.join(around, "node", "left").withColumn("_near", F.least("label", F.coalesce("_near", "label")))
        hooks = seen.groupBy("label").agg(F.min("_near").alias("_root"))
        moved = seen.join(hooks, "label").select("node", F.col("_root").alias("_new"), "label")
        # jump: follow the label of the label
        table = moved.select(F.col("node").alias("_new"), F.col("_new").alias("_jump"))
        moved = moved.join(table, "_new").select("node", F.col("_jump").alias("label"), F.col("label").alias("_old"))
        moved = cut_lineage(moved)
        changed = not moved.where(F.col("label") != F.col("_old")).isEmpty()
        labels = moved.select("node", "label")
        if not changed:
            break
    return nodes.join(labels, "node").select(*keys, *IJK, "label")


def component_sizes(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("voxels"))


def large_components(
    mask: DataFrame, keys: Sequence[str], minimum: int, maximum: int | None = None, connectivity: int = 6
) -> DataFrame:
    """Voxels of components with at least ``minimum`` voxels, the ``maximum`` largest per group."""
    labelled = connected_components(mask, keys, connectivity)
    sizes = component_sizes(labelled, keys).where(F.col("voxels") >= minimum)
    if maximum:
        sizes = top_k(sizes, keys, [-F.col("voxels"), F.col("label")], maximum)
    return labelled.join(sizes.select(*keys, "label"), [*keys, "label"], "left_semi")


def boundary(mask: DataFrame, keys: Sequence[str], connectivity: int = 26) -> DataFrame:
    """Voxels with at least one neighbour outside the mask (outside the volume counts as outside)."""
    keys = list(keys)
    around = offsets(connectivity)
    pushed = mask.select(*keys, *IJK).withColumn("_o", shifts(around)).select(
        *keys, *[(F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in IJK])
    full = pushed.groupBy(*keys, *IJK).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(around))
    return mask.join(full, [*keys, *IJK], "left_anti")


def to_world(rows: DataFrame, affine: Sequence[float] | Column) -> DataFrame:
    """World coordinates x, y, z of voxel indices."""
    m = affine if isinstance(affine, Column) else F.array(*[F.lit(float(v)) for v in affine])
    at = M.apply_point(m, *[F.col(c).cast("double") for c in IJK])
    return rows.withColumns(dict(zip("xyz", at)))


def component_stats(labelled: DataFrame, keys: Sequence[str], affine: Sequence[float]) -> DataFrame:
    """Voxel count, index box, world extent and centre of every component."""
    stats = labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("voxels"),
        *[F.min(c).alias(f"lo_{c}") for c in IJK], *[F.max(c).alias(f"hi_{c}") for c in IJK])
    rows = [affine[0:4], affine[4:8], affine[8:12]]
    extra = {}
    for axis, row in zip("xyz", rows):
        ends = [(F.col(f"lo_{c}") * float(a), F.col(f"hi_{c}") * float(a)) for a, c in zip(row, IJK)]
        low = sum((F.least(*e) for e in ends), F.lit(float(row[3])))
        high = sum((F.greatest(*e) for e in ends), F.lit(float(row[3])))
        extra[f"extent_{axis}"], extra[f"centre_{axis}"] = high - low, (low + high) / 2.0
    return stats.withColumns(extra)


def shape_cost(extent: Sequence[Column], expected: Sequence[float]) -> Column:
    """Mean |ln(sorted extent / sorted expected extent)|."""
    ordered = F.sort_array(F.array(*[F.greatest(e, F.lit(0.5)) for e in extent]))
    want = sorted(max(float(v), 1.0) for v in expected)
    return sum((F.abs(F.log(F.get(ordered, F.lit(i)) / v)) for i, v in enumerate(want)), F.lit(0.0)) / 3.0


def arch_score(stats: DataFrame, source_extent: Sequence[float], voxel_mm3: float, least_mm3: float = 80.0) -> DataFrame:
    """Score of components as jaw-shaped objects; small or short ones are dropped."""
    extent = [F.greatest(F.col(f"extent_{a}"), F.lit(0.5)) for a in "xyz"]
    kept = stats.where((F.col("voxels") * voxel_mm3 >= least_mm3) & (F.greatest(*extent) >= 0.4 * max(source_extent)))
    return kept.withColumn("score", shape_cost(extent, source_extent) - 0.03 * F.log1p("voxels"))


def anchor_pair(scored: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Two best components at the first threshold (in the given order) that has two.

    ``scored`` holds components of all trial thresholds. The one with the higher
    centre is the upper jaw.
    """
    keys = list(keys)
    trial = None
    for place, t in enumerate(thresholds):
        trial = F.when(F.col("threshold") == t, place) if trial is None else trial.when(F.col("threshold") == t, place)
    best = top_k(scored.withColumn("trial", trial), [*keys, "trial"], [F.col("score"), F.col("label")], 2, pos="place")
    ready = best.groupBy(*keys, "trial").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    first = ready.groupBy(*keys).agg(F.min("trial").alias("trial"))
    pair = best.join(first, [*keys, "trial"])
    order = F.struct(-F.col("centre_z"), F.col("place"))
    upper = pair.groupBy(*keys).agg(F.min_by("label", order).alias("_upper"))
    return pair.join(upper, keys).withColumn("jaw", F.when(F.col("label") == F.col("_upper"), "upper").otherwise("lower")).drop("_upper", "trial")


def largest_overlap(labelled: DataFrame, anchor: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group the label that shares most voxels with the anchor voxels."""
    keys = list(keys)
    hits = labelled.join(anchor.select(*keys, *IJK).distinct(), [*keys, *IJK]).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("overlap"))
    return first_per_key(hits, keys, [-F.col("overlap"), F.col("label")])


def crop_score(stats: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Score of components as parts of the tooth region: extent, size and place in the volume."""
    extent = [F.greatest(F.col(f"extent_{a}"), F.lit(0.5)) for a in "xyz"]
    centre = [(F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2.0 / max(n - 1, 1) for c, n in zip(IJK, shape)]
    place = (F.abs(centre[0] - 0.5) + 6.0 * F.greatest(centre[2] - 0.72, F.lit(0.0))
             + 2.0 * F.greatest(0.08 - centre[2], F.lit(0.0)))
    return stats.withColumn("score", shape_cost(extent, (25.0, 48.0, 72.0)) - 0.04 * F.log1p("voxels") + place)


def region_crop(
    scored: DataFrame, keys: Sequence[str], shape: Sequence[int], spacing: Sequence[float], margin_mm: float = 8.0,
    best: int = 8, cap_mm: Sequence[float] = (105.0, 95.0, 90.0),
) -> DataFrame:
    """Index bounds of the region around the best compatible pair of components.

    At most ``best`` components per group are compared (a top list of the method
    itself). Without a compatible pair the best single component is used, and
    the bounds are capped in millimetres and kept inside the volume.
    """
    keys = list(keys)
    tops = top_k(scored, keys, [F.col("score"), F.col("label")], best, pos="place")
    fields = [*[f"lo_{c}" for c in IJK], *[f"hi_{c}" for c in IJK], "score", "place"]
    a = tops.select(*keys, *[F.col(f).alias(f"a_{f}") for f in fields])
    b = tops.select(*keys, *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, keys)
    both = both.where(F.col("a_place") <= F.col("b_place"))
    gap = [F.abs((F.col(f"a_lo_{c}") + F.col(f"a_hi_{c}")) - (F.col(f"b_lo_{c}") + F.col(f"b_hi_{c}"))) / 2.0 * s for c, s in zip(IJK, spacing)]
    low = {c: F.least(f"a_lo_{c}", f"b_lo_{c}") for c in IJK}
    high = {c: F.greatest(f"a_hi_{c}", f"b_hi_{c}") for c in IJK}
    union = [(high[c] - low[c] + 1) * s for c, s in zip(IJK, spacing)]
    fits = (M.norm(gap) <= 75.0) & (M.norm(gap[:2]) <= 55.0) & (gap[2] <= 55.0)
    for size, limit in zip(union, (115.0, 105.0, 110.0)):
        fits = fits & (size <= limit)
    single = F.col("a_place") == F.col("b_place")
    both = both.withColumn("pair", ~single & fits).where(F.col("pair") | single)
    both = both.withColumn("cost", F.when(single, F.col("a_score")).otherwise(F.col("a_score") + F.col("b_score")))
    box = F.struct(*[low[c].alias(f"lo_{c}") for c in IJK], *[high[c].alias(f"hi_{c}") for c in IJK], F.col("pair"), F.col("cost"))
    order = F.struct(~F.col("pair"), F.col("cost"), F.col("a_place"), F.col("b_place"))
    out = both.groupBy(*keys).agg(F.min_by(box, order).alias("_b")).select(*keys, "_b.*")
    bounds = {}
    for c, n, s, cap in zip(IJK, shape, spacing, cap_mm):
        pad = int(-(-margin_mm // s))
        start = F.greatest(F.col(f"lo_{c}") - pad, F.lit(0))
        stop = F.least(F.col(f"hi_{c}") + pad + 1, F.lit(int(n)))
        size = F.least(stop - start, F.lit(max(1, int(cap // s))))
        capped = F.floor((start + stop) / 2.0 - size / 2.0)
        capped = F.least(F.greatest(capped, F.lit(0)), F.lit(int(n)) - size)
        bounds[f"start_{c}"], bounds[f"stop_{c}"] = capped.cast("int"), (capped + size).cast("int")
    return out.withColumns(bounds).select(*keys, "pair", "cost", *bounds)


def inside_bounds(voxels: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = voxels.join(bounds, list(keys))
    keep = F.lit(True)
    for c in IJK:
        keep = keep & (F.col(c) >= F.col(f"start_{c}")) & (F.col(c) < F.col(f"stop_{c}"))
    return joined.where(keep).select(*voxels.columns)


# ---- class probabilities --------------------------------------------------------


def winning_class(voxels: DataFrame, p1: str = "p1", p2: str = "p2") -> DataFrame:
    """Background, class 1 or class 2 by the largest probability (lowest class on ties)."""
    p0 = 1.0 - F.col(p1) - F.col(p2)
    winner = F.when((p0 >= F.col(p1)) & (p0 >= F.col(p2)), 0).when(F.col(p1) >= F.col(p2), 1).otherwise(2)
    return voxels.withColumn("label", winner).withColumn("p", F.greatest(p0, F.col(p1), F.col(p2)))


def class_masks(
    voxels: DataFrame, keys: Sequence[str], thresholds: dict[int, float], minimum_voxels: int, maximum: int | None,
    minimum_hu: float | None = None, connectivity: int = 6,
) -> DataFrame:
    """Class voxels over the class threshold (and intensity), without small components."""
    won = winning_class(voxels).where(F.col("label") > 0)
    limit = F.create_map(*[F.lit(v) for kv in thresholds.items() for v in kv])[F.col("label")]
    kept = won.where(F.col("p") >= limit)
    if minimum_hu is not None:
        kept = kept.where(F.col("hu") >= minimum_hu)
    kept = kept.withColumnRenamed("label", "class")
    big = large_components(kept, [*keys, "class"], minimum_voxels, maximum, connectivity)
    return kept.join(big.select(*keys, "class", *IJK), [*keys, "class", *IJK], "left_semi")


def top_voxels(voxels: DataFrame, keys: Sequence[str], counts: Sequence[int]) -> DataFrame:
    """The n most probable winners of each class, for several n."""
    won = winning_class(voxels).where(F.col("label") > 0)
    order = [-F.col("p"), *[F.col(c) for c in IJK]]
    best = top_k(won, [*keys, "label"], order, max(counts), pos="place")
    grid = F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(counts))]))
    return best.withColumn("requested", grid).where(F.col("place") <= F.col("requested"))


def support_rank(count: Column) -> Column:
    return F.abs(F.log(F.greatest(count, F.lit(1)) / 2500.0))


def blend_probabilities(
    first: DataFrame, second: DataFrame, keys: Sequence[str], weights: dict[str, float], mode: str = "arithmetic"
) -> DataFrame:
    """Blend two probability maps with a weight per class and renormalise.

    ``weights`` gives the weight of the first map for p0, p1 and p2.
    """
    if mode not in ("arithmetic", "geometric"):
        raise ValueError(f"unknown blend mode {mode}")
    at = [*keys, *IJK]
    names = ("p0", "p1", "p2")
    other = second.select(*at, *[F.col(n).alias(f"_{n}") for n in names])
    both = first.join(other, at)
    parts = {}
    for n in names:
        w = float(weights[n])
        if mode == "arithmetic":
            parts[n] = F.col(n) * w + F.col(f"_{n}") * (1.0 - w)
        else:
            floor = F.lit(1e-8)
            parts[n] = F.exp(w * F.log(F.greatest(F.col(n), floor)) + (1.0 - w) * F.log(F.greatest(F.col(f"_{n}"), floor)))
    both = both.withColumns({f"_b{n}": e for n, e in parts.items()})
    total = F.col("_bp0") + F.col("_bp1") + F.col("_bp2")
    return both.select(*at, *[(F.col(f"_b{n}") / total).alias(n) for n in names])


def map_quality(folds: DataFrame, keys: Sequence[str], fold: str) -> DataFrame:
    """Confidence, entropy, spread over folds and vote agreement of the foreground, per case."""
    at = [*keys, *IJK]
    names = ("p0", "p1", "p2")
    votes = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    per = folds.withColumn("_vote", votes).groupBy(*at).agg(
        *[F.avg(n).alias(n) for n in names], *[F.stddev_pop(n).alias(f"_s{n}") for n in names],
        F.count(F.lit(1)).alias("_f"), *[F.count_if(F.col("_vote") == v).alias(f"_v{v}") for v in range(3)])
    entropy = -sum((F.col(n) * F.log(F.greatest(F.col(n), F.lit(1e-8))) for n in names), F.lit(0.0)) / 1.0986122886681098
    per = per.withColumns({
        "_conf": F.greatest(*names), "_ent": entropy,
        "_spread": (F.col("_sp0") + F.col("_sp1") + F.col("_sp2")) / 3.0,
        "_agree": F.greatest("_v0", "_v1", "_v2") / F.col("_f"),
        "_fg": ~((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2"))),
    }).where("_fg")
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("foreground_voxels"), F.avg("_conf").alias("foreground_confidence"),
        F.avg("_ent").alias("foreground_entropy"), F.avg("_spread").alias("ensemble_disagreement"),
        F.avg("_agree").alias("ensemble_consensus"))


def label_volumes(voxels: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return voxels.groupBy(*keys).agg(
        F.count_if(F.col(label) == 1).alias("upper_voxels"), F.count_if(F.col(label) == 2).alias("lower_voxels"))


def registration_ids(label: Column) -> Column:
    """Class 1 is object 1, class 2 is object 17, background is 0."""
    return F.when(label == 1, 1).when(label == 2, 17).otherwise(0)


def dice(prediction: DataFrame, truth: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """(2 * overlap + 1) / (sizes + 1) per class."""
    at = [*keys, *IJK]
    p = prediction.select(*at, F.col(label).alias("_p"))
    t = truth.select(*at, F.col(label).alias("_t"))
    both = p.join(t, at, "full_outer").withColumn(label, F.explode(F.array(F.lit(1), F.lit(2))))
    in_p, in_t = F.coalesce(F.col("_p") == F.col(label), F.lit(False)), F.coalesce(F.col("_t") == F.col(label), F.lit(False))
    return both.groupBy(*keys, label).agg(
        ((2.0 * F.count_if(in_p & in_t) + 1.0) / (F.count_if(in_p) + F.count_if(in_t) + 1.0)).alias("dice"))


def mask_digest(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free digest of the voxel set of every group, built by partial aggregation.

    Two independent 64-bit hashes are summed over the voxels, next to the count;
    no group is collected.
    """
    a, b = F.xxhash64(*IJK), F.xxhash64(F.lit("second"), *IJK)
    halves = [F.sum(F.shiftrightunsigned(a, 32)), F.sum(a.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))),
              F.sum(F.shiftrightunsigned(b, 32)), F.sum(b.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))]
    return mask.groupBy(*keys).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *halves), 256).alias("digest"))


def distinct_masks(configs: DataFrame, keys: Sequence[str], config: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One representative configuration per different mask, and the map of all configurations to it."""
    digests = mask_digest(configs, [*keys, *config])
    best = digests.groupBy(*keys, "digest").agg(F.min(F.struct(*config)).alias("_rep"))
    mapping = digests.join(best, [*keys, "digest"]).select(*keys, *config, "digest", *[F.col(f"_rep.{c}").alias(f"rep_{c}") for c in config])
    chosen = best.select(*keys, *[F.col(f"_rep.{c}").alias(c) for c in config])
    return configs.join(chosen, [*keys, *config], "left_semi"), mapping


# ---- sampling between voxels ------------------------------------------------------


def trilinear(points: DataFrame, voxels: DataFrame, keys: Sequence[str], point_cols: Sequence[str], value: str,
              index: Sequence[Column], fill: float = -1000.0, name: str = "sampled") -> DataFrame:
    """Linear interpolation of a voxel value at fractional indices; missing voxels hold ``fill``.

    Every point asks its eight corners by equi join; the weighted sum is a
    partial aggregate.
    """
    base = points.select(*keys, *point_cols, *[e.alias(f"_f{c}") for e, c in zip(index, IJK)])
    corner = base.withColumn("_o", shifts([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    weight = F.lit(1.0)
    for c in IJK:
        part = F.col(f"_f{c}") - F.floor(f"_f{c}")
        weight = weight * F.when(F.col(f"_o.d{c}") == 1, part).otherwise(1.0 - part)
    corner = corner.withColumn("_w", weight).where(F.col("_w") > 0).select(
        *keys, *point_cols, "_w", *[(F.floor(f"_f{c}") + F.col(f"_o.d{c}")).cast("int").alias(c) for c in IJK])
    hit = corner.join(voxels.select(*keys, *IJK, value), [*keys, *IJK], "left")
    return hit.groupBy(*keys, *point_cols).agg(F.sum(F.col("_w") * F.coalesce(F.col(value), F.lit(fill))).alias(name))


def intensity_evidence(values: DataFrame, keys: Sequence[str], value: str = "sampled") -> DataFrame:
    """Mean clipped intensity plus bonuses for the shares over 700 and 1400."""
    v = F.col(value)
    clipped = F.greatest(F.least(v, F.lit(3000.0)), F.lit(-500.0))
    return values.groupBy(*keys).agg(
        (F.avg(clipped) + 850.0 * F.avg((v >= 700).cast("double")) + 350.0 * F.avg((v >= 1400).cast("double"))).alias("evidence"))


def grid_rows(headers: DataFrame, keys: Sequence[str], shape: tuple[int, int, int]) -> DataFrame:
    """All index rows of a fixed grid for every volume; the explode is spread over the first axis."""
    out = headers.select(*keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))))
    out = out.repartition(*keys, "i")
    for c, n in (("j", shape[1]), ("k", shape[2])):
        out = out.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def resample(headers: DataFrame, voxels: DataFrame, keys: Sequence[str], shape, target: Sequence[float], source: Sequence[float],
             value: str = "hu", fill: float = -1000.0) -> DataFrame:
    """Values of a volume on another grid (both affines given), linear, outside = ``fill``."""
    grid = grid_rows(headers, keys, shape)
    # sixteen constants: grid index -> world -> index of the stored volume
    m = (np.linalg.inv(np.reshape(source, (4, 4))) @ np.reshape(target, (4, 4))).reshape(-1)
    at = M.apply_point(F.array(*[F.lit(float(v)) for v in m]), *[F.col(c).cast("double") for c in IJK])
    rows = grid
    rows = rows.select(*keys, *[F.col(c).alias(f"g{c}") for c in IJK], *[F.round(a, 9).alias(f"_x{c}") for a, c in zip(at, IJK)])
    out = trilinear(rows, voxels, keys, [f"g{c}" for c in IJK], value, [F.col(f"_x{c}") for c in IJK], fill, value)
    return out.select(*keys, *[F.col(f"g{c}").alias(c) for c in IJK], value)


def weak_labels(voxels: DataFrame, seeds: DataFrame, keys: Sequence[str], radius_voxels: float, minimum_hu: float) -> DataFrame:
    """Label bright voxels within a radius of rasterised class seeds; overlaps go to the nearer class.

    Ties go to the lower class. Seeds hold (keys, label, i, j, k) on the grid.
    """
    from .spatial import near_pairs

    bright = voxels.where(F.col("hu") >= minimum_hu)
    ident = F.struct(*IJK)
    q = bright.select(*keys, *[F.col(c).cast("double").alias(a) for c, a in zip(IJK, "xyz")], ident.alias("_cell"))
    t = seeds.select(*keys, "label", *[F.round(c).cast("double").alias(a) for c, a in zip(IJK, "xyz")]).distinct()
    t = t.withColumn("_seed", F.struct("label", "x", "y", "z"))
    pairs = near_pairs(q, t, keys, ["x", "y", "z"], radius_voxels, "_cell", "_seed", keep_target=["label"])
    best = pairs.groupBy(*keys, "_cell").agg(F.min(F.struct(F.round("distance", 9).alias("d"), F.col("_t_label").alias("label"))).alias("_b"))
    return best.select(*keys, *[F.col(f"_cell.{c}").alias(c) for c in IJK], F.col("_b.label").alias("label"))
