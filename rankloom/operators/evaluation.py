"""Comparing methods: fallback, rank tables, grouped bootstrap, nested choice, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.keys import hash_draw
from .grouping import join_null_safe, positions, quantiles, quantiles_without
from .summaries import attach, influence_report, paired_counts


def exact_fallback(df: DataFrame, exact: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Replace metrics where an exact row exists for the key; ``replaced`` marks those rows."""
    side = exact.select(*keys, *[F.col(m).alias(f"_x_{m}") for m in metrics], F.lit(True).alias("replaced"))
    out = join_null_safe(df, side, keys, "left")
    for m in metrics:
        out = out.withColumn(m, F.coalesce(F.col(f"_x_{m}"), F.col(m)))
    return out.drop(*[f"_x_{m}" for m in metrics]).withColumn("replaced", F.coalesce("replaced", F.lit(False)))


def incomplete_fallback_keys(df: DataFrame, exact: DataFrame, mode: str, keys: Sequence[str]) -> DataFrame:
    """Exact keys that some but not all modes have; must be empty."""
    from .summaries import key_set_report

    touched = df.join(exact.select(*keys).distinct(), list(keys), "left_semi")
    missing = key_set_report(df.select(mode, *keys), mode, keys)
    return missing.join(touched.select(*keys).distinct(), list(keys), "left_semi")


def rank_modes(table: DataFrame, over: Sequence[str], mode: str, translation: str, rotation: str,
               complexity: Column) -> DataFrame:
    """Ranks on both mean errors (ties share the lowest), their mean, and a total order.

    ``table`` has one row per (over, mode): the number of modes bounds a window.
    """
    group = W.partitionBy(*over)
    out = (
        table.withColumn("translation_rank", F.rank().over(group.orderBy(translation)))
        .withColumn("rotation_rank", F.rank().over(group.orderBy(rotation)))
        .withColumn("average_rank", (F.col("translation_rank") + F.col("rotation_rank")) / 2.0)
        .withColumn("complexity", complexity)
    )
    order = ["average_rank", "rotation_rank", "translation_rank", rotation, translation, "complexity", mode]
    return out.withColumn("place", F.row_number().over(group.orderBy(*order)))


def means_without_groups(df: DataFrame, mode: str, group: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of every metric per (held-out group, mode) over all other groups.

    Two small sums instead of one scan per held-out group.
    """
    own = df.groupBy(group, mode).agg(
        F.count(F.lit(1)).alias("_own_n"), *[F.sum(m).alias(f"_own_{m}") for m in metrics]
    )
    total = own.groupBy(mode).agg(
        F.sum("_own_n").alias("_n"), *[F.sum(f"_own_{m}").alias(f"_all_{m}") for m in metrics]
    )
    out = own.join(total, mode)
    left = F.col("_n") - F.col("_own_n")
    return out.where(left > 0).select(
        group, mode, F.col("_own_n").alias("heldout_rows"),
        *[((F.col(f"_all_{m}") - F.col(f"_own_{m}")) / left).alias(m) for m in metrics],
        *[(F.col(f"_own_{m}") / F.col("_own_n")).alias(f"heldout_{m}") for m in metrics],
    )


def nested_selection(df: DataFrame, mode: str, group: str, value: str, complexity: Column) -> DataFrame:
    """Per held-out group: the mode with the lowest mean elsewhere, and its error here."""
    table = means_without_groups(df, mode, group, [value])
    order = F.struct(F.col(value), complexity, F.col(mode))
    pick = F.struct(F.col(mode).alias("selected"), F.col(value).alias("training_mean"),
                    F.col(f"heldout_{value}").alias("heldout_mean"), "heldout_rows")
    return table.groupBy(group).agg(F.min_by(pick, order).alias("_p")).select(group, "_p.*")


def nested_rank_selection(df: DataFrame, mode: str, group: str, complexity: Column) -> DataFrame:
    """As ``nested_selection``, with the two-metric rank table in place of one mean."""
    table = means_without_groups(df, mode, group, ["translation", "rotation"])
    ranked = rank_modes(table, [group], mode, "translation", "rotation", complexity)
    return ranked.where(F.col("place") == 1).select(
        group, F.col(mode).alias("selected"), F.col("average_rank").alias("training_average_rank"),
        "heldout_rows", "heldout_translation", "heldout_rotation",
    )


def recommended_mode(fixed: DataFrame, selections: DataFrame, mode: str, order: Sequence[Column]) -> DataFrame:
    """Most often selected mode; ``order`` breaks ties. One row per mode is compared."""
    votes = selections.groupBy(F.col("selected").alias(mode)).agg(F.count(F.lit(1)).alias("selections"))
    table = fixed.join(votes, mode, "left").withColumn("selections", F.coalesce("selections", F.lit(0)))
    key = F.struct(-F.col("selections"), *order, F.col(mode))
    return table.agg(F.min_by(F.struct(*table.columns), key).alias("_p")).select("_p.*")


def nested_jaw_choice(
    df: DataFrame, group: str, model: str, post: str, jaw: str, value: str, shared_post: bool = False
) -> DataFrame:
    """Held-out choice of a model and its post-processing.

    Per model and jaw the best post-processing elsewhere is taken (or one shared
    by both jaws), then the model with the lowest mean over the jaws.
    """
    tagged = df.withColumn("_config", F.concat_ws("\u0001", model, post, jaw))
    table = means_without_groups(tagged, "_config", group, [value])
    parts = F.split("_config", "\u0001")
    table = table.select(
        group, parts[0].alias(model), parts[1].alias(post), parts[2].alias(jaw), value, f"heldout_{value}"
    )
    jaws = df.select(jaw).distinct().agg(F.count(F.lit(1)).alias("_jaws")).withColumn("_one", F.lit(1))
    if shared_post:
        both = table.groupBy(group, model, post).agg(
            F.avg(value).alias("training_mean"), F.avg(f"heldout_{value}").alias("heldout_mean"),
            F.count(F.lit(1)).alias("_have"),
        )
        label = F.col(post)
    else:
        best = table.groupBy(group, model, jaw).agg(
            F.min_by(F.struct(post, value, f"heldout_{value}"), F.struct(value, post)).alias("_b")
        )
        both = best.groupBy(group, model).agg(
            F.avg(f"_b.{value}").alias("training_mean"), F.avg(f"_b.heldout_{value}").alias("heldout_mean"),
            F.count(F.lit(1)).alias("_have"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(jaw, f"_b.{post}"))), lambda s: s[post]), "/").alias(post),
        )
        label = F.col(post)
    both = both.withColumn("_one", F.lit(1)).join(jaws, "_one").where(F.col("_have") == F.col("_jaws"))
    pick = F.struct(F.col(model), F.col(post), "training_mean", "heldout_mean")
    return both.groupBy(group).agg(
        F.min_by(pick, F.struct("training_mean", F.col(model), label)).alias("_p")
    ).select(group, "_p.*")


# ---- resampling ---------------------------------------------------------------


def numbered_groups(df: DataFrame, group: str) -> DataFrame:
    """Distinct groups with a dense number from 0, in group order."""
    groups = df.select(group).distinct()
    return positions(groups, [], [F.col(group)], "_p").select(group, (F.col("_p") - 1).alias("group_pos"))


def resample_weights(groups: DataFrame, samples: int, seed: int, name: str = "group_pos") -> DataFrame:
    """How often each group is drawn in each resample of all groups.

    The draw of (sample, slot) is a hash, so partitioning cannot change it, and
    equal draws are counted on the map side.
    """
    spark, size = groups.sparkSession, groups.count()
    slots = spark.range(samples * size)
    draws = slots.select(
        F.floor(F.col("id") / size).alias("sample"), (F.col("id") % size).alias("slot")
    )
    text = F.concat_ws("|", F.lit(str(seed)), F.col("sample"), F.col("slot"))
    drawn = draws.select("sample", hash_draw(text, F.lit(size)).alias(name))
    return drawn.groupBy("sample", name).agg(F.count(F.lit(1)).alias("times"))


def cluster_bootstrap(
    df: DataFrame, group: str, value: str, accepted: Column, samples: int, seed: int = 0
) -> DataFrame:
    """Mean, p90 and share <= 3 of the accepted rows, per resample of the content groups."""
    groups = numbered_groups(df, group)
    rows = df.where(accepted).join(groups, group).select("group_pos", value)
    weights = resample_weights(groups, samples, seed)
    hist = rows.groupBy("group_pos", value).agg(F.count(F.lit(1)).alias("_c"))
    sums = rows.groupBy("group_pos").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.sum((F.col(value) <= 3.0).cast("long")).alias("_ok")
    )
    means = weights.join(sums, "group_pos").groupBy("sample").agg(
        (F.sum(F.col("times") * F.col("_s")) / F.sum(F.col("times") * F.col("_n"))).alias("mean"),
        (F.sum(F.col("times") * F.col("_ok")) / F.sum(F.col("times") * F.col("_n"))).alias("success"),
    )
    drawn = weights.join(hist, "group_pos").groupBy("sample", value).agg(F.sum(F.col("times") * F.col("_c")).alias("_w"))
    return means.join(quantiles(drawn, ["sample"], value, {"p90": 0.9}, weight="_w"), "sample")


def interval_report(samples: DataFrame) -> DataFrame:
    """95% intervals and limit probabilities over the resamples (their number is a parameter)."""
    out = [F.count(F.lit(1)).alias("samples")]
    for c in ("mean", "p90", "success"):
        out += [F.percentile(c, F.lit(0.025)).alias(f"{c}_low"), F.percentile(c, F.lit(0.975)).alias(f"{c}_high")]
    out.append(F.avg((F.col("p90") <= 2.5).cast("double")).alias("p90_within_limit"))
    out.append(F.avg((F.col("success") >= 0.95).cast("double")).alias("success_within_limit"))
    return samples.agg(*out)


def bootstrap_mean(df: DataFrame, group: str, value: str, samples: int, seed: int = 0) -> DataFrame:
    """Mean over groups per resample; one row of ``df`` per group."""
    groups = numbered_groups(df, group)
    rows = df.join(groups, group).select("group_pos", value)
    weights = resample_weights(groups, samples, seed)
    return weights.join(rows, "group_pos").groupBy("sample").agg(
        (F.sum(F.col("times") * F.col(value)) / F.sum("times")).alias("mean")
    )


def bootstrap_rank_deltas(
    df: DataFrame, mode: str, group: str, candidate: str, baseline: str, samples: int, seed: int = 0
) -> DataFrame:
    """Rank, translation and rotation difference of two modes per resample of the groups."""
    means = df.groupBy(mode, group).agg(F.avg("translation").alias("_t"), F.avg("rotation").alias("_r"))
    groups = numbered_groups(df, group)
    weights = resample_weights(groups, samples, seed)
    each = weights.join(means.join(groups, group), "group_pos").groupBy("sample", mode).agg(
        (F.sum(F.col("times") * F.col("_t")) / F.sum("times")).alias("translation"),
        (F.sum(F.col("times") * F.col("_r")) / F.sum("times")).alias("rotation"),
    )
    ranked = rank_modes(each, ["sample"], mode, "translation", "rotation", F.lit(0))

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col(mode) == name, F.col(column)))

    return ranked.groupBy("sample").agg(*[
        (of(candidate, c) - of(baseline, c)).alias(f"{n}_delta")
        for c, n in (("average_rank", "rank"), ("translation", "translation"), ("rotation", "rotation"))
    ])


def rank_delta_report(deltas: DataFrame) -> DataFrame:
    d = F.col("rank_delta")
    out = [F.avg((d < 0).cast("double")).alias("better"), F.avg((d == 0).cast("double")).alias("tied"),
           F.avg((d > 0).cast("double")).alias("worse")]
    for c in ("translation", "rotation"):
        out += [F.percentile(f"{c}_delta", F.lit(0.025)).alias(f"{c}_low"),
                F.percentile(f"{c}_delta", F.lit(0.975)).alias(f"{c}_high")]
    return deltas.agg(*out)


def group_deltas(df: DataFrame, mode: str, group: str, value: str, candidate: str, baseline: str) -> DataFrame:
    """Mean paired difference candidate - baseline per content group."""
    def of(name: str) -> Column:
        return F.avg(F.when(F.col(mode) == name, F.col(value)))

    return df.where(F.col(mode).isin(candidate, baseline)).groupBy(group).agg((of(candidate) - of(baseline)).alias("delta"))


def robust_decision(deltas: DataFrame, group: str, samples: int, seed: int = 0) -> DataFrame:
    """Whether a candidate may replace the baseline: five criteria and their conjunction."""
    base = deltas.agg(F.avg("delta").alias("mean_delta"), F.count("delta").alias("groups"))
    out = attach(base, quantiles(deltas, [], "delta", {"median_delta": 0.5}), [])
    out = attach(out, paired_counts(deltas, [], "delta"), [])
    out = attach(out, influence_report(deltas, [], group, "delta"), [])
    boot = bootstrap_mean(deltas, group, "delta", samples, seed).agg(
        F.percentile("mean", F.lit(0.025)).alias("ci_low"), F.percentile("mean", F.lit(0.975)).alias("ci_high")
    )
    out = attach(out, boot, [])
    return out.withColumns({
        "mean_better": F.col("mean_delta") < 0, "interval_below_zero": F.col("ci_high") < 0,
        "median_better": F.col("median_delta") < 0, "more_wins": F.col("wins") > F.col("losses"),
        "survives_leave_one_out": F.col("highest_without") < 0,
    }).withColumn(
        "selected",
        F.col("mean_better") & F.col("interval_below_zero") & F.col("median_better") & F.col("more_wins")
        & F.col("survives_leave_one_out"),
    )


def official_evaluation(
    df: DataFrame, mode: str, group: str, baseline: str, complexity: Column, samples: int, seed: int = 0
) -> DataFrame:
    """Rank table, nested choice, bootstrap and leave-one-group-out checks in one row.

    The nested candidate is one name, so it is read on the driver to name the
    columns of the paired comparison.
    """
    fixed = rank_modes(
        df.groupBy(mode).agg(F.avg("translation").alias("translation"), F.avg("rotation").alias("rotation")),
        [], mode, "translation", "rotation", complexity,
    )
    nested = nested_rank_selection(df, mode, group, complexity)
    order = [F.col("average_rank"), F.col("rotation_rank"), F.col("translation_rank"), F.col("complexity")]
    best = recommended_mode(fixed, nested, mode, order)
    candidate = best.select(mode).first()[0]
    boot = rank_delta_report(bootstrap_rank_deltas(df, mode, group, candidate, baseline, samples, seed))
    ranked = rank_modes(
        means_without_groups(df, mode, group, ["translation", "rotation"]), [group], mode,
        "translation", "rotation", complexity,
    )

    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col(mode) == name, F.col(column)))

    drops = ranked.groupBy(group).agg((of(candidate, "average_rank") - of(baseline, "average_rank")).alias("_d"))
    worst = drops.agg(F.max("_d").alias("worst_rank_delta"))
    votes = nested.agg(
        F.count_if(F.col("selected") == candidate).alias("candidate_selections"),
        F.count_if(F.col("selected") == baseline).alias("baseline_selections"),
    )
    pair = fixed.agg(*[
        of(name, c).alias(f"{tag}_{c}")
        for tag, name in (("candidate", candidate), ("baseline", baseline))
        for c in ("average_rank", "translation", "rotation")
    ])
    out = attach(attach(attach(pair, boot, []), worst, []), votes, [])
    dominated = (F.col("candidate_translation") >= F.col("baseline_translation")) & (
        F.col("candidate_rotation") >= F.col("baseline_rotation"))
    passed = (
        (F.col("candidate_average_rank") < F.col("baseline_average_rank")) & ~dominated & (F.col("better") >= 0.80)
        & (F.col("worst_rank_delta") <= 0) & (F.col("candidate_selections") >= F.col("baseline_selections"))
    )
    chosen = F.lit(candidate == baseline) | passed
    return out.withColumn("candidate", F.lit(candidate)).withColumn(
        "recommended", F.when(chosen, F.lit(candidate)).otherwise(F.lit(baseline))
    )


# ---- gates --------------------------------------------------------------------


def gate_calibration(df: DataFrame, predicted: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """Coverage and error summary of the rows each threshold on the prediction accepts."""
    from .summaries import summarize

    total = df.agg(F.count(F.lit(1)).alias("_all"))
    grid = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    kept = grid.where(F.col(predicted) <= F.col("threshold"))
    table = summarize(kept, ["threshold"], truth, success=(2.0, 3.0), prefix="true")
    out = table.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one")
    return out.withColumn("coverage", F.col("true_count") / F.col("_all")).drop("_one", "_all")


def recommended_gate(grid: DataFrame, least: int = 8, p90: float = 2.5, success: float = 0.95) -> DataFrame:
    """Gate with the widest coverage that meets the limits (first threshold on ties)."""
    ok = grid.where((F.col("true_count") >= least) & (F.col("true_p90") <= p90) & (F.col("true_le_3") >= success))
    key = F.struct(-F.col("coverage"), F.col("threshold"))
    return ok.agg(F.min_by(F.struct(*grid.columns), key).alias("_p")).where("_p is not null").select("_p.*")


ROUTE_ORDER = ("mean", "p90", "selections", "advantage", "cap")


def route_grid_rows(df: DataFrame, caps: Sequence[float], advantages: Sequence[float]) -> DataFrame:
    """Every row under every (cap, advantage) gate: the route it takes and its error."""
    grid = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("cap"), F.lit(float(a)).alias("advantage")) for c in caps for a in advantages
    ]))
    rows = df.withColumn("_g", grid).select("*", "_g.cap", "_g.advantage").drop("_g")
    first = (F.col("first_predicted") <= F.col("cap")) & (
        F.col("second_predicted") - F.col("first_predicted") >= F.col("advantage"))
    return rows.withColumn("takes_first", first).withColumn(
        "error", F.when(first, F.col("first_error")).otherwise(F.col("second_error"))
    )


def route_gate_grid(df: DataFrame, keys: Sequence[str], caps: Sequence[float], advantages: Sequence[float]) -> DataFrame:
    """Mean, median, p90 and number of first-route selections of every gate."""
    rows = route_grid_rows(df, caps, advantages)
    config = [*keys, "cap", "advantage"]
    base = rows.groupBy(*config).agg(F.avg("error").alias("mean"), F.count_if("takes_first").alias("selections"))
    return attach(base, quantiles(rows, config, "error", {"median": 0.5, "p90": 0.9}), config)


def nested_route_gate(
    df: DataFrame, keys: Sequence[str], group: str, tie: Sequence[str], caps: Sequence[float], advantages: Sequence[float]
) -> DataFrame:
    """Per held-out content group: the best gate of the other groups."""
    config = [*keys, "cap", "advantage"]
    rows = route_grid_rows(df, caps, advantages)
    own = rows.groupBy(*config, group).agg(
        F.sum("error").alias("_s"), F.count(F.lit(1)).alias("_c"), F.count_if("takes_first").alias("_f")
    )
    total = own.groupBy(*config).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"), F.sum("_f").alias("_tf"))
    table = own.join(total, config).where(F.col("_tc") > F.col("_c")).select(
        *config, group, F.round((F.col("_ts") - F.col("_s")) / (F.col("_tc") - F.col("_c")), 9).alias("mean"),
        (F.col("_tf") - F.col("_f")).alias("selections"),
    )
    tails = quantiles_without(rows, config, group, "error", tie, {"p90": 0.9})
    table = table.join(tails, [*config, group])
    key = F.struct("mean", F.round("p90", 9), "selections", "advantage", "cap")
    return table.groupBy(*keys, group).agg(
        F.min_by(F.struct("cap", "advantage", "mean", "p90", "selections"), key).alias("_p")
    ).select(*keys, group, "_p.*")


def needs_retry(predicted: Column, outlier: Column, jaw: Column, limits: Mapping[str, tuple[float, float]]) -> Column:
    """True where the predicted error or the outlier distance is over the limit of the jaw."""
    chain = None
    for name, (error, p90) in limits.items():
        over = F.coalesce(predicted > error, F.lit(True)) | F.coalesce(outlier > p90, F.lit(False))
        chain = F.when(jaw == name, over) if chain is None else chain.when(jaw == name, over)
    return F.coalesce(chain, F.lit(False))
