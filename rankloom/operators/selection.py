"""Top lists, subsets, blends, votes and pair choices inside case groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import matrix as M
from ..session import cut_lineage
from .grouping import join_null_safe, ordinal_fraction, positions, top_k

INDEX = "candidate_index"


def top_by_score(
    df: DataFrame, keys: Sequence[str], score: str, n: int, excluded: Column | None = None, pos: str = "place"
) -> DataFrame:
    """Best ``n`` rows by score; ``excluded`` rows only count when nothing else is left."""
    if excluded is None:
        return top_k(df, keys, [F.col(score), F.col(INDEX)], n, pos=pos)
    tagged = df.withColumn("_out", F.coalesce(excluded, F.lit(False)))
    first = top_k(tagged, keys, [F.col("_out"), F.col(score), F.col(INDEX)], n, pos=pos)
    # allowed rows sort first, so any allowed row of the group is among these n
    free = F.max(~F.col("_out")).over(W.partitionBy(*keys))
    return first.withColumn("_free", free).where(~(F.col("_out") & F.col("_free"))).drop("_out", "_free")


def run_balanced_top(
    df: DataFrame,
    keys: Sequence[str],
    run: str,
    score: str,
    n: int,
    excluded: Column | None = None,
    pos: str = "place",
) -> DataFrame:
    """ceil(n / runs) rows per run in run order, then the best of the rest, ``n`` in all."""
    keys = list(keys)
    tagged = df.withColumn("_out", F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False))
    order = [F.col("_out"), F.col(score), F.col(INDEX)]
    cut = top_k(tagged, [*keys, run], order, n, pos="_in_run")  # at most n rows per run remain
    group = W.partitionBy(*keys)
    cut = cut.withColumn("_runs", F.size(F.collect_set(F.coalesce(F.col(run).cast("string"), F.lit(""))).over(group)))
    cut = cut.withColumn("_free", F.max(~F.col("_out")).over(group))
    cut = cut.where(~(F.col("_out") & F.col("_free")))
    quota = F.greatest(F.lit(1), F.ceil(F.lit(n) / F.col("_runs")))
    cut = cut.withColumn("_spare", (F.col("_in_run") > quota))
    ordered = [F.col("_spare"), F.when(~F.col("_spare"), F.col(run)), F.col(score), F.col(INDEX)]
    return top_k(cut, keys, ordered, n, pos=pos).drop("_out", "_in_run", "_runs", "_free", "_spare")


def training_subset(
    df: DataFrame, keys: Sequence[str], score: str, truth: str, top_score: int, top_truth: int
) -> DataFrame:
    """Best by score together with best by truth; equal rounded matrices count once, last wins."""
    keys = list(keys)
    by_score = top_k(df, keys, [F.col(score), F.col(INDEX)], top_score, pos="_place").withColumn("_list", F.lit(0))
    by_truth = top_k(df, keys, [F.col(truth), F.col(INDEX)], top_truth, pos="_place").withColumn("_list", F.lit(1))
    both = by_score.unionByName(by_truth).withColumn("_print", M.fingerprint("transform", 7))
    last = [F.col("_list").desc(), F.col("_place").desc()]
    return top_k(both, [*keys, "_print"], last, 1).drop("_print", "_list", "_place")


def union_of_tops(
    df: DataFrame, keys: Sequence[str], first: str, second: str, n_first: int, n_second: int, digits: int = 4
) -> DataFrame:
    """Rows in either top list, equal rounded matrices once (the better by the first score)."""
    keys = list(keys)
    a = top_k(df, keys, [F.col(first), F.col(INDEX)], n_first)
    b = top_k(df, keys, [F.col(second), F.col(INDEX)], n_second)
    both = a.unionByName(b).withColumn("_print", M.fingerprint("transform", digits))
    return top_k(both, [*keys, "_print"], [F.col(first), F.col(INDEX)], 1).drop("_print")


def evidence_prune(
    df: DataFrame, keys: Sequence[str], cell: Sequence[str], quality: Sequence[Column], keep: Column, per_cell: int
) -> DataFrame:
    """Rows that pass ``keep``, best ``per_cell`` of every evidence cell."""
    return top_k(df.where(keep), [*keys, *cell], [*quality, F.col(INDEX)], per_cell)


def diverse_top(
    df: DataFrame, keys: Sequence[str], family: Sequence[str], score: str, n: int, pos: str = "place"
) -> DataFrame:
    """First one of every family in score order, then the best of the rest."""
    keys = list(keys)
    per_family = top_k(df, [*keys, *family], [F.col(score), F.col(INDEX)], n, pos="_in_family")
    order = [F.col("_in_family") > 1, F.col(score), F.col(INDEX)]
    return top_k(per_family, keys, order, n, pos=pos).drop("_in_family")


def capped_top(
    df: DataFrame,
    fold: str,
    content: str,
    order: Sequence[Column],
    cap: int,
    counts: Sequence[int],
    tie: str,
) -> DataFrame:
    """Per fold: at most ``cap`` rows of one content group, then the best N for several N."""
    capped = top_k(df, [fold, content], [*order, F.col(tie)], cap)
    best = top_k(capped, [fold], [*order, F.col(tie)], max(counts), pos="place")
    grid = F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(counts))]))
    return best.withColumn("top_count", grid).where(F.col("place") <= F.col("top_count"))


def keep_best_flag(df: DataFrame, keys: Sequence[str], score: str, n: int, flag: str) -> DataFrame:
    """Every row stays; a flag marks the best ``n`` of each group."""
    best = top_k(df.select(*keys, score, INDEX), keys, [F.col(score), F.col(INDEX)], n)
    marked = best.select(*keys, INDEX, F.lit(True).alias(flag))
    return join_null_safe(df, marked, [*keys, INDEX], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def accepted_rank(df: DataFrame, keys: Sequence[str], score: str, accepted: str, name: str) -> DataFrame:
    """Position by score among accepted rows, or among all when none is accepted."""
    keys = list(keys)
    any_ok = df.groupBy(*keys).agg(F.max(accepted).alias("_any"))
    pool = join_null_safe(df, any_ok, keys, "left").where(
        (F.col("_any") == 0) | (F.col(accepted) == 1)
    ).drop("_any")
    return positions(pool, keys, [F.col(score), F.col(INDEX)], pos=name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``: partial aggregation, no sort of the group."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ranked = df.select(*keys, F.struct(*rest).alias("_row"), F.struct(*order).alias("_order"))
    best = ranked.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def last_writer_wins(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of tables in which a later table replaces equal keys of an earlier one."""
    tagged = [p.withColumn("_part", F.lit(-i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return first_per_key(out, keys, [F.col("_part")]).drop("_part")


def concat_runs(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate runs; columns a run lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# ---- seeds, blends ------------------------------------------------------------


def seed_aggregates(df: DataFrame, keys: Sequence[str], seed: str, cost: str) -> DataFrame:
    """Mean, median, mean rank and vote score of every alternative over its seeds.

    A group is (keys, seed): the ranks come from the skew-safe position operator
    and the vote from a minimum per (keys, seed), so no seed is gathered whole.
    """
    keys = list(keys)
    ranked = ordinal_fraction(df, [*keys, seed], [F.col(cost), F.col(INDEX)], "_rank")
    per_row = ranked.groupBy(*keys, INDEX).agg(
        F.avg(cost).alias("mean_cost"), F.median(cost).alias("median_cost"), F.avg("_rank").alias("rank_mean")
    )
    winners = df.groupBy(*keys, seed).agg(F.min_by(INDEX, F.struct(cost, INDEX)).alias(INDEX))
    votes = winners.groupBy(*keys, INDEX).agg(F.count(F.lit(1)).alias("votes"))
    out = join_null_safe(per_row, votes, [*keys, INDEX], "left")
    out = out.withColumn("votes", F.coalesce(F.col("votes"), F.lit(0)).cast("long"))
    return out.withColumn("vote_score", -F.col("votes") + 1e-6 * F.col("mean_cost"))


def majority_winner(df: DataFrame, keys: Sequence[str], seed: str, cost: str) -> DataFrame:
    """Alternative with most seed votes; ties go to the lower mean cost, then the lower index."""
    scores = seed_aggregates(df, keys, seed, cost).where(F.col("votes") > 0)
    order = [-F.col("votes"), F.col("mean_cost"), F.col(INDEX)]
    return first_per_key(scores.select(*keys, INDEX, "votes", "mean_cost"), keys, order)


def rank_blend(
    df: DataFrame, keys: Sequence[str], first: str, second: str, alphas: Sequence[float], bounded: bool = False
) -> DataFrame:
    """alpha * rank(first) + (1 - alpha) * rank(second) for several alphas; without alphas the two ranks, _ra and _rb."""
    for alpha in alphas:
        if not 0.0 <= alpha <= 1.0:
            raise ValueError("alpha must lie between 0 and 1")
    ranked = ordinal_fraction(df, keys, [F.col(first), F.col(INDEX)], "_ra", bounded=bounded)
    ranked = ordinal_fraction(ranked, keys, [F.col(second), F.col(INDEX)], "_rb", bounded=bounded)
    if not alphas:
        return ranked
    grid = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    out = ranked.withColumn("alpha", grid)
    blended = F.col("alpha") * F.col("_ra") + (1.0 - F.col("alpha")) * F.col("_rb")
    return out.withColumn("blend_score", blended).drop("_ra", "_rb")


def blended_choices(
    df: DataFrame, keys: Sequence[str], first: str, second: str, alphas: Sequence[float], value: str, digits: int = 9
) -> DataFrame:
    """(keys, alpha, value) of the row that each blend of ``rank_blend`` puts first, scores compared at ``digits``.

    Rows are not multiplied by the alphas: a group is aggregated once, where its ranks were numbered, and written with one entry an alpha.
    """
    ranked = rank_blend(df, keys, first, second, [])
    picks = [F.struct(F.lit(float(a)).alias("alpha"), F.min_by(value, F.struct(F.round(a * F.col("_ra") + (1.0 - a) * F.col("_rb"), digits), INDEX)).alias(value))
             for a in alphas]
    each = cut_lineage(ranked.groupBy(*keys).agg(F.array(*picks).alias("_picks")))
    return each.select(*keys, F.inline("_picks"))


def selected_and_best(
    df: DataFrame, keys: Sequence[str], score: str, truth: str
) -> DataFrame:
    """Row chosen by score beside the best row by truth, one row per group."""
    picked = F.min_by(F.struct(INDEX, truth), F.struct(score, INDEX))
    best = F.min_by(F.struct(INDEX, truth), F.struct(truth, INDEX))
    out = df.groupBy(*keys).agg(
        picked.alias("_p"), best.alias("_b"), F.count(F.lit(1)).alias("pool_size")
    )
    return out.select(
        *keys,
        F.col(f"_p.{INDEX}").alias(INDEX), F.col(f"_p.{truth}").alias("selected_error"),
        F.col(f"_b.{INDEX}").alias("best_index"), F.col(f"_b.{truth}").alias("best_error"),
        (F.col(f"_p.{truth}") - F.col(f"_b.{truth}")).alias("regret"), "pool_size",
    )


# ---- pairs --------------------------------------------------------------------


def joint_pairs(
    ranked: DataFrame,
    case: str,
    prior_rotation: Sequence[Column],
    prior_shift: Sequence[Column],
    top: int = 8,
    angle_weight: float = 0.01,
    shift_weight: float = 0.075,
    allow_parity_mismatch: bool = False,
) -> DataFrame:
    """Best upper/lower pair of every case.

    ``ranked`` is the pool of each (case, jaw) with score, chirality, transform and
    ``place`` (rank in the pool, whose size the pool budget bounds). The first
    ``top`` of each jaw meet on equal case and parity. Only a case without any
    such pair meets again over its whole pool (``widened``); a case that still
    has none gives no row.
    """
    fields = [INDEX, "score", "chirality", "transform", "place"]
    on = [case] if allow_parity_mismatch else [case, "_parity"]

    def best(rows: DataFrame) -> DataFrame:
        def side(jaw: str, prefix: str) -> DataFrame:
            return rows.where(F.col("jaw") == jaw).select(
                case, F.col("chirality").alias("_parity"), *[F.col(f).alias(f"{prefix}_{f}") for f in fields])

        lower = side("lower", "lower")
        pairs = side("upper", "upper").join(lower.drop("_parity") if allow_parity_mismatch else lower, on)
        angle, gap = M.pair_deviation("upper_transform", "lower_transform", prior_rotation, prior_shift)
        pairs = pairs.withColumn("angle_deg", angle).withColumn("shift_mm", gap).withColumn(
            "objective",
            F.col("upper_score") + F.col("lower_score") + angle_weight * F.col("angle_deg") + shift_weight * F.col("shift_mm"),
        )
        keep = F.struct(f"upper_{INDEX}", f"lower_{INDEX}", "objective", "angle_deg", "shift_mm", "upper_place", "lower_place")
        order = F.struct("objective", "upper_place", "lower_place")
        return pairs.groupBy(case).agg(F.min_by(keep, order).alias("_p")).select(case, "_p.*")

    ranked = cut_lineage(ranked.select(case, "jaw", *fields))  # both jaws are read twice
    first = cut_lineage(best(ranked.where(F.col("place") <= top)).withColumn("widened", F.lit(False)))
    rest = ranked.join(first.select(case), case, "left_anti")
    return first.unionByName(best(rest).withColumn("widened", F.lit(True)))
