"""Error summaries, counts and agreement statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouping import join_null_safe, positions, quantiles


def attach(base: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two per-group tables; without keys both have exactly one row."""
    keys = list(keys)
    if keys:
        return join_null_safe(base, part, keys, "left")
    one = F.lit(1)
    return base.withColumn("_one", one).join(part.withColumn("_one", one), "_one", "left").drop("_one")


def summarize(
    df: DataFrame, keys: Sequence[str], value: str, success: Sequence[float] = (2.0, 3.0), prefix: str | None = None
) -> DataFrame:
    """Count, mean, median, p90, max and success shares of one error column."""
    name = prefix or value
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(value).alias(f"{name}_count"),
        F.avg(value).alias(f"{name}_mean"),
        F.max(value).alias(f"{name}_max"),
        *[F.avg((F.col(value) <= limit).cast("double")).alias(f"{name}_le_{limit:g}") for limit in success],
    )
    return attach(base, quantiles(df, keys, value, {f"{name}_median": 0.5, f"{name}_p90": 0.9}), keys)


def two_metric_summary(
    df: DataFrame, keys: Sequence[str], translation: str = "translation", rotation: str = "rotation"
) -> DataFrame:
    """Mean, median, p90 and max of both errors, plus the mean balanced error."""
    balanced = df.groupBy(*keys).agg(
        F.avg(0.5 * (F.col(translation) / 10.0 + F.col(rotation) / 5.0)).alias("balanced_mean")
    )
    out = summarize(df, keys, translation, success=(), prefix="translation")
    out = attach(out, summarize(df, keys, rotation, success=(), prefix="rotation").drop("rotation_count"), keys)
    return attach(out, balanced, keys)


def counts_by(df: DataFrame, keys: Sequence[str], totals: bool = False) -> DataFrame:
    """Row counts per key; with ``totals`` also the grand total, from the same pass."""
    if not totals:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    grouped = df.groupingSets([[F.col(k) for k in keys], []], *keys)
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("level"))


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in columns])


def correlation(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "pearson") -> DataFrame:
    """Pearson correlation; null when either side does not vary."""
    varies = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return df.groupBy(*keys).agg(F.when(varies, F.corr(a, b)).alias(name))


def paired_counts(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Wins (delta < 0), losses and ties."""
    d = F.col(delta)
    return df.groupBy(*keys).agg(
        F.count_if(d < 0).alias("wins"), F.count_if(d > 0).alias("losses"), F.count_if(d == 0).alias("ties")
    )


def leave_one_out(df: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Mean of the others for every unit and how far the mean moves without it."""
    keys = list(keys)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    out = attach(df.select(*keys, unit, value), totals, keys)
    out = out.withColumn("mean_without", (F.col("_sum") - F.col(value)) / (F.col("_n") - 1))
    return out.withColumn("influence", F.abs(F.col("mean_without") - F.col("_sum") / F.col("_n"))).drop("_sum", "_n")


def influence_report(df: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Range of leave-one-out means and the most influential unit of each group."""
    each = leave_one_out(df, keys, unit, value)
    first = F.struct(-F.col("influence"), F.col(unit))
    return each.groupBy(*keys).agg(
        F.min("mean_without").alias("lowest_without"), F.max("mean_without").alias("highest_without"),
        F.min_by(unit, first).alias("most_influential"), F.min_by(value, first).alias("influential_value"),
        F.min_by("mean_without", first).alias("mean_without_it"),
        F.greatest(F.lit(0.0), -F.min(value)).alias("_gain"), F.sum(value).alias("_sum"),
    ).withColumn("gain_share", F.when(F.col("_sum") < 0, F.col("_gain") / -F.col("_sum"))).drop("_gain", "_sum")


def signed_rank(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Signed-rank sums of paired deltas and the two-sided p-value.

    Ranks come from the histogram of absolute deltas, so ties get their average
    rank without a window over the whole group.
    """
    keys = list(keys)
    used = df.where(F.col(delta) != 0).select(*keys, F.abs(delta).alias("_abs"), (F.col(delta) > 0).alias("_up"))
    hist = used.groupBy(*keys, "_abs").agg(
        F.count(F.lit(1)).alias("_c"), F.count_if("_up").alias("_ups")
    )
    ranked = positions(hist, keys, [F.col("_abs")], "_pos", "_n", weight="_c")
    rank = F.col("_pos") + (F.col("_c") - 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.max("_n").alias("pairs"), F.sum(rank * F.col("_ups")).alias("rank_sum_up"),
        F.sum(rank * (F.col("_c") - F.col("_ups"))).alias("rank_sum_down"),
        F.sum(F.col("_c") * F.col("_c") * F.col("_c") - F.col("_c")).alias("tie_term"),
    )

    @F.pandas_udf(T.DoubleType())
    def p_value(n, up, down, ties):
        import math

        import pandas as pd

        out = []
        for count, a, b, tie in zip(n, up, down, ties):
            low = min(a, b)
            if tie == 0 and count <= 50:  # exact distribution of the rank sum
                ways = [1]
                for size in range(1, int(count) + 1):
                    grown = ways + [0] * size
                    for at, value in enumerate(ways):
                        grown[at + size] += value
                    ways = grown
                out.append(min(1.0, 2.0 * sum(ways[: int(low) + 1]) / 2 ** int(count)))
                continue
            spread = math.sqrt((count * (count + 1) * (2 * count + 1) - 0.5 * tie) / 24.0)
            z = (low - count * (count + 1) / 4.0) / spread if spread else 0.0
            out.append(math.erfc(abs(z) / math.sqrt(2.0)))
        return pd.Series(out)

    # one row per group reaches Python here
    return sums.withColumn("p_value", p_value("pairs", "rank_sum_up", "rank_sum_down", "tie_term"))


def key_set_report(df: DataFrame, part: str, keys: Sequence[str]) -> DataFrame:
    """Keys that are not present in every part, with the number of parts that have them."""
    parts = df.select(F.col(part).alias("_part")).distinct().agg(F.count(F.lit(1)).alias("parts"))
    have = df.groupBy(*keys).agg(F.count_distinct(part).alias("present"))
    return (
        have.withColumn("_one", F.lit(1)).join(parts.withColumn("_one", F.lit(1)), "_one")
        .where(F.col("present") < F.col("parts")).drop("_one")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def require_empty(df: DataFrame, message: str) -> None:
    """Raise when a table of violations has a row; only a few rows reach the driver."""
    bad = df.limit(3).collect()
    if bad:
        raise ValueError(f"{message}: {[tuple(r) for r in bad]}")


def dispersion(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, mean and population spread of the finite values, and how many there are."""
    v = F.col(value)
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    base = finite.groupBy(*keys).agg(
        F.count(value).alias("finite"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread")
    )
    return attach(base, quantiles(finite, keys, value, {"median": 0.5}), keys)


def metric_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def best_checkpoint(df: DataFrame, member: str, epoch: str, metric: str, others: Sequence[str]) -> DataFrame:
    """Per member: number of epochs, the epoch with the highest metric and its other metrics."""
    order = F.struct(-F.col(metric), F.col(epoch))
    return df.groupBy(member).agg(
        F.count(F.lit(1)).alias("epochs"), F.min_by(epoch, order).alias("best_epoch"), F.max(metric).alias(metric),
        *[F.min_by(c, order).alias(c) for c in others],
    )


def config_summary(df: DataFrame, config: Sequence[str], metric: str, extra: Column | None = None) -> DataFrame:
    """Mean, median and minimum of a metric per configuration."""
    base = df.groupBy(*config).agg(F.avg(metric).alias("mean"), F.min(metric).alias("minimum"))
    return attach(base, quantiles(df, config, metric, {"median": 0.5}), config)
