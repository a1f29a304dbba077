"""Ranks, quantiles and totals inside groups, safe for very large groups.

A window over ``partitionBy(keys)`` sends a whole group to one task. That is the
best plan while groups are small, and a dead end once one group holds a large
share of the table. Each function here counts the groups first (one narrow
aggregate) and, when a group is over the limit, cuts that group alone into ordered
buckets: bucket edges come from a hash sample of the group, rows are numbered
inside (keys, bucket), and bucket totals give the offset of each bucket. The
result is exactly that of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import cut_lineage

HOT_ROWS_SETTING = "spark.rankloom.hotGroupRows"
HOT_ROWS_DEFAULT = 1_000_000
#: Buckets of a hot group for each time it holds the limit, so that a bucket stays well below it.
BUCKETS_PER_LIMIT = 4
SAMPLES_PER_BUCKET = 16
#: Up to this k Spark limits a group on the map side (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_K = 1000
SALTS = 64
#: Positions of one block of a lookup.
PLACES = 1024


def hot_limit(df: DataFrame, limit: int | None = None) -> int:
    if limit is not None:
        return limit
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS_DEFAULT)))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which a null key equals a null key, as it does in a group."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True)
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Size of the largest group: one narrow aggregate, one number on the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.agg(F.max("_rows")).first()[0] or 0


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)


def _bucketed(df, keys, order, hot, limit):
    """Add ``_bucket``, an ordered slice number, to the rows of hot groups.

    A group is cut into as many slices as its size asks for. The slice of a row is found in two steps, among every
    n-th edge and then among the n edges behind it, so many edges cost their square root.
    """
    hot = hot.withColumn("_cuts", F.greatest(F.lit(2), F.ceil(F.col("_rows") * BUCKETS_PER_LIMIT / F.lit(float(limit)))).cast("int"))
    sample = (
        join_null_safe(df.select(*keys, F.struct(*order).alias("_at")), hot, keys, "inner")
        .where(F.pmod(F.xxhash64("_at"), F.ceil(F.col("_rows") / (F.col("_cuts") * SAMPLES_PER_BUCKET))) == 0)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_at")).alias("_sorted"), F.max("_cuts").alias("_cuts"))
    )
    edges = sample.select(
        *keys,
        F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.col("_cuts") - 1), lambda i: F.get("_sorted", F.floor(i * F.size("_sorted") / F.col("_cuts")).cast("int")))).alias("_edges"),
        F.ceil(F.sqrt("_cuts")).cast("int").alias("_step"),
    ).withColumn("_coarse", F.filter("_edges", lambda edge, i: i % F.col("_step") == F.col("_step") - 1))
    at = F.struct(*order)
    passed = F.size(F.filter("_coarse", lambda edge: edge <= at)) * F.col("_step")
    behind = F.size(F.filter(F.slice("_edges", F.col("_passed") + 1, F.col("_step")), lambda edge: edge <= at))
    tagged = join_null_safe(df, edges, keys, "left").withColumn("_passed", passed)
    tagged = tagged.withColumn("_bucket", F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(F.col("_passed") + behind))
    return tagged.drop("_edges", "_coarse", "_step", "_passed")


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    pos: str = "pos",
    total: str | None = None,
    weight: str | None = None,
    bounded: bool = False,
    limit: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in ascending ``order``.

    ``order`` must be total inside a group. With ``weight`` every row stands for
    that many rows and ``pos`` is the number of the first of them. ``total``
    names a column for the group size. ``bounded`` says that the caller knows a
    bound on the group size (for example rows already cut to a top-k). When ``df``
    is costly, ``sized_by`` is a cheaper table with the same keys whose groups are
    at least as large; the sizes are then counted there.
    """
    keys = list(keys)
    each = F.col(weight) if weight else F.lit(1)
    limit = hot_limit(df, limit)
    hot = None
    if not bounded:
        hot = hot_groups(sized_by if sized_by is not None else df, keys, limit)
        if hot.isEmpty():
            hot = None
    if hot is None:
        return _plain_positions(df, keys, order, pos, total, weight, each)
    if not keys:
        return _hot_positions(df, keys, order, pos, total, weight, each, hot, limit)
    # only the hot groups take the longer way
    cold = _plain_positions(join_null_safe(df, hot, keys, "left_anti"), keys, order, pos, total, weight, each)
    return cold.unionByName(_hot_positions(join_null_safe(df, hot.select(*keys), keys, "left_semi"), keys, order, pos, total, weight, each, hot, limit))


def _plain_positions(df, keys, order, pos, total, weight, each):
    window = W.partitionBy(*keys).orderBy(*order)
    if weight:
        number = F.sum(weight).over(window.rowsBetween(W.unboundedPreceding, 0)) - each + 1
    else:
        number = F.row_number().over(window)
    out = df.withColumn(pos, number.cast("long"))
    if total:
        out = out.withColumn(total, F.sum(each).over(W.partitionBy(*keys)).cast("long"))
    return out


def _hot_positions(df, keys, order, pos, total, weight, each, hot, limit):
    parts = [*keys, "_bucket"]
    tagged = _bucketed(df, keys, order, hot, limit)
    sizes = tagged.groupBy(*parts).agg(F.sum(each).cast("long").alias("_size"))
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *parts,
        F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_before"),
        F.sum("_size").over(W.partitionBy(*keys)).alias("_total"),
    )
    inside = W.partitionBy(*parts).orderBy(*order)
    if weight:
        number = F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, 0)) - each + 1
    else:
        number = F.row_number().over(inside)
    out = (
        join_null_safe(tagged.repartition(*parts), offsets, parts, "inner")
        .withColumn("_inside", number)
        .withColumn(pos, (F.col("_inside") + F.col("_before")).cast("long"))
    )
    if total:
        out = out.withColumn(total, F.col("_total").cast("long"))
    return out.select(*df.columns, pos, *([total] if total else []))


def ordinal_fraction(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, bounded: bool = False
) -> DataFrame:
    """Rank in 0..1 with ties kept in order: (position - 1) / max(n - 1, 1)."""
    ranked = positions(df, keys, order, pos="_pos", total="_n", bounded=bounded)
    value = (F.col("_pos") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return ranked.withColumn(name, value).drop("_pos", "_n")


def lowest_fraction(df: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Rank in 0..1 in which equal values share the lowest place."""
    if hot_groups(df, keys, hot_limit(df)).isEmpty():
        return df.withColumn(name, F.percent_rank().over(W.partitionBy(*keys).orderBy(value)))
    tagged = df.withColumn("_value", value)
    hist = tagged.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_copies"))
    ranked = positions(hist, keys, [F.col("_value")], "_pos", "_n", weight="_copies")
    back = join_null_safe(
        tagged, ranked.select(*keys, "_value", "_pos", "_n"), [*keys, "_value"], "inner"
    )
    rank = (F.col("_pos") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return back.withColumn(name, rank).drop("_value", "_pos", "_n")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float], weight: str | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per group.

    Small groups use the built-in exact percentile. A hot group is first reduced
    to its distinct values with counts and the two neighbours of each quantile
    are picked by position, so no task ever holds the whole group. ``weight``
    counts a row several times.
    """
    keys = list(keys)
    held = df.where(F.col(value).isNotNull()).select(*keys, value, *([weight] if weight else []))
    probe = sized_by if sized_by is not None else held
    if hot_groups(probe, keys, hot_limit(df)).isEmpty():
        times = F.col(weight) if weight else F.lit(1)
        return held.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(q), times).alias(name) for name, q in fractions.items()]
        )
    copies = F.sum(weight) if weight else F.count(F.lit(1))
    hist = held.groupBy(*keys, value).agg(copies.alias("_copies")).where(F.col("_copies") > 0)
    ranked = positions(hist, keys, [F.col(value)], "_pos", "_n", weight="_copies")
    return pick_quantiles(ranked, keys, value, fractions)


def pick_quantiles(ranked: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """Quantiles from numbered values (``_pos``, ``_copies``, ``_n``) by conditional aggregation."""
    first, last = F.col("_pos") - 1, F.col("_pos") + F.col("_copies") - 2
    aggs = []
    for name, q in fractions.items():
        at = F.lit(q) * (F.col("_n") - 1)
        for tag, where in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when(where.between(first, last), F.col(value))).alias(f"_{name}_{tag}"))
    picked = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    columns = []
    for name, q in fractions.items():
        at = F.lit(q) * (F.col("_n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *columns)


def quantiles_without(
    df: DataFrame, keys: Sequence[str], unit: str, value: str, tie: Sequence[str], fractions: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles of each group with one unit left out, for every unit.

    Equal values of a unit are counted first, so what is sorted are the distinct values of the units. Leaving out a unit
    shifts the wanted position by the number of its rows that come before it, so each (unit, quantile) needs one lookup by
    position instead of another pass over the other units. Positions are looked up by blocks; the sorted values are never
    broadcast, since their size is not seen before they exist. ``tie`` may name columns that tell equal values apart; the
    quantiles do not depend on them.
    """
    keys = list(keys)
    hist = df.groupBy(*keys, unit, value).agg(F.count(F.lit(1)).alias("_copies"))
    ranked = cut_lineage(positions(hist, keys, [F.col(value), F.col(unit)], "_pos", "_n", weight="_copies"))
    own = positions(ranked, [*keys, unit], [F.col("_pos")], "_own", "_rows", weight="_copies")
    wanted = F.explode(
        F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in fractions.items()])
    )
    left = F.col("_n") - F.col("_rows")
    spec = own.where(left > 0).select(*keys, unit, "_pos", "_own", "_n", "_rows", "_copies", wanted.alias("_w")).select(
        "*", F.col("_w.name").alias("_name"), (F.col("_w.q") * (left - 1)).alias("_at")
    )
    for tag, where in (("lo", F.floor("_at")), ("hi", F.ceil("_at"))):
        spec = spec.withColumn(f"_{tag}", where)
    # rows of the unit that sit before the wanted place of the remaining rows
    before = {
        tag: F.sum(F.when(F.col("_pos") - F.col("_own") + 1 <= F.col(f"_{tag}") + 1, F.col("_copies")).otherwise(0)) for tag in ("lo", "hi")
    }
    places = spec.groupBy(*keys, unit, "_name", "_at", "_lo", "_hi").agg(
        before["lo"].alias("_blo"), before["hi"].alias("_bhi")
    )
    places = places.select(
        *keys, unit, "_name", (F.col("_at") - F.col("_lo")).alias("_part"),
        F.explode(F.array(
            F.struct(F.lit("lo").alias("tag"), (F.col("_lo") + 1 + F.col("_blo")).alias("p")),
            F.struct(F.lit("hi").alias("tag"), (F.col("_hi") + 1 + F.col("_bhi")).alias("p")),
        )).alias("_t"),
    ).select("*", F.col("_t.tag").alias("_tag"), F.col("_t.p").alias("_p"), F.floor(F.col("_t.p") / PLACES).alias("_block"))
    last = F.col("_pos") + F.col("_copies") - 1
    spans = ranked.select(*keys, "_pos", last.alias("_last"), value, F.explode(F.sequence(F.floor(F.col("_pos") / PLACES), F.floor(last / PLACES))).alias("_block"))
    found = join_null_safe(places, spans.hint("merge"), [*keys, "_block"], "inner").where(F.col("_p").between(F.col("_pos"), F.col("_last")))
    low = F.max(F.when(F.col("_tag") == "lo", F.col(value)))
    high = F.max(F.when(F.col("_tag") == "hi", F.col(value)))
    each = found.groupBy(*keys, unit, "_name").agg((low + (high - low) * F.max("_part")).alias("_q"))
    return each.groupBy(*keys, unit).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in fractions]
    )


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregated with map-side combine and joined back: Spark broadcasts the small
    side when its size allows and splits skewed keys of the large side.
    """
    table = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return join_null_safe(df, table, keys, "left")


def robust_z(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """clip((v - median) / max(q75 - q25, 1e-6), -8, 8) for several columns at once.

    Groups below the limit are scaled by windows over their keys, one shuffle of the rows for all columns and none if
    they already lie by the keys. With a hot group the columns are turned into rows, whose quantiles need no whole group.
    """
    keys = list(keys)
    if hot_groups(df, keys, hot_limit(df)).isEmpty():
        group = W.partitionBy(*keys)
        thirds = F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])
        out = df.withColumns({f"_q_{c}": F.percentile(F.col(c).cast("double"), thirds).over(group) for c in columns})
        out = out.withColumns({name: _clipped(F.col(c), *[F.get(f"_q_{c}", F.lit(i)) for i in range(3)]) for c, name in columns.items()})
        return out.drop(*[f"_q_{c}" for c in columns])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in columns])
    )
    long = df.select(*keys, pairs.alias("_p")).select(*keys, "_p._name", "_p._v")
    stats = quantiles(long, [*keys, "_name"], "_v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    wide = stats.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_name") == c, F.col(q))).alias(f"_{q}_{c}")
            for c in columns
            for q in ("q25", "q50", "q75")
        ]
    )
    out = join_null_safe(df, wide, keys, "left")
    for source, name in columns.items():
        out = out.withColumn(name, _clipped(F.col(source), *[F.col(f"_{q}_{source}") for q in ("q25", "q50", "q75")]))
    return out.drop(*[f"_{q}_{c}" for c in columns for q in ("q25", "q50", "q75")])


def _clipped(value: Column, low: Column, middle: Column, high: Column) -> Column:
    z = (value - middle) / F.greatest(high - low, F.lit(1e-6))
    return F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, pos: str | None = None) -> DataFrame:
    """First ``k`` rows of each group.

    Up to k = 1000 Spark limits each group on the map side (WindowGroupLimit) before the shuffle. Above that the
    group is first cut to ``k`` rows in each of 64 salted parts, so a hot group is sorted by as many tasks and the
    last one sees at most 64 k of its rows.
    """
    name = pos or "_pos"
    if k > MAP_SIDE_K:
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
        df = df.withColumn("_place", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_place") <= k).drop("_salt", "_place")
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= k)
    return out if pos else out.drop(name)
