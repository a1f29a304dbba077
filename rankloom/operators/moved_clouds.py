"""Nearest targets of moved point sets, for jobs that move the same sources again and again.

Sources and targets are put in blocks once. A set of no more targets than a hot group goes whole to the tasks that share its blocks of sources,
a copy for at most ROWS of them, and is searched there by runs and their boxes. Larger sets meet by blocks: a rigid move keeps a block together, so the
box of a moved block is found from its own box, blocks of targets that cannot matter are dropped by boxes, and a block of sources meets
the rest in one call of numpy.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import matrix as M
from ..session import cut_lineage
from .grouping import hot_limit, largest_group
from .spatial import _box_gap, array_size, into_blocks, merged, run_search

XYZ = ("x", "y", "z")
#: Points of a block of sources, and rows (a block of sources and the targets it meets) of a task.
SOURCES, ROWS = 512, 128
#: Targets whose distances a call of numpy holds at once.
AT_ONCE = 4096
#: Least blocks of sources that share a copy of their set's targets.
SHARED = 16


class Blocks(NamedTuple):
    """Blocks (set_id, blk, ids, at, lo0 to hi2) of all sets, written once, and the points of the largest set."""

    rows: DataFrame
    largest: int
    bounded: bool


def _blocks(points: DataFrame, largest: int, size: int) -> Blocks:
    bounded = largest <= hot_limit(points)
    dealt = into_blocks(points, ["set_id"], XYZ, ["point_id"], bounded=bounded, size=size)
    point = F.struct(F.col("point_id").alias("id"), F.array(*[F.col(c).cast("double") for c in XYZ]).alias("at"))
    ends = [f(c).alias(f"{n}{i}") for i, c in enumerate(XYZ) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    rows = dealt.groupBy("set_id", F.col("_blk").cast("long").alias("blk")).agg(F.sort_array(F.collect_list(point)).alias("_all"), *ends)
    held = [F.col("_all.id").alias("ids"), F.flatten("_all.at").alias("at")]
    return Blocks(cut_lineage(rows.select("set_id", "blk", *held, *[f"{n}{i}" for i in range(3) for n in ("lo", "hi")])), largest, bounded)


def source_blocks(source: DataFrame | Blocks) -> Blocks:
    if isinstance(source, Blocks):
        return source
    return _blocks(source.select("set_id", "point_id", *XYZ), largest_group(source, ["set_id"]), SOURCES)


def target_blocks(target: DataFrame | Blocks) -> Blocks:
    """Equal coordinates are one target, with the lowest id."""
    if isinstance(target, Blocks):
        return target
    distinct = merged(target.select("set_id", "point_id", *XYZ), ["set_id"], list(XYZ), "point_id").drop("_w")
    return _blocks(distinct, largest_group(target, ["set_id"]), array_size(XYZ))


def _moved_box() -> list[Column]:
    """Ends of a box that holds the moved box, a little wider than rounding asks for."""
    m = [F.col("transform")[i] for i in range(16)]
    mid = [(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2.0 for i in range(3)]
    half = [(F.col(f"hi{i}") - F.col(f"lo{i}")) / 2.0 for i in range(3)]
    out = []
    for i, at in enumerate(M.apply_point("transform", *mid)):
        wide = sum((F.abs(m[4 * i + j]) * half[j] for j in (1, 2)), F.abs(m[4 * i]) * half[0])
        size = sum((F.abs(m[4 * i + j] * mid[j]) for j in (1, 2)), F.abs(m[4 * i] * mid[0])) + F.abs(m[4 * i + 3])
        wide = wide + (wide + size) * 1e-12
        out += [(at - wide).alias(f"qlo{i}"), (at + wide).alias(f"qhi{i}")]
    return out


def nearest_udf():
    """Squared distance, moved point and nearest target of each point of a block; ties go to the target with the lowest id."""
    names = ("sq", "x", "y", "z", "u", "v", "w")

    @F.pandas_udf(", ".join(f"{n} array<double>" for n in names))
    def closest(at, transform, ids, targets):
        import numpy as np
        import pandas as pd

        out = {n: [] for n in names}
        for own, m, named, other in zip(at, transform, ids, targets):
            x, y, z = own.reshape(-1, 3).astype(float).T
            moved = [m[r] * x + m[r + 1] * y + m[r + 2] * z + m[r + 3] for r in (0, 4, 8)]
            goal = other.reshape(-1, 3).astype(float)[np.argsort(named, kind="stable")]
            best, place = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
            for start in range(0, len(goal), AT_ONCE):
                part, sq = goal[start:start + AT_ONCE], 0.0
                for i in range(3):
                    gap = moved[i][:, None] - part[:, i]
                    gap *= gap
                    sq = gap if i == 0 else sq + gap
                sq[np.isnan(sq)] = np.inf
                first = sq.argmin(1)
                least = sq[np.arange(len(x)), first]
                nearer = least < best
                best, place = np.where(nearer, least, best), np.where(nearer, first + start, place)
            for n, v in zip(names, (best, *moved, *goal[place].T)):
                out[n].append(np.ascontiguousarray(v))
        return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in out.items()})

    return closest


def search(kind):
    """Function of (rows of job_id, set_id, transform, ids, at; rows of tids, tat of the set) that gives each moved point its nearest target, see ``run_search``."""
    index = run_search()

    def found(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        names = pa.concat_arrays([c.flatten() for c in right.column("tids").chunks])
        whole = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in right.column("tat").chunks]).astype(float).reshape(-1, 3)
        rank = np.empty(len(whole), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(whole))
        nearest, lowest = index(whole, rank), int(rank.argmin())
        columns = []
        for job, of, m, ids, at in zip(*(left.column(c) for c in ("job_id", "set_id", "transform", "ids", "at")), strict=True):
            x, y, z = at.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3).T
            m = m.as_py()
            moved = np.stack([m[r] * x + m[r + 1] * y + m[r + 2] * z + m[r + 3] for r in (0, 4, 8)])
            place, best = nearest(moved.T, 4)
            goals = whole[np.where(place < 0, lowest, place)]
            gap = np.sqrt(best)
            columns.append([pa.array([job.as_py()] * len(x), kind.field(0).type), pa.array([of.as_py()] * len(x), kind.field(1).type), ids.values,
                            pa.array(gap, mask=~(gap < np.inf)), *map(pa.array, (*moved, *goals.T))])
        return pa.Table.from_arrays([pa.chunked_array(list(c), t) for c, t in zip(zip(*columns, strict=True), kind.types, strict=True)], schema=kind)

    return found


def meet_whole(jobs: DataFrame, each: DataFrame, own: DataFrame, source: Blocks, target: Blocks) -> DataFrame:
    """``meet`` for sets whose targets one task may hold: blocks of sources are dealt over parts of a set, and each part gets one copy of its targets."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    a_job = -(-max(source.largest, 1) // SOURCES)
    cores = jobs.sparkSession.sparkContext.defaultParallelism
    blocks = jobs.count() * a_job
    rows = max(SHARED, min(ROWS, blocks // (4 * cores)))
    tasks = max(1, min(4 * cores, blocks // SHARED), blocks // ROWS)
    parts = jobs.groupBy("set_id").agg(F.ceil(F.count(F.lit(1)) * a_job / rows).cast("long").alias("_parts"))
    keys = ["_set", "_part"]
    moved = each.join(F.broadcast(parts), "set_id").join(own.select("_source", "sb", "ids", "at"), "_source")
    goals = target.rows.select("set_id", F.col("ids").alias("tids"), F.col("at").alias("tat")).join(F.broadcast(parts), "set_id")
    goals = goals.select(F.col("set_id").alias("_set"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), "tids", "tat")
    point = source.rows.schema["ids"].dataType.elementType
    kind = StructType([StructField(n, t) for n, t in (("job_id", jobs.schema["job_id"].dataType), ("set_id", jobs.schema["set_id"].dataType), ("point_id", point),
                                                      *[(c, DoubleType()) for c in ("distance", *XYZ, "u", "v", "w")])])
    moved = moved.select(F.col("set_id").alias("_set"), F.pmod(F.xxhash64("job_id", "sb"), F.col("_parts")).alias("_part"), "job_id", "set_id", "transform", "ids", "at")
    moved = moved.repartition(tasks, *keys).groupBy(*keys)
    return moved.cogroup(goals.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(search(to_arrow_schema(kind)), kind)


def meet(jobs: DataFrame, source: Blocks, target: Blocks) -> DataFrame:
    """Moved points of all jobs and their nearest targets: (job_id, set_id, point_id, distance, x, y, z, u, v, w).

    ``jobs`` (job_id, set_id, transform; with source_id the source is that set) is read several times. A job whose set has no target has no row;
    a distance that cannot be told is null.
    """
    link = F.col("source_id" if "source_id" in jobs.columns else "set_id").alias("_source")
    each = jobs.select("job_id", "set_id", "transform", link)
    own = source.rows.withColumnsRenamed({"set_id": "_source", "blk": "sb"})
    if target.bounded:
        return meet_whole(jobs, each, own, source, target)
    ends = [f"{n}{i}" for i in range(3) for n in ("lo", "hi")]
    boxes = each.join(own.select("_source", "sb", *ends), "_source").select("job_id", "set_id", "sb", *_moved_box())
    other = target.rows.select("set_id", F.col("blk").alias("tb"), *[F.col(e).alias(f"t{e}") for e in ends])
    near, far = _box_gap(3)
    pairs = boxes.join(other, "set_id").select("job_id", "set_id", "sb", "tb", near.alias("_near"), far.alias("_far"))
    # few bytes stand for much work, so blocks are dealt by number and not by their size
    blocks = jobs.count() * -(-max(source.largest, 1) // SOURCES)
    tasks = max(2 * jobs.sparkSession.sparkContext.defaultParallelism, blocks // ROWS)
    if blocks <= tasks:
        tasks = max(1, blocks)
    pairs = pairs.repartition(tasks, "job_id", "sb").withColumn("_best", F.min("_far").over(W.partitionBy("job_id", "sb"))).where(F.col("_near") <= F.col("_best"))
    goals = pairs.select("job_id", "set_id", "sb", "tb").join(target.rows.select("set_id", F.col("blk").alias("tb"), "ids", "at"), ["set_id", "tb"])
    goals = goals.groupBy("job_id", "sb").agg(F.collect_list(F.struct("ids", "at")).alias("_t"))
    moved = each.join(own.select("_source", "sb", "ids", "at"), "_source")
    met = moved.join(goals, ["job_id", "sb"]).repartition(tasks, "job_id", "sb")
    found = met.select("job_id", "set_id", "ids", nearest_udf()("at", "transform", F.flatten("_t.ids"), F.flatten("_t.at")).alias("_f"))
    names = ("sq", "x", "y", "z", "u", "v", "w")
    rows = found.select("job_id", "set_id", "ids", *[F.col(f"_f.{n}").alias(n) for n in names]).select(
        "job_id", "set_id", F.explode(F.arrays_zip("ids", *names)).alias("_e"))
    gap = F.when(F.col("_e.sq") < float("inf"), F.sqrt("_e.sq")).alias("distance")
    return rows.select("job_id", "set_id", F.col("_e.ids").alias("point_id"), gap, *[F.col(f"_e.{n}").alias(n) for n in names[1:]])
