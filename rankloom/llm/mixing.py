"""Mixing of sources to target weights, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import WORD, table
from rankloom.session import cut_lineage

EPOCHS = 3
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with the words that each source is to give.

    Sources in the order of code points, null last, weigh ``weights`` repeating and share all words. The
    level L with sum(min(weight * L, epochs * size)) = total is found in rounds: sources beyond their
    ceiling are set to it and L is computed anew for the others. Only three sums a round reach the driver;
    the table has one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = cut_lineage(sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * epochs))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = None, F.lit(False)
    while True:
        row = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("ceiling"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
                         F.count(F.when(full, 1))).first()
        if not row[1]:
            break
        level = (total - row[0]) / row[1]
        full = F.col("weight") * F.lit(level) > F.col("ceiling")
        if ranked.filter(full).count() == row[2]:
            break
    share = F.col("weight") * F.lit(level) if level is not None else F.lit(0.0)
    target = F.least(share, F.col("ceiling").cast("double"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def mix(documents: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, text: str = "text",
        id_column: str = "doc_id", bucket_rows: int = 2_000, extra: Column | None = None) -> DataFrame:
    """Sizes, targets and the words taken of every row: (doc_id, size, source, source_size, target, taken, key).

    Rows get a random key from a digest of (seed, id), so a rerun takes the same ones. Within a source, rows in
    the order of the key are cut where the running sum of sizes meets the source's budget (its target,
    rounded down): whole epochs of all rows, then one partial epoch whose last row is taken in part.
    Running sums are distributed: keys fall into ranges of about ``bucket_rows`` rows, range totals are
    summed up first, and rows are ordered within a range only. So one source with a third of all rows is
    spread like any other. Null texts have size 0; null sources are one source of their own; null or repeated
    ids share a key and are ordered by size, which makes equal rows interchangeable. An empty table
    gives no rows. Columns of the table other than
    these are not read; ``extra`` is carried along as key.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))
    carried = F.lit(None).cast("long") if extra is None else extra
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col("source").alias("source"), word_count(F.col(text)).alias("size"), key.alias("random"),
                            carried.alias("key"))
    rows = cut_lineage(rows)
    ranges = max(1, rows.count() // bucket_rows)
    spread = F.conv(F.substring("random", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(spread * ranges / F.lit(float(1 << 32))).cast("int"))
    totals = cut_lineage(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    targets = source_targets(totals.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, epochs)
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.withColumn("before", F.coalesce(before, F.lit(0))).alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    offsets = offsets.select(F.col("o.source").alias("o_source"), F.col("range").alias("o_range"), "before", "source_size", "target")
    own = F.sum("size").over(Window.partitionBy("source", "range").orderBy("random", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("own", F.coalesce(own, F.lit(0)))
    placed = placed.join(offsets, placed.source.eqNullSafe(offsets.o_source) & (placed.range == offsets.o_range))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before") + F.col("own"))))
    taken = (whole * F.col("size") + part).cast("long")
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "key")


def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {"op4_mix": r"""
    WITH rows AS (
      SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5(CASE WHEN doc_id IS NULL THEN '7' ELSE '7:' || CAST(doc_id AS VARCHAR) END) AS key FROM documents
    ), sources AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM rows GROUP BY source
    ), ordered AS (
      SELECT *, 3 * source_size AS ceiling,
             row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place FROM sources
    ), running AS (
      SELECT *, coalesce(sum(ceiling) OVER before, 0) AS full_before, (SELECT sum(source_size) FROM sources) AS total,
             (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER before, 0) AS open_weight
      FROM ordered WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), leveled AS (
      SELECT min_by(CAST(total - full_before AS DOUBLE) / CAST(open_weight AS DOUBLE), place) AS level FROM running
      WHERE weight * (CAST(total - full_before AS DOUBLE) / CAST(open_weight AS DOUBLE)) <= ceiling
    ), targets AS (
      SELECT source, source_size, least(weight * coalesce(level, 0), CAST(ceiling AS DOUBLE)) AS target FROM ordered, leveled
    ), placed AS (
      SELECT r.doc_id, r.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS whole,
             coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - start)) AS BIGINT) AS taken
    FROM placed"""}
