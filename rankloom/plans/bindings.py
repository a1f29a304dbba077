"""The given tables seen as candidates, mode results, content groups, points, voxels.

Each view exists twice: as a DataFrame and as a SQL common table expression, so a
query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..operators.grouping import positions

GROUP = ["case_id", "jaw"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rotation_z(angle_deg: Column, sign: Column, shift: list[Column]) -> Column:
    """Rotation about z by an angle, first column times ``sign``, plus a shift."""
    c, s = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    zero, one = F.lit(0.0), F.lit(1.0)
    return M.from_parts([c * sign, -s, zero, s * sign, c, zero, zero, zero, one], shift)


def rotation_z_sql(angle: str, sign: str, x: str, y: str, z: str) -> str:
    c, s = f"cos(radians({angle}))", f"sin(radians({angle}))"
    zero, one = "0.0::DOUBLE", "1.0::DOUBLE"
    return (
        f"[{c}*{sign}, -{s}, {zero}, {x}, {s}*{sign}, {c}, {zero}, {y}, "
        f"{zero}, {zero}, {one}, {z}, {zero}, {zero}, {zero}, {one}]"
    )


ROW_ORDER = (
    "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
    "l_discount", "l_tax", "l_returnflag", "l_shipdate",
)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One scored alternative per lineitem, grouped by (part, line status)."""
    rows = table(spark, folder, "lineitem").withColumn(
        "jaw", F.when(F.col("l_linestatus") == "O", "upper").otherwise("lower")
    )
    rows = positions(rows, ["l_partkey", "jaw"], [F.col(c) for c in ROW_ORDER], pos="_pos")
    side = F.pmod("l_suppkey", F.lit(3))
    return rows.select(
        F.col("l_partkey").alias("case_id"),
        "jaw",
        (F.col("_pos") - 1).alias("candidate_index"),
        F.col("l_returnflag").alias("candidate_run"),
        F.col("l_quantity").alias("selection_score_mm"),
        (F.col("l_extendedprice") / 10000.0).alias("fit_score_mm"),
        (F.col("l_tax") * 100.0).alias("fit_p90_mm"),
        (F.col("l_discount") * 10.0).alias("target_coverage_2mm"),
        (F.col("l_discount") * 100.0).alias("mean_tre_mm"),
        F.concat(
            F.when(F.pmod("l_suppkey", F.lit(4)) == 0, "adaptive_")
            .when(F.pmod("l_suppkey", F.lit(4)) == 1, "aggregate_")
            .when(F.pmod("l_suppkey", F.lit(8)) == 2, "axial_lower_")
            .otherwise("component_"),
            F.col("l_linenumber").cast("string"),
        ).alias("target"),
        F.when(side == 0, "full").when(side == 1, "pca_low_0.25").otherwise("pca_high_0.50").alias("source_variant"),
        (1000.0 + F.col("l_linenumber") * 75.0).alias("threshold"),
        F.when(F.pmod("l_suppkey", F.lit(5)) == 0, -1).otherwise(1).alias("chirality"),
        (F.col("l_linenumber") * 10.0 + F.col("l_discount") * 100.0).alias("turn_deg"),
        F.pmod("l_suppkey", F.lit(2)).cast("int").alias("prior_accepted"),
        "l_orderkey",
    )


CANDIDATES_SQL = """cand AS (
  SELECT l_partkey AS case_id,
    CASE WHEN l_linestatus = 'O' THEN 'upper' ELSE 'lower' END AS jaw,
    row_number() OVER (PARTITION BY l_partkey, CASE WHEN l_linestatus = 'O' THEN 'upper' ELSE 'lower' END
      ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount,
               l_tax, l_returnflag, l_shipdate) - 1 AS candidate_index,
    l_returnflag AS candidate_run, l_quantity AS selection_score_mm,
    l_extendedprice / 10000.0::DOUBLE AS fit_score_mm,
    l_tax * 100.0::DOUBLE AS fit_p90_mm, l_discount * 10.0::DOUBLE AS target_coverage_2mm,
    l_discount * 100.0::DOUBLE AS mean_tre_mm,
    CASE WHEN l_suppkey % 4 = 0 THEN 'adaptive_' WHEN l_suppkey % 4 = 1 THEN 'aggregate_'
         WHEN l_suppkey % 8 = 2 THEN 'axial_lower_' ELSE 'component_' END || l_linenumber AS target,
    CASE l_suppkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'pca_low_0.25' ELSE 'pca_high_0.50' END AS source_variant,
    1000.0::DOUBLE + l_linenumber * 75.0::DOUBLE AS threshold,
    CASE WHEN l_suppkey % 5 = 0 THEN -1 ELSE 1 END AS chirality,
    l_linenumber * 10.0::DOUBLE + l_discount * 100.0::DOUBLE AS turn_deg,
    (l_suppkey % 2)::INTEGER AS prior_accepted, l_orderkey
  FROM lineitem)"""


def posed(cand: DataFrame) -> DataFrame:
    """Candidates with their 4x4 matrix in ``transform``."""
    at = [F.col("selection_score_mm"), F.col("fit_p90_mm"), F.col("fit_score_mm")]
    return cand.withColumn("transform", rotation_z(F.col("turn_deg"), F.col("chirality"), at))


POSED_SQL = (
    "posed AS (SELECT *, "
    + rotation_z_sql("turn_deg", "chirality", "selection_score_mm", "fit_p90_mm", "fit_score_mm")
    + " AS transform FROM cand)"
)


def truths(spark: SparkSession, folder: str) -> DataFrame:
    """True matrix per case, from part."""
    size = F.col("p_size").cast("double")
    angle = F.pmod(F.col("p_retailprice"), F.lit(360.0))
    sign = F.when(F.pmod("p_partkey", F.lit(7)) == 0, -1.0).otherwise(1.0)
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("case_id"),
        rotation_z(angle, sign, [size, size / 2.0, size / 4.0]).alias("truth"),
    )


TRUTHS_SQL = (
    "truths AS (SELECT p_partkey AS case_id, "
    + rotation_z_sql(
        "p_retailprice % 360.0::DOUBLE",
        "(CASE WHEN p_partkey % 7 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)",
        "p_size::DOUBLE", "p_size / 2.0::DOUBLE", "p_size / 4.0::DOUBLE",
    )
    + " AS truth FROM part)"
)


def mode_results(spark: SparkSession, folder: str) -> DataFrame:
    """Mean translation and rotation error per (mode, case), from events."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("mode"), F.col("user_id").alias("case_id"))
        .agg(
            F.avg("value").alias("translation"),
            F.avg(F.get_json_object("props", "$.k").cast("double")).alias("rotation"),
        )
    )


MODES_SQL = """modes AS (
  SELECT event_type AS mode, user_id AS case_id, avg(value) AS translation,
         avg((props->>'$.k')::DOUBLE) AS rotation
  FROM events GROUP BY ALL)"""


def scan_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Which cases share one scan: three neighbouring users form a content group."""
    return table(spark, folder, "events").select(F.col("user_id").alias("case_id")).distinct().select(
        "case_id", F.concat(F.lit("g"), F.floor(F.col("case_id") / 3).cast("string")).alias("group_id")
    )


SCAN_GROUPS_SQL = """scans AS (
  SELECT DISTINCT user_id AS case_id, 'g' || (user_id // 3) AS group_id FROM events)"""


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their content hash; exact copies share a hash."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("case_id"), F.sha2("text", 256).alias("content_hash"),
        "lang", "source", "n_chars",
    )


CONTENTS_SQL = """contents AS (
  SELECT doc_id AS case_id, sha256(text) AS content_hash, lang, source, n_chars FROM documents)"""


def seed_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of each (customer = alternative) under each priority (= seed), by segment group."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(
        F.pmod("o_custkey", F.lit(50)).alias("case_id"),
        F.col("o_orderpriority").alias("seed"),
        F.col("o_custkey").alias("candidate_index"),
    ).agg(F.max("o_totalprice").alias("cost"))


SEEDS_SQL = """seeds AS (
  SELECT o_custkey % 50 AS case_id, o_orderpriority AS seed, o_custkey AS candidate_index,
         max(o_totalprice) AS cost FROM orders GROUP BY ALL)"""


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Points of labelled sets: the first three values of every embedding."""
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("set_id"),
        F.col("vec_id").alias("point_id"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")],
    )


POINTS_SQL = """points AS (
  SELECT label::VARCHAR AS set_id, vec_id AS point_id, embedding[1]::DOUBLE AS x,
         embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""


def voxels(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse grid rows: position from lineitem, values from the first row of each cell."""
    first = F.struct("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    cells = table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("case_id"),
        F.col("l_quantity").cast("int").alias("i"),
        F.col("l_linenumber").cast("int").alias("j"),
        F.pmod("l_suppkey", F.lit(20)).cast("int").alias("k"),
    ).agg(F.min(first).alias("_f"), F.count(F.lit(1)).alias("hits"))
    return cells.select(
        "case_id", "i", "j", "k", rounded(F.col("_f.l_discount") * 10000.0, 3).alias("hu"),
        rounded(F.col("_f.l_tax") * 6.0, 6).alias("p1"), rounded(F.col("_f.l_discount") * 5.0, 6).alias("p2"), "hits",
    )


VOXELS_SQL = """vox AS (
  SELECT case_id, i, j, k, round(f.d * 10000.0::DOUBLE, 3) AS hu, round(f.t * 6.0::DOUBLE, 6) AS p1, round(f.d * 5.0::DOUBLE, 6) AS p2, hits
  FROM (SELECT l_returnflag AS case_id, l_quantity::INTEGER AS i, l_linenumber::INTEGER AS j, (l_suppkey % 20)::INTEGER AS k,
    min({'o': l_orderkey, 'p': l_partkey, 'e': l_extendedprice, 'd': l_discount, 't': l_tax}) AS f, count(*) AS hits
  FROM lineitem GROUP BY ALL))"""


def with_sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(value: Column | str, digits: int) -> Column:
    """Half away from zero on the binary value, the rule the SQL twins use."""
    x = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    near = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
    return F.when(F.abs(x) < 1e12, near).otherwise(x)


def r6(value: Column | str) -> Column:
    """Results are rounded where sums could differ in the last bits."""
    return rounded(value, 6)


def rounded_udf(digits: Sequence[int]):
    """``rounded`` for all numbers of an array at once, to each of the digits in turn."""

    @F.arrow_udf("array<double>")
    def near(values):
        import numpy as np
        import pyarrow as pa

        flat = values.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float)
        for d in digits:
            scale = float(10**d)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.where(np.abs(x) < 1e12, np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale, x)
        offsets = values.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(x, mask=flat.is_null().to_numpy(zero_copy_only=False)))

    return near


def all_rounded(df: DataFrame, keep: Sequence[str], names: Sequence[str], *digits: int) -> DataFrame:
    """``keep`` and many rounded columns. One expression a column would be more code than the engine compiles."""
    held = df.select(*keep, rounded_udf(digits)(F.array(*names)).alias("_rounded"))
    return held.select(*keep, *[F.get("_rounded", F.lit(i)).alias(n) for i, n in enumerate(names)])
