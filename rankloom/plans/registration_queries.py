"""Batch alignment over the point view."""

from __future__ import annotations

from pyspark.sql import functions as F

import uuid

from ..functions import matrix as M
from ..operators import generation as G
from ..operators import registration as R
from ..session import shared_folder
from ..sources.stages import Stages, cached_bundles
from .bindings import CANDIDATES_SQL, GROUP, candidates, contents, CONTENTS_SQL, points, r6, rotation_z, rounded, table, with_sql
from .registry import query


def clouds(spark, folder):
    """Target: the points of a set. Source: the same points turned by 6 degrees and shifted."""
    target = points(spark, folder)
    back = rotation_z(F.lit(6.0), F.lit(1.0), [F.lit(0.02), F.lit(-0.03), F.lit(0.01)])
    at = M.apply_point("_m", F.col("x"), F.col("y"), F.col("z"))
    source = target.withColumn("_m", back).select("set_id", "point_id", *[a.alias(c) for a, c in zip(at, "xyz")])
    return source, target


def identity_jobs(target):
    unit = rotation_z(F.lit(0.0), F.lit(1.0), [F.lit(0.0)] * 3)
    return target.select("set_id").distinct().select(F.col("set_id").alias("job_id"), "set_id", unit.alias("transform"))


@query("axes_starts")
def axes_starts(spark, folder):
    source, target = clouds(spark, folder)
    out = R.axes_starts(source, target, (1, -1)).withColumn("broken", M.contract_violations("transform", 1e-6))
    return out.groupBy("set_id", "parity").agg(F.count(F.lit(1)).alias("starts"), F.sum("broken").alias("broken"),
                                              F.sum(M.det_sign("transform")).alias("signs"))


@query("trimmed_alignment")
def trimmed_alignment(spark, folder):
    source, target = clouds(spark, folder)
    out = R.trimmed_alignment(identity_jobs(target), source, target, (0.3, 0.1), 3, least=16)
    out = R.score_jobs(out, source, target)
    return out.select("set_id", "correspondences", rounded("score", 5).alias("score"), rounded("p90", 5).alias("p90"))


@query("basin_search")
def basin_search(spark, folder):
    source, target = clouds(spark, folder)
    out = R.basin_search(identity_jobs(target), source, target, 12, ((6.0, 0.03),), 2, (0.2, 0.1), 2, least=16)
    return out.select("job_id", "correspondences", rounded("score", 5).alias("score"))


@query("support_refinement")
def support_refinement(spark, folder):
    source, target = clouds(spark, folder)
    out = R.support_refinement(identity_jobs(target), source, target, (("tight", (0.2, 0.1), 0.5),), 2, alphas=(0.5, 1.0), gain=0.0005, least=16)
    return out.select("start_id", "profile", "alpha", *[rounded(c, 5).alias(c) for c in ("trim20", "initial_trim20", "improvement_mm", "angle_deg")])


@query("full_geometry")
def full_geometry(spark, folder):
    source, target = clouds(spark, folder)
    out = R.full_geometry(identity_jobs(target), source, target, normal_radius=0.15)
    return out.select("set_id", *[r6(c).alias(c) for c in ("full_trim_10", "full_trim_20", "full_trim_35", "median", "p90", "normal_abs_cosine")])


@query("register_and_rank")
def register_and_rank(spark, folder):
    """Both parities and all starts of every set, the best two of each parity aligned and ranked."""
    source, target = clouds(spark, folder)
    out = R.register(source, target, (1, -1), 2, None, (0.4, 0.1), 2, 16, samples=(24, 96))
    return out.select("set_id", "rank", "parity", "method", "correspondences", rounded("score", 5).alias("score"))


@query("candidate_generation")
def candidate_generation(spark, folder):
    """All sources of every set against its targets in committed stages, two variants of a source and two targets."""
    source, target = clouds(spark, folder)
    upper = F.pmod("point_id", F.lit(2)) == 0
    sources = source.withColumn("variant", F.lit("full")).unionByName(source.where(upper).withColumn("variant", F.lit("half")))
    targets = target.withColumn("target", F.lit("component")).unionByName(target.where(F.col("z") >= 0).withColumn("target", F.lit("aggregate")))
    wanted = target.select("set_id").distinct()
    plan = G.Plan(parities=(1,), refine=1, schedule=(0.4, 0.1), rounds=2, least=8)
    made = G.generate(wanted, sources, targets, f"{shared_folder(spark)}/generation-{uuid.uuid4().hex}", plan)
    return made.candidates.select("set_id", "target", "variant", "method", "unsupervised_rank", *[rounded(c, 5).alias(c) for c in ("selection_score_mm", "fit_score_mm")])


PAIRED_SQL = """qs AS (SELECT case_id AS query_id, CASE WHEN n_chars % 2 = 0 THEN 'upper' ELSE 'lower' END AS jaw, content_hash AS d, 'p' || (case_id % 40) AS e FROM contents),
es AS (SELECT case_id AS entry_id, CASE WHEN n_chars % 2 = 0 THEN 'upper' ELSE 'lower' END AS jaw, content_hash AS d, 'p' || (case_id % 56) AS e, (case_id % 30) / 10.0::DOUBLE AS mm FROM contents WHERE case_id % 20 <> 7)"""


@query("surface_content_pairs", with_sql(CONTENTS_SQL, PAIRED_SQL, body="""
SELECT query_id, entry_id, max(k) AS match_kind FROM (SELECT query_id, entry_id, 'raw' AS k FROM qs JOIN es ON qs.jaw = es.jaw AND qs.d = es.d WHERE mm <= 1.5
  UNION ALL SELECT query_id, entry_id, 'payload' FROM qs JOIN es ON qs.jaw = es.jaw AND qs.e = es.e WHERE mm <= 1.5) GROUP BY ALL"""))
def surface_content_pairs(spark, folder):
    rows = contents(spark, folder).withColumn("jaw", F.when(F.pmod("n_chars", F.lit(2)) == 0, "upper").otherwise("lower"))
    tag = F.concat(F.lit("P"), F.pmod("case_id", F.lit(40)).cast("string"))
    queries = rows.select(F.col("case_id").alias("query_id"), "jaw", F.upper("content_hash").alias("raw_digest"), tag.alias("payload_digest"))
    entries = rows.where(F.pmod("case_id", F.lit(20)) != 7).select(
        F.col("case_id").alias("entry_id"), "jaw", F.col("content_hash").alias("raw_digest"),
        F.concat(F.lit("p"), F.pmod("case_id", F.lit(56)).cast("string")).alias("payload_digest"), (F.pmod("case_id", F.lit(30)) / 10.0).alias("predicted_mm"))
    return G.content_pairs(queries, entries, 1.5)


@query("surface_gates", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, entry_id, round(score, 6) AS score, round(p90, 6) AS p90 FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY mm + p90, score, p90, mm, entry_id) AS r FROM (
    SELECT case_id, jaw, candidate_index AS entry_id, mean_tre_mm / 10 AS mm, fit_score_mm / 10 AS score, fit_p90_mm / 8 AS median, fit_p90_mm / 4 AS p90,
      1 - target_coverage_2mm / 10 AS within_2, 1 - threshold / 20000 AS coverage_2 FROM cand)
  WHERE score <= 0.8 AND median <= 1.0 AND p90 <= 2.0 AND within_2 >= 0.95 AND coverage_2 >= 0.92) WHERE r = 1"""))
def surface_gates(spark, folder):
    rows = candidates(spark, folder).select(
        F.struct(*GROUP).alias("query_id"), F.col("candidate_index").alias("entry_id"), (F.col("mean_tre_mm") / 10).alias("predicted_mm"), (F.col("fit_score_mm") / 10).alias("score"),
        (F.col("fit_p90_mm") / 8).alias("median"), (F.col("fit_p90_mm") / 4).alias("p90"), (1 - F.col("target_coverage_2mm") / 10).alias("within_2"),
        (1 - F.col("threshold") / 20000).alias("coverage_2"))
    out = G.gated_matches(rows, G.MatchLimits(coverage=0.92))
    return out.select("query_id.case_id", "query_id.jaw", "entry_id", r6("score").alias("score"), r6("p90").alias("p90"))


@query("surface_matches")
def surface_matches(spark, folder):
    """Poses of all sets from the known poses of sets with the same scan: each set is an entry, moved and thinned it is a query."""
    source, target = clouds(spark, folder)
    known = target.select("set_id").distinct()
    unit = rotation_z(F.lit(0.0), F.lit(1.0), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    columns = (F.lit("upper").alias("jaw"), F.col("set_id").alias("raw_digest"), F.lit(None).cast("string").alias("payload_digest"))
    entries = known.select(F.col("set_id").alias("entry_id"), *columns, F.lit(0.2).alias("predicted_mm"), unit.alias("transform"))
    queries = known.select(F.col("set_id").alias("query_id"), *columns)
    limits = G.MatchLimits(refine=2, least=8)
    out = G.surface_matches(queries, source.withColumnRenamed("set_id", "query_id"), entries, target.withColumnRenamed("set_id", "entry_id"), limits, (0.4, 0.1), 2)
    return out.select("query_id", "entry_id", "match_kind", rounded("score", 5).alias("score"), rounded("p90", 5).alias("p90"))


@query("bundle_cache", """SELECT l_orderkey, l_linenumber, l_suppkey, lines, round(total, 2) AS total FROM lineitem JOIN (
  SELECT l_returnflag, l_linenumber, count(*) AS lines, sum(l_quantity) AS total FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linenumber)""")
def bundle_cache(spark, folder):
    """A target of each (flag, mode), built once and joined to all requests; the second call finds all of them in the store."""
    lines = table(spark, folder, "lineitem")
    store, content, settings = Stages(spark, f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}", strict=False), ["l_returnflag", "l_linenumber"], {"points": 8}

    def build(missing):
        return lines.join(missing, content).groupBy("bundle_key").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("total"))

    cached_bundles(store, lines, content, settings, build)
    keyed, bundles = cached_bundles(store, lines, content, settings, lambda missing: missing.select("no bundle is missing"))
    return keyed.join(bundles, "bundle_key").select("l_orderkey", "l_linenumber", "l_suppkey", "lines", rounded("total", 2).alias("total"))
