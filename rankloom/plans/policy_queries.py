"""Policies, overrides, recorded scores and a saved ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import policies as P
from .bindings import CANDIDATES_SQL, GROUP, candidates, r6, table, with_sql
from .feature_queries import FEATURES, ID, training_rows
from .registry import query
from .source_queries import scratch


@query("policy_faults", """
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN (o_custkey * 200)::VARCHAR WHEN 2 THEN '2.5' WHEN 3 THEN 'true' END AS budget,
  CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'true' END AS refine, (o_custkey % 3) || '.' || (o_custkey % 10) AS alpha, o_custkey % 3 > 1 OR o_custkey % 3 = 1 AND o_custkey % 10 > 0 AS beyond FROM orders)
SELECT o_orderkey, 'budget' AS setting, budget AS value FROM p WHERE budget IS NOT NULL AND NOT (regexp_full_match(budget, '[0-9]+') AND coalesce(TRY_CAST(budget AS BIGINT), 0) BETWEEN 1 AND 10000)
UNION ALL SELECT o_orderkey, 'refine', refine FROM p WHERE refine NOT IN ('true', 'false')
UNION ALL SELECT o_orderkey, 'alpha', alpha FROM p WHERE beyond""")
def policy_faults(spark, folder):
    key = F.col("o_orderkey")
    text = (F.when(key % 5 == 0, "0").when(key % 5 == 1, (F.col("o_custkey") * 200).cast("string")).when(key % 5 == 2, "2.5").when(key % 5 == 3, "true"))
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias("budget"), F.when(key % 3 == 0, "yes").otherwise("true").alias("refine"),
                                                 F.concat((F.col("o_custkey") % 3).cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string")).alias("alpha"))
    return P.policy_faults(rows, ["o_orderkey"], ["budget"], ["refine"], ["alpha"])


@query("resolved_settings", """
SELECT c_custkey, coalesce(n.threshold, 0.5::DOUBLE) AS threshold, coalesce(n.minimum, 64) AS minimum FROM customer
LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 10.0::DOUBLE END AS threshold, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS minimum
  FROM nation WHERE n_nationkey < 20) n ON n_nationkey = c_nationkey""")
def resolved_settings(spark, folder):
    key = F.col("n_nationkey")
    own = table(spark, folder, "nation").where(key < 20).select(key.alias("c_nationkey"), F.when(key % 2 == 0, key / 10.0).alias("threshold"), F.when(key % 3 == 0, key.cast("int")).alias("minimum"))
    out = P.resolved_settings(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), own, ["c_nationkey"], {"threshold": 0.5, "minimum": 64})
    return out.select("c_custkey", "threshold", "minimum")


@query("checked_scores", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, candidate_index, 'no_score' AS status FROM cand WHERE candidate_index % 7 = 0
UNION ALL SELECT case_id, jaw, candidate_index, CASE WHEN candidate_index % 5 = 1 AND candidate_run = 'N' THEN 'value_differs' ELSE 'ok' END FROM cand WHERE candidate_index % 7 <> 0
UNION ALL SELECT case_id, jaw, candidate_index + 100000, 'no_candidate' FROM cand WHERE candidate_index = 1"""))
def checked_scores(spark, folder):
    rows = candidates(spark, folder).select(*ID, "candidate_run", "mean_tre_mm")
    wrong = (F.col("candidate_index") % 5 == 1) & (F.col("candidate_run") == "N")
    scores = rows.where("candidate_index % 7 <> 0").withColumn("mean_tre_mm", F.col("mean_tre_mm") + F.when(wrong, 0.25).otherwise(1e-9))
    stray = rows.where("candidate_index = 1").withColumn("candidate_index", F.col("candidate_index") + 100000)
    return P.checked_scores(scores.unionByName(stray), rows, ID, "mean_tre_mm").select(*GROUP, F.col("candidate_index").cast("long").alias("candidate_index"), "status")


@query("saved_ensemble", with_sql(CANDIDATES_SQL, body="SELECT jaw, count(*) AS rows, 0::BIGINT AS differing FROM cand GROUP BY jaw"))
def saved_ensemble(spark, folder):
    """All rows are fitted for two seeds; the ensemble is saved, loaded and scored again."""
    rows, home = training_rows(spark, folder), scratch(spark, "ensemble")
    models = {str(s): L.fit_regression(rows, FEATURES, "mean_tre_mm", s, trees=4, depth=4) for s in (1, 2)}
    L.save_ensemble(models, home, FEATURES, spark, target="raw")
    loaded, features, _ = L.load_ensemble(spark, home)
    first = L.score_regression(models, rows, FEATURES, ID).select(*ID, F.col("seed").cast("string").alias("seed"), F.col("cost").alias("fitted"))
    again = L.score_regression(loaded, rows, features, ID).select(*ID, F.col("seed").cast("string").alias("seed"), "cost")
    both = first.join(again, [*ID, "seed"]).groupBy(*ID).agg(F.max((r6("fitted") != r6("cost")).cast("long")).alias("bad"))
    return both.groupBy("jaw").agg(F.count("*").alias("rows"), F.sum("bad").alias("differing"))
