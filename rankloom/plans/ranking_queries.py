"""Ranks, top lists, blends, votes and pairs over the candidate view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import matrix as M
from ..operators import grouping as G
from ..operators import selection as S
from .bindings import (
    CANDIDATES_SQL, GROUP, POSED_SQL, SEEDS_SQL, candidates, posed, r6, rounded, seed_costs, with_sql,
)
from .registry import query

ID = [*GROUP, "candidate_index"]
OPPOSITE_SQL = "contains(target, 'axial_' || CASE WHEN jaw = 'upper' THEN 'lower' ELSE 'upper' END || '_')"


@query("fractional_rank_ordinal", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, candidate_index,
  round((row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) - 1)
    / greatest(count(*) OVER (PARTITION BY case_id, jaw) - 1, 1)::DOUBLE, 6) AS rank
FROM cand"""))
def fractional_rank_ordinal(spark, folder):
    cand = candidates(spark, folder)
    out = G.ordinal_fraction(cand, GROUP, [F.col("selection_score_mm"), F.col("candidate_index")], "rank")
    return out.select(*ID, r6("rank").alias("rank"))


@query("fractional_rank_min", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, candidate_index,
  round(percent_rank() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm), 6) AS rank
FROM cand"""))
def fractional_rank_min(spark, folder):
    out = G.lowest_fraction(candidates(spark, folder), GROUP, F.col("selection_score_mm"), "rank")
    return out.select(*ID, r6("rank").alias("rank"))


@query("robust_z", with_sql(CANDIDATES_SQL, """q AS (
  SELECT case_id, jaw, quantile_cont(selection_score_mm, 0.25) AS s25, quantile_cont(selection_score_mm, 0.5) AS s50,
    quantile_cont(selection_score_mm, 0.75) AS s75, quantile_cont(fit_score_mm, 0.25) AS f25,
    quantile_cont(fit_score_mm, 0.5) AS f50, quantile_cont(fit_score_mm, 0.75) AS f75
  FROM cand GROUP BY ALL)""", body="""
SELECT case_id, jaw, candidate_index,
  round(greatest(least((selection_score_mm - s50) / greatest(s75 - s25, 1e-6), 8.0::DOUBLE), -8.0::DOUBLE), 6) AS z_selection,
  round(greatest(least((fit_score_mm - f50) / greatest(f75 - f25, 1e-6), 8.0::DOUBLE), -8.0::DOUBLE), 6) AS z_fit
FROM cand JOIN q USING (case_id, jaw)"""))
def robust_z(spark, folder):
    out = G.robust_z(
        candidates(spark, folder), GROUP, {"selection_score_mm": "z_selection", "fit_score_mm": "z_fit"}
    )
    return out.select(*ID, r6("z_selection").alias("z_selection"), r6("z_fit").alias("z_fit"))


@query("frequency_share", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, candidate_index,
  round(count(*) OVER (PARTITION BY case_id, jaw, target) / (count(*) OVER (PARTITION BY case_id, jaw))::DOUBLE, 6) AS target_share,
  round(count(*) OVER (PARTITION BY case_id, jaw, source_variant) / (count(*) OVER (PARTITION BY case_id, jaw))::DOUBLE, 6) AS source_share,
  round(count(*) OVER (PARTITION BY case_id, jaw, target, source_variant) / (count(*) OVER (PARTITION BY case_id, jaw))::DOUBLE, 6) AS pair_share
FROM cand"""))
def frequency_share(spark, folder):
    from ..operators.features import frequency_shares

    out = frequency_shares(candidates(spark, folder), GROUP)
    return out.select(*ID, *[r6(c).alias(c) for c in ("target_share", "source_share", "pair_share")])


@query("top_by_score", with_sql(CANDIDATES_SQL, f""" ex AS (
  SELECT *, (jaw = 'upper' AND {OPPOSITE_SQL}) AS out FROM cand),
pool AS (SELECT *, bool_or(NOT out) OVER (PARTITION BY case_id, jaw) AS free FROM ex)""", body="""
SELECT case_id, jaw, candidate_index, place FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS place
  FROM pool WHERE NOT (out AND free)) WHERE place <= 5"""))
def top_by_score(spark, folder):
    cand = candidates(spark, folder)
    opposite = (F.col("jaw") == "upper") & K.opposite_target("target", F.lit(""), "jaw")
    return S.top_by_score(cand, GROUP, "selection_score_mm", 5, excluded=opposite).select(*ID, "place")


RUN_BALANCED_SQL = """runs AS (SELECT case_id, jaw, count(DISTINCT candidate_run) AS runs FROM cand GROUP BY ALL),
inrun AS (SELECT cand.*, row_number() OVER (PARTITION BY case_id, jaw, candidate_run ORDER BY selection_score_mm, candidate_index)
    > ceil(10.0::DOUBLE / runs) AS spare FROM cand JOIN runs USING (case_id, jaw)),
balanced AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY spare,
    CASE WHEN NOT spare THEN candidate_run END, selection_score_mm, candidate_index) AS place FROM inrun) WHERE place <= 10)"""


@query("run_balanced_topk", with_sql(CANDIDATES_SQL, RUN_BALANCED_SQL, body="""
SELECT case_id, jaw, candidate_index, candidate_run, place FROM balanced"""))
def run_balanced_topk(spark, folder):
    out = S.run_balanced_top(candidates(spark, folder), GROUP, "candidate_run", "selection_score_mm", 10)
    return out.select(*ID, "candidate_run", "place")


def _print_sql(digits):
    return f"list_transform(transform, lambda v: printf('%.{digits}f', round_even(v, {digits}) + 0.0::DOUBLE))"


@query("training_subset", with_sql(CANDIDATES_SQL, POSED_SQL, """a AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS ps,
    row_number() OVER (PARTITION BY case_id, jaw ORDER BY mean_tre_mm, candidate_index) AS pt FROM posed),
b AS (SELECT *, 0 AS list, ps AS place FROM a WHERE ps <= 4 UNION ALL SELECT *, 1, pt FROM a WHERE pt <= 3)""",
body=f"""SELECT case_id, jaw, candidate_index, mean_tre_mm FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw, {_print_sql(7)} ORDER BY list DESC, place DESC) AS r FROM b)
WHERE r = 1"""))
def training_subset(spark, folder):
    rows = posed(candidates(spark, folder))
    return S.training_subset(rows, GROUP, "selection_score_mm", "mean_tre_mm", 4, 3).select(*ID, "mean_tre_mm")


@query("union_of_tops", with_sql(CANDIDATES_SQL, POSED_SQL, """a AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS ps,
    row_number() OVER (PARTITION BY case_id, jaw ORDER BY fit_p90_mm, candidate_index) AS pt FROM posed)""",
body=f"""SELECT case_id, jaw, candidate_index FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw, {_print_sql(4)} ORDER BY selection_score_mm, candidate_index) AS r
  FROM a WHERE ps <= 4 OR pt <= 4) WHERE r = 1"""))
def union_of_tops(spark, folder):
    rows = posed(candidates(spark, folder))
    return S.union_of_tops(rows, GROUP, "selection_score_mm", "fit_p90_mm", 4, 4).select(*ID)


EVIDENCE_SQL = """ev AS (SELECT *,
    CASE WHEN contains(target, 'adaptive') THEN 'adaptive' WHEN contains(target, 'aggregate') THEN 'aggregate' ELSE 'tracked' END AS family,
    (round_even(threshold / 100.0::DOUBLE, 0) * 100)::INTEGER AS threshold_cell,
    CASE WHEN contains(source_variant, 'low') THEN 'low' WHEN contains(source_variant, 'high') THEN 'high' ELSE 'full' END AS side
  FROM cand)"""


def evidence(cand):
    key = K.evidence_key("candidate_run", F.lit(""), "target", "threshold", "source_variant")
    return cand.withColumn("_e", key).select(
        "*", F.col("_e.family").alias("family"), F.col("_e.threshold").alias("threshold_cell"),
        F.col("_e.side").alias("side"),
    ).drop("_e")


@query("evidence_key", with_sql(CANDIDATES_SQL, EVIDENCE_SQL, body="""
SELECT case_id, jaw, candidate_index, candidate_run, family, threshold_cell, side FROM ev"""))
def evidence_key(spark, folder):
    return evidence(candidates(spark, folder)).select(*ID, "candidate_run", "family", "threshold_cell", "side")


@query("evidence_prune", with_sql(CANDIDATES_SQL, EVIDENCE_SQL, body="""
SELECT case_id, jaw, candidate_index FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw, candidate_run, family, threshold_cell, side
    ORDER BY selection_score_mm, fit_score_mm, fit_p90_mm, target_coverage_2mm, candidate_index) AS r
  FROM ev WHERE fit_score_mm <= 6 AND fit_p90_mm <= 7 AND target_coverage_2mm >= 0.1) WHERE r <= 1"""))
def evidence_prune(spark, folder):
    rows = evidence(candidates(spark, folder))
    keep = (F.col("fit_score_mm") <= 6) & (F.col("fit_p90_mm") <= 7) & (F.col("target_coverage_2mm") >= 0.1)
    order = K.quality("selection_score_mm", "fit_score_mm", "fit_p90_mm", "target_coverage_2mm")
    cell = ["candidate_run", "family", "threshold_cell", "side"]
    return S.evidence_prune(rows, GROUP, cell, order, keep, 1).select(*ID)


@query("diverse_topk", with_sql(CANDIDATES_SQL, EVIDENCE_SQL, """f AS (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw, source_variant, family ORDER BY selection_score_mm, candidate_index) AS r
  FROM ev)""", body="""SELECT case_id, jaw, candidate_index, place FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY r > 1, selection_score_mm, candidate_index) AS place FROM f)
WHERE place <= 6"""))
def diverse_topk(spark, folder):
    rows = evidence(candidates(spark, folder))
    return S.diverse_top(rows, GROUP, ["source_variant", "family"], "selection_score_mm", 6).select(*ID, "place")


@query("enrichment_flag", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, candidate_index,
  row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) <= 3 AS full_geometry_available
FROM cand"""))
def enrichment_flag(spark, folder):
    out = S.keep_best_flag(candidates(spark, folder), GROUP, "selection_score_mm", 3, "full_geometry_available")
    return out.select(*ID, "full_geometry_available")


@query("unsupervised_rank", with_sql(CANDIDATES_SQL, """p AS (
  SELECT *, max(prior_accepted) OVER (PARTITION BY case_id, jaw) AS any_ok FROM cand)""", body="""
SELECT case_id, jaw, candidate_index,
  row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm + 0.002::DOUBLE * turn_deg, candidate_index) AS unsupervised_rank
FROM p WHERE any_ok = 0 OR prior_accepted = 1"""))
def unsupervised_rank(spark, folder):
    rows = candidates(spark, folder).withColumn("rank_score_mm", F.col("selection_score_mm") + 0.002 * F.col("turn_deg"))
    out = S.accepted_rank(rows, GROUP, "rank_score_mm", "prior_accepted", "unsupervised_rank")
    return out.select(*ID, "unsupervised_rank")


@query("capped_selection", """
WITH c AS (SELECT doc_id, sha256(text) AS content_hash, doc_id % 3 AS fold, n_chars::DOUBLE AS score FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY fold, content_hash ORDER BY score DESC, doc_id) AS r FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, doc_id) AS place FROM g WHERE r <= 1)
SELECT top_count, fold, doc_id, place FROM p, (SELECT unnest([5, 20, 50]) AS top_count) WHERE place <= top_count""")
def capped_selection(spark, folder):
    from .bindings import table

    docs = table(spark, folder, "documents").select(
        "doc_id", F.sha2("text", 256).alias("content_hash"), F.pmod("doc_id", F.lit(3)).alias("fold"),
        F.col("n_chars").cast("double").alias("score"),
    )
    out = S.capped_top(docs, "fold", "content_hash", [-F.col("score")], 1, [5, 20, 50], "doc_id")
    return out.select("top_count", "fold", "doc_id", "place")


@query("seed_aggregates", with_sql(SEEDS_SQL, """r AS (SELECT *, (row_number() OVER (PARTITION BY case_id, seed ORDER BY cost, candidate_index) - 1)
    / greatest(count(*) OVER (PARTITION BY case_id, seed) - 1, 1)::DOUBLE AS rk FROM seeds),
a AS (SELECT case_id, candidate_index, avg(cost) AS mean_cost, median(cost) AS median_cost, avg(rk) AS rank_mean FROM r GROUP BY ALL),
w AS (SELECT case_id, seed, arg_min(candidate_index, (cost, candidate_index)) AS candidate_index FROM seeds GROUP BY ALL),
v AS (SELECT case_id, candidate_index, count(*) AS votes FROM w GROUP BY ALL)""", body="""
SELECT case_id, candidate_index, round(mean_cost, 4) AS mean_cost, round(median_cost, 4) AS median_cost,
  round(rank_mean, 6) AS rank_mean, coalesce(votes, 0) AS votes,
  round(-coalesce(votes, 0) + 1e-6 * mean_cost, 6) AS vote_score
FROM a LEFT JOIN v USING (case_id, candidate_index)"""))
def seed_aggregates(spark, folder):
    out = S.seed_aggregates(seed_costs(spark, folder), ["case_id"], "seed", "cost")
    return out.select(
        "case_id", "candidate_index", rounded("mean_cost", 4).alias("mean_cost"),
        rounded("median_cost", 4).alias("median_cost"), r6("rank_mean").alias("rank_mean"), "votes",
        r6("vote_score").alias("vote_score"),
    )


@query("seed_vote", with_sql(SEEDS_SQL, """w AS (
  SELECT case_id, seed, arg_min(candidate_index, (cost, candidate_index)) AS candidate_index FROM seeds GROUP BY ALL),
v AS (SELECT case_id, candidate_index, count(*) AS votes FROM w GROUP BY ALL),
m AS (SELECT case_id, candidate_index, avg(cost) AS mean_cost FROM seeds GROUP BY ALL)""", body="""
SELECT case_id, candidate_index, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, mean_cost, candidate_index) AS r
  FROM v JOIN m USING (case_id, candidate_index)) WHERE r = 1"""))
def seed_vote(spark, folder):
    out = S.majority_winner(seed_costs(spark, folder), ["case_id"], "seed", "cost")
    return out.select("case_id", "candidate_index", "votes")


@query("rank_blend", with_sql(CANDIDATES_SQL, """r AS (SELECT *,
  (row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) - 1)
    / greatest(count(*) OVER (PARTITION BY case_id, jaw) - 1, 1)::DOUBLE AS ra,
  (row_number() OVER (PARTITION BY case_id, jaw ORDER BY fit_score_mm, candidate_index) - 1)
    / greatest(count(*) OVER (PARTITION BY case_id, jaw) - 1, 1)::DOUBLE AS rb FROM cand)""", body="""
SELECT case_id, jaw, candidate_index, alpha, round(alpha * ra + (1.0::DOUBLE - alpha) * rb, 6) AS blend_score
FROM r, (SELECT unnest([0.0, 0.575, 1.0]::DOUBLE[]) AS alpha)"""))
def rank_blend(spark, folder):
    out = S.rank_blend(candidates(spark, folder), GROUP, "selection_score_mm", "fit_score_mm", [0.0, 0.575, 1.0])
    return out.select(*ID, "alpha", r6("blend_score").alias("blend_score"))


@query("policy_curve", with_sql(CANDIDATES_SQL, """r AS (SELECT *,
  (row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) - 1)
    / greatest(count(*) OVER (PARTITION BY case_id, jaw) - 1, 1)::DOUBLE AS ra,
  (row_number() OVER (PARTITION BY case_id, jaw ORDER BY fit_score_mm, candidate_index) - 1)
    / greatest(count(*) OVER (PARTITION BY case_id, jaw) - 1, 1)::DOUBLE AS rb FROM cand),
b AS (SELECT case_id, jaw, candidate_index, mean_tre_mm, alpha, round((1.0::DOUBLE - alpha) * ra + alpha * rb, 9) AS score
  FROM r, (SELECT unnest(range(0, 21)) * 0.05::DOUBLE AS alpha)),
s AS (SELECT alpha, case_id, jaw, arg_min(mean_tre_mm, (score, candidate_index)) AS err FROM b GROUP BY ALL)""", body="""
SELECT round(alpha, 6) AS alpha, round(avg(err), 6) AS mean_error, round(quantile_cont(err, 0.5), 6) AS median_error,
  round(quantile_cont(err, 0.9), 6) AS p90_error, round(max(err), 6) AS max_error FROM s GROUP BY alpha"""))
def policy_curve(spark, folder):
    from ..operators.summaries import summarize

    alphas = [i * 0.05 for i in range(21)]
    chosen = S.blended_choices(candidates(spark, folder), GROUP, "fit_score_mm", "selection_score_mm", alphas, "mean_tre_mm").withColumnRenamed("mean_tre_mm", "error")
    out = summarize(chosen, ["alpha"], "error", success=())
    return out.select(
        r6("alpha").alias("alpha"),
        *[r6(f"error_{s}").alias(f"{s}_error") for s in ("mean", "median", "p90", "max")],
    )


@query("oracle_regret", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, arg_min(candidate_index, (selection_score_mm, candidate_index)) AS candidate_index,
  round(arg_min(mean_tre_mm, (selection_score_mm, candidate_index)), 6) AS selected_error,
  arg_min(candidate_index, (mean_tre_mm, candidate_index)) AS best_index, round(min(mean_tre_mm), 6) AS best_error,
  round(arg_min(mean_tre_mm, (selection_score_mm, candidate_index)) - min(mean_tre_mm), 6) AS regret,
  count(*) AS pool_size
FROM cand GROUP BY case_id, jaw"""))
def oracle_regret(spark, folder):
    out = S.selected_and_best(candidates(spark, folder), GROUP, "selection_score_mm", "mean_tre_mm")
    return out.select(*GROUP, "candidate_index", r6("selected_error").alias("selected_error"), "best_index",
                      r6("best_error").alias("best_error"), r6("regret").alias("regret"), "pool_size")


@query("pool_report", with_sql(CANDIDATES_SQL, RUN_BALANCED_SQL, """sel AS (
  SELECT case_id, jaw, arg_min(mean_tre_mm, place) AS err, min(mean_tre_mm) AS best, arg_min(chirality, place) AS parity,
    arg_min(chirality, (mean_tre_mm, candidate_index)) AS true_parity, count(*) AS pool FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS p2 FROM balanced)
  GROUP BY ALL)""", body="""
SELECT jaw, count(*) AS groups, round(avg(err), 6) AS selected_mean, round(quantile_cont(err, 0.9), 6) AS selected_p90,
  round(avg(best), 6) AS oracle_mean, round(avg((parity = true_parity)::INTEGER), 6) AS parity_accuracy, round(avg(pool), 6) AS mean_pool
FROM sel GROUP BY jaw"""))
def pool_report(spark, folder):
    pool = S.run_balanced_top(candidates(spark, folder), GROUP, "candidate_run", "selection_score_mm", 10)
    per = pool.groupBy(*GROUP).agg(
        F.min_by("mean_tre_mm", "place").alias("selected"), F.min("mean_tre_mm").alias("best"),
        F.min_by("chirality", "place").alias("parity"),
        F.min_by("chirality", F.struct("mean_tre_mm", "candidate_index")).alias("true_parity"),
        F.count(F.lit(1)).alias("pool"),
    )
    p90 = G.quantiles(per, ["jaw"], "selected", {"selected_p90": 0.9})
    out = per.groupBy("jaw").agg(
        F.count(F.lit(1)).alias("groups"), r6(F.avg("selected")).alias("selected_mean"),
        r6(F.avg("best")).alias("oracle_mean"),
        r6(F.avg((F.col("parity") == F.col("true_parity")).cast("double"))).alias("parity_accuracy"),
        r6(F.avg("pool")).alias("mean_pool"),
    )
    return G.join_null_safe(out, p90.withColumn("selected_p90", r6("selected_p90")), ["jaw"], "left")


PRIOR_ANGLE = 15.0
PRIOR_SHIFT = (1.0, 2.0, 3.0)


@query("pair_selection", with_sql(CANDIDATES_SQL, POSED_SQL, """t AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS place FROM posed) WHERE place <= 96),
p AS (SELECT u.case_id, u.candidate_index AS ui, l.candidate_index AS li, u.place AS up, l.place AS lp, u.place <= 8 AND l.place <= 8 AS near,
    abs((((l.turn_deg - u.turn_deg - 15.0::DOUBLE) + 180.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE) AS angle,
    sqrt(pow(u.selection_score_mm - l.selection_score_mm - 1, 2) + pow(u.fit_p90_mm - l.fit_p90_mm - 2, 2)
       + pow(u.fit_score_mm - l.fit_score_mm - 3, 2)) AS gap,
    u.selection_score_mm + l.selection_score_mm AS base
  FROM t u JOIN t l ON u.case_id = l.case_id AND u.chirality = l.chirality AND u.jaw = 'upper' AND l.jaw = 'lower'),
o AS (SELECT *, base + 0.01::DOUBLE * angle + 0.075::DOUBLE * gap AS objective, bool_or(near) OVER (PARTITION BY case_id) AS any_near FROM p)""", body="""
SELECT case_id, ui AS upper_index, li AS lower_index, round(objective, 4) AS objective, NOT any_near AS widened FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY objective, up, lp) AS r FROM o WHERE near OR NOT any_near) WHERE r = 1"""))
def pair_selection(spark, folder):
    rows = posed(candidates(spark, folder)).withColumn("score", F.col("selection_score_mm"))
    ranked = S.top_by_score(rows, GROUP, "score", 96)
    c, s = F.cos(F.radians(F.lit(PRIOR_ANGLE))), F.sin(F.radians(F.lit(PRIOR_ANGLE)))
    zero, one = F.lit(0.0), F.lit(1.0)
    prior = [c, -s, zero, s, c, zero, zero, zero, one]
    out = S.joint_pairs(ranked, "case_id", prior, [F.lit(v) for v in PRIOR_SHIFT])
    return out.select(
        "case_id", F.col("upper_candidate_index").alias("upper_index"),
        F.col("lower_candidate_index").alias("lower_index"), rounded("objective", 4).alias("objective"), "widened",
    )
