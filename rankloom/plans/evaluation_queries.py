"""Mode comparison, resampling, nested choice and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import grouping as G
from ..operators import summaries as S
from .bindings import (
    CANDIDATES_SQL, GROUP, MODES_SQL, SCAN_GROUPS_SQL, candidates, mode_results, r6, scan_groups, table, with_sql,
)
from .registry import query

RANKED_SQL = """fixed AS (SELECT mode, avg(translation) AS t, avg(rotation) AS r, length(mode) AS complexity FROM modes GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (ORDER BY t) AS tr, rank() OVER (ORDER BY r) AS rr FROM fixed),
placed AS (SELECT *, (tr + rr) / 2.0::DOUBLE AS ar, row_number() OVER (ORDER BY (tr + rr) / 2.0::DOUBLE, rr, tr, r, t, complexity, mode) AS place FROM ranked)"""


@query("mode_rank", with_sql(MODES_SQL, """exact AS (
  SELECT user_id AS case_id, min(value) AS et, min((props->>'$.k')::DOUBLE) AS er FROM events WHERE user_id % 10 = 0 GROUP BY ALL),
m2 AS (SELECT mode, case_id, coalesce(et, translation) AS translation, coalesce(er, rotation) AS rotation FROM modes LEFT JOIN exact USING (case_id))""",
RANKED_SQL.replace("FROM modes", "FROM m2"), body="""
SELECT mode, round(t, 6) AS translation, round(r, 6) AS rotation, tr AS translation_rank, rr AS rotation_rank,
  ar AS average_rank, complexity, place FROM placed"""))
def mode_rank(spark, folder):
    modes, exact = mode_results(spark, folder), exact_rows(spark, folder)
    deployed = E.exact_fallback(modes, exact, ["case_id"], ["translation", "rotation"])
    means = deployed.groupBy("mode").agg(F.avg("translation").alias("translation"), F.avg("rotation").alias("rotation"))
    out = E.rank_modes(means, [], "mode", "translation", "rotation", F.length("mode"))
    return out.withColumns({"translation": r6("translation"), "rotation": r6("rotation")})


def exact_rows(spark, folder):
    events = table(spark, folder, "events").where(F.pmod("user_id", F.lit(10)) == 0)
    return events.groupBy(F.col("user_id").alias("case_id")).agg(
        F.min("value").alias("translation"), F.min(F.get_json_object("props", "$.k").cast("double")).alias("rotation")
    )


@query("exact_fallback_summary", with_sql(MODES_SQL, """exact AS (
  SELECT user_id AS case_id, min(value) AS et, min((props->>'$.k')::DOUBLE) AS er FROM events WHERE user_id % 10 = 0 GROUP BY ALL),
m2 AS (SELECT mode, case_id, coalesce(et, translation) AS t, coalesce(er, rotation) AS r, et IS NOT NULL AS rep
  FROM modes LEFT JOIN exact USING (case_id))""", body="""
SELECT mode, count(*) AS translation_count, round(avg(t), 6) AS translation_mean, round(quantile_cont(t, 0.5), 6) AS translation_median,
  round(quantile_cont(t, 0.9), 6) AS translation_p90, round(max(t), 6) AS translation_max, round(avg(r), 6) AS rotation_mean,
  round(quantile_cont(r, 0.5), 6) AS rotation_median, round(quantile_cont(r, 0.9), 6) AS rotation_p90, round(max(r), 6) AS rotation_max,
  round(avg(0.5::DOUBLE * (t / 10 + r / 5)), 6) AS balanced_mean, count(*) FILTER (WHERE rep) AS replaced FROM m2 GROUP BY mode"""))
def exact_fallback_summary(spark, folder):
    deployed = E.exact_fallback(
        mode_results(spark, folder), exact_rows(spark, folder), ["case_id"], ["translation", "rotation"])
    out = S.two_metric_summary(deployed, ["mode"])
    replaced = deployed.groupBy("mode").agg(F.count_if("replaced").alias("replaced"))
    out = S.attach(out, replaced, ["mode"])
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("error_summary", with_sql(CANDIDATES_SQL, body="""
SELECT candidate_run, count(mean_tre_mm) AS e_count, round(avg(mean_tre_mm), 6) AS e_mean, round(quantile_cont(mean_tre_mm, 0.5), 6) AS e_median,
  round(quantile_cont(mean_tre_mm, 0.9), 6) AS e_p90, max(mean_tre_mm) AS e_max, round(avg((mean_tre_mm <= 2)::INTEGER), 6) AS e_le_2,
  round(avg((mean_tre_mm <= 3)::INTEGER), 6) AS e_le_3 FROM cand GROUP BY 1"""))
def error_summary(spark, folder):
    out = S.summarize(candidates(spark, folder), ["candidate_run"], "mean_tre_mm", prefix="e")
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("key_set_report", with_sql(MODES_SQL, body="""
SELECT case_id, count(DISTINCT mode) AS present, (SELECT count(DISTINCT mode) FROM modes) AS parts
FROM modes WHERE mode <> 'error' OR case_id % 2 = 0 GROUP BY case_id
HAVING count(DISTINCT mode) < (SELECT count(DISTINCT mode) FROM modes)"""))
def key_set_report(spark, folder):
    modes = mode_results(spark, folder)
    kept = modes.where((F.col("mode") != "error") | (F.pmod("case_id", F.lit(2)) == 0))
    return S.key_set_report(kept, "mode", ["case_id"]).select("case_id", "present", "parts")


@query("counts_with_totals", """
SELECT lang, source, count(*) AS rows, grouping(lang, source)::BIGINT AS level FROM documents
GROUP BY GROUPING SETS ((lang, source), ())""")
def counts_with_totals(spark, folder):
    return S.counts_by(table(spark, folder, "documents"), ["lang", "source"], totals=True)


@query("distinct_counts", """
SELECT source, count(DISTINCT lang) AS distinct_lang, count(DISTINCT sha256(text)) AS distinct_content_hash,
  count(DISTINCT doc_id) AS distinct_doc_id FROM documents GROUP BY source""")
def distinct_counts(spark, folder):
    docs = table(spark, folder, "documents").withColumn("content_hash", F.sha2("text", 256))
    return S.distinct_counts(docs, ["source"], ["lang", "content_hash", "doc_id"])


@query("pearson", with_sql(CANDIDATES_SQL, body="""
SELECT candidate_run, round(corr(fit_score_mm, selection_score_mm), 6) AS pearson FROM cand GROUP BY 1"""))
def pearson(spark, folder):
    out = S.correlation(candidates(spark, folder), ["candidate_run"], "fit_score_mm", "selection_score_mm")
    return out.select("candidate_run", r6("pearson").alias("pearson"))


DELTAS_SQL = """md AS (SELECT * FROM modes JOIN scans USING (case_id)),
deltas AS (SELECT group_id, avg(CASE WHEN mode = 'click' THEN translation END) - avg(CASE WHEN mode = 'error' THEN translation END) AS delta
  FROM md WHERE mode IN ('click', 'error') GROUP BY 1)"""


def modes_with_scans(spark, folder):
    return mode_results(spark, folder).join(scan_groups(spark, folder), "case_id")


@query("paired_counts", with_sql(MODES_SQL, SCAN_GROUPS_SQL, DELTAS_SQL, body="""
SELECT count(*) FILTER (WHERE delta < 0) AS wins, count(*) FILTER (WHERE delta > 0) AS losses, count(*) FILTER (WHERE delta = 0) AS ties FROM deltas"""))
def paired_counts(spark, folder):
    d = E.group_deltas(modes_with_scans(spark, folder), "mode", "group_id", "translation", "click", "error")
    return S.paired_counts(d, [], "delta")


@query("leave_one_out_delta", with_sql(MODES_SQL, SCAN_GROUPS_SQL, DELTAS_SQL, body="""
SELECT group_id, round(delta, 6) AS delta,
  round((sum(delta) OVER () - delta) / (count(*) OVER () - 1), 6) AS mean_without,
  round(abs((sum(delta) OVER () - delta) / (count(*) OVER () - 1) - avg(delta) OVER ()), 6) AS influence
FROM deltas"""))
def leave_one_out_delta(spark, folder):
    d = E.group_deltas(modes_with_scans(spark, folder), "mode", "group_id", "translation", "click", "error")
    out = S.leave_one_out(d, [], "group_id", "delta")
    return out.select("group_id", *[r6(c).alias(c) for c in ("delta", "mean_without", "influence")])


@query("signed_rank", with_sql(CANDIDATES_SQL, """d AS (
  SELECT candidate_run, abs(mean_tre_mm - fit_p90_mm) AS a, mean_tre_mm > fit_p90_mm AS up FROM cand WHERE round(mean_tre_mm - fit_p90_mm, 6) <> 0),
h AS (SELECT candidate_run, round(a, 6) AS a, count(*) AS c, count(*) FILTER (WHERE up) AS ups FROM d GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY candidate_run ORDER BY a) - c + 1 + (c - 1) / 2.0::DOUBLE AS rk FROM h)""", body="""
SELECT candidate_run, sum(c)::BIGINT AS pairs, sum(rk * ups) AS rank_sum_up, sum(rk * (c - ups)) AS rank_sum_down FROM r GROUP BY 1"""))
def signed_rank(spark, folder):
    rows = candidates(spark, folder).withColumn("delta", F.round(F.col("mean_tre_mm") - F.col("fit_p90_mm"), 6))
    return S.signed_rank(rows, ["candidate_run"], "delta").select("candidate_run", "pairs", "rank_sum_up", "rank_sum_down")


@query("signed_rank_p_value")
def signed_rank_p_value(spark, folder):
    d = E.group_deltas(modes_with_scans(spark, folder), "mode", "group_id", "rotation", "click", "error")
    return S.signed_rank(d, [], "delta")


@query("nested_selection", with_sql(MODES_SQL, SCAN_GROUPS_SQL, """md AS (SELECT * FROM modes JOIN scans USING (case_id)),
own AS (SELECT group_id, mode, count(*) AS n, sum(translation) AS s FROM md GROUP BY ALL),
tot AS (SELECT mode, sum(n) AS tn, sum(s) AS ts FROM own GROUP BY ALL),
t AS (SELECT group_id, mode, n, (ts - s) / (tn - n) AS m, s / n AS h FROM own JOIN tot USING (mode))""", body="""
SELECT group_id, mode AS selected, round(m, 6) AS training_mean, round(h, 6) AS heldout_mean, n AS heldout_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY m, length(mode), mode) AS r FROM t) WHERE r = 1"""))
def nested_selection(spark, folder):
    out = E.nested_selection(modes_with_scans(spark, folder), "mode", "group_id", "translation", F.length("mode"))
    return out.select("group_id", "selected", r6("training_mean").alias("training_mean"),
                      r6("heldout_mean").alias("heldout_mean"), "heldout_rows")


NESTED_RANK_SQL = """md AS (SELECT * FROM modes JOIN scans USING (case_id)),
own AS (SELECT group_id, mode, count(*) AS n, sum(translation) AS s, sum(rotation) AS q FROM md GROUP BY ALL),
tot AS (SELECT mode, sum(n) AS tn, sum(s) AS ts, sum(q) AS tq FROM own GROUP BY ALL),
t AS (SELECT group_id, mode, n, (ts - s) / (tn - n) AS m, (tq - q) / (tn - n) AS m2, s / n AS h, q / n AS h2 FROM own JOIN tot USING (mode)),
rk AS (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY m) AS tr, rank() OVER (PARTITION BY group_id ORDER BY m2) AS rr FROM t),
nested AS (SELECT * FROM (SELECT *, (tr + rr) / 2.0::DOUBLE AS ar, row_number() OVER (PARTITION BY group_id
   ORDER BY (tr + rr) / 2.0::DOUBLE, rr, tr, m2, m, length(mode), mode) AS place FROM rk) WHERE place = 1)"""


@query("nested_rank_selection", with_sql(MODES_SQL, SCAN_GROUPS_SQL, NESTED_RANK_SQL, body="""
SELECT group_id, mode AS selected, ar AS training_average_rank, n AS heldout_rows, round(h, 6) AS heldout_translation,
  round(h2, 6) AS heldout_rotation FROM nested"""))
def nested_rank_selection(spark, folder):
    out = E.nested_rank_selection(modes_with_scans(spark, folder), "mode", "group_id", F.length("mode"))
    return out.withColumns({c: r6(c) for c in ("heldout_translation", "heldout_rotation")})


@query("nested_jaw_choice", with_sql(CANDIDATES_SQL, """md AS (SELECT candidate_run AS model, source_variant AS post, jaw,
  'g' || (case_id % 40) AS group_id, mean_tre_mm FROM cand),
own AS (SELECT group_id, model, post, jaw, count(*) AS n, sum(mean_tre_mm) AS s FROM md GROUP BY ALL),
tot AS (SELECT model, post, jaw, sum(n) AS tn, sum(s) AS ts FROM own GROUP BY ALL),
t AS (SELECT group_id, model, post, jaw, (ts - s) / (tn - n) AS m, s / n AS h FROM own JOIN tot USING (model, post, jaw)),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id, model, jaw ORDER BY m, post) AS r FROM t),
c AS (SELECT group_id, model, avg(m) AS tm, avg(h) AS hm, string_agg(post, '/' ORDER BY jaw) AS post FROM b WHERE r = 1 GROUP BY ALL HAVING count(*) = 2)""",
body="""SELECT group_id, model, post, round(tm, 6) AS training_mean, round(hm, 6) AS heldout_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY tm, model, post) AS r FROM c) WHERE r = 1"""))
def nested_jaw_choice(spark, folder):
    rows = candidates(spark, folder).select(
        F.col("candidate_run").alias("model"), F.col("source_variant").alias("post"), "jaw",
        F.concat(F.lit("g"), F.pmod("case_id", F.lit(40)).cast("string")).alias("group_id"), "mean_tre_mm",
    )
    out = E.nested_jaw_choice(rows, "group_id", "model", "post", "jaw", "mean_tre_mm")
    return out.withColumns({c: r6(c) for c in ("training_mean", "heldout_mean")})


def draws_sql(groups: str, samples: int, seed: int) -> str:
    """Draws of (sample, slot) as in the resampling operator, for a table of numbered groups."""
    return f"""draws AS (SELECT sample, ('0x' || substr(sha256('{seed}|' || sample || '|' || slot), 1, 8))::BIGINT
    % (SELECT count(*) FROM {groups}) AS group_pos
  FROM (SELECT unnest(range(0, {samples})) AS sample), (SELECT unnest(range(0, (SELECT count(*) FROM {groups}))) AS slot))"""


RISK_SQL = """risk AS (SELECT o_orderkey AS case_id, 'c' || (o_custkey % 400) AS group_id, (o_totalprice % 400.0::DOUBLE) / 100 AS predicted,
  (o_totalprice % 500.0::DOUBLE) / 125 AS truth FROM orders)"""


def risk_rows(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(400)).cast("string")).alias("group_id"),
        ((price % 400.0) / 100).alias("predicted"), ((price % 500.0) / 125).alias("truth"),
    )


BOOT_SQL = """nums AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS group_pos FROM (SELECT DISTINCT group_id FROM risk))"""


@query("cluster_bootstrap", with_sql(RISK_SQL, BOOT_SQL, draws_sql("nums", 60, 7), """v AS (
  SELECT sample, truth FROM draws JOIN nums USING (group_pos) JOIN risk USING (group_id) WHERE predicted <= 2),
s AS (SELECT sample, avg(truth) AS m, quantile_cont(truth, 0.9) AS p, avg((truth <= 3)::INTEGER) AS ok FROM v GROUP BY 1)""",
body="""SELECT sample, round(m, 6) AS mean, round(p, 6) AS p90, round(ok, 6) AS success FROM s"""))
def cluster_bootstrap(spark, folder):
    out = E.cluster_bootstrap(risk_rows(spark, folder), "group_id", "truth", F.col("predicted") <= 2, 60, 7)
    return out.select("sample", r6("mean").alias("mean"), r6("p90").alias("p90"), r6("success").alias("success"))


@query("bootstrap_intervals", with_sql(RISK_SQL, BOOT_SQL, draws_sql("nums", 60, 7), """v AS (
  SELECT sample, truth FROM draws JOIN nums USING (group_pos) JOIN risk USING (group_id) WHERE predicted <= 2),
s AS (SELECT sample, avg(truth) AS m, quantile_cont(truth, 0.9) AS p, avg((truth <= 3)::INTEGER) AS ok FROM v GROUP BY 1)""",
body="""SELECT count(*) AS samples, round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high,
  round(quantile_cont(p, 0.025), 6) AS p90_low, round(quantile_cont(p, 0.975), 6) AS p90_high,
  round(quantile_cont(ok, 0.025), 6) AS success_low, round(quantile_cont(ok, 0.975), 6) AS success_high,
  avg((p <= 2.5)::INTEGER) AS p90_within_limit, avg((ok >= 0.95)::INTEGER) AS success_within_limit FROM s"""))
def bootstrap_intervals(spark, folder):
    out = E.interval_report(
        E.cluster_bootstrap(risk_rows(spark, folder), "group_id", "truth", F.col("predicted") <= 2, 60, 7))
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


MODE_NUMS_SQL = "nums AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS group_pos FROM (SELECT DISTINCT group_id FROM md))"
RANK_DELTA_SQL = """gm AS (SELECT mode, group_pos, avg(translation) AS t, avg(rotation) AS r FROM md JOIN nums USING (group_id) GROUP BY ALL),
sm AS (SELECT sample, mode, avg(t) AS t, avg(r) AS r FROM draws JOIN gm USING (group_pos) GROUP BY ALL),
sr AS (SELECT *, (rank() OVER (PARTITION BY sample ORDER BY t) + rank() OVER (PARTITION BY sample ORDER BY r)) / 2.0::DOUBLE AS ar FROM sm),
rd AS (SELECT a.sample, a.ar - b.ar AS rank_delta, a.t - b.t AS translation_delta, a.r - b.r AS rotation_delta
  FROM sr a JOIN sr b ON a.sample = b.sample AND a.mode = 'click' AND b.mode = 'error')"""


@query("bootstrap_rank_deltas", with_sql(MODES_SQL, SCAN_GROUPS_SQL, "md AS (SELECT * FROM modes JOIN scans USING (case_id))",
MODE_NUMS_SQL, draws_sql("nums", 200, 3), RANK_DELTA_SQL, body="""
SELECT sample, rank_delta, round(translation_delta, 6) AS translation_delta, round(rotation_delta, 6) AS rotation_delta FROM rd"""))
def bootstrap_rank_deltas(spark, folder):
    out = E.bootstrap_rank_deltas(modes_with_scans(spark, folder), "mode", "group_id", "click", "error", 200, 3)
    return out.withColumns({c: r6(c) for c in ("translation_delta", "rotation_delta")})


@query("robust_decision", with_sql(MODES_SQL, SCAN_GROUPS_SQL, DELTAS_SQL,
"nums AS (SELECT group_id, delta, row_number() OVER (ORDER BY group_id) - 1 AS group_pos FROM deltas)", draws_sql("nums", 200, 5),
"""bm AS (SELECT sample, avg(delta) AS m FROM draws JOIN nums USING (group_pos) GROUP BY 1),
ci AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm),
lo AS (SELECT *, (sum(delta) OVER () - delta) / (count(*) OVER () - 1) AS wo FROM deltas),
st AS (SELECT avg(delta) AS m, quantile_cont(delta, 0.5) AS med, count(*) FILTER (WHERE delta < 0) AS w, count(*) FILTER (WHERE delta > 0) AS l, max(wo) AS mw, count(*) AS n FROM lo)""",
body="""SELECT n AS groups, round(m, 6) AS mean_delta, round(med, 6) AS median_delta, w AS wins, l AS losses,
  round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(mw, 6) AS highest_without,
  m < 0 AND hi < 0 AND med < 0 AND w > l AND mw < 0 AS selected FROM st, ci"""))
def robust_decision(spark, folder):
    d = E.group_deltas(modes_with_scans(spark, folder), "mode", "group_id", "translation", "click", "error")
    out = E.robust_decision(d, "group_id", 200, 5)
    return out.select("groups", *[r6(c).alias(c) for c in ("mean_delta", "median_delta", "ci_low", "ci_high", "highest_without")],
                      "wins", "losses", "selected")


@query("official_evaluation", with_sql(MODES_SQL, SCAN_GROUPS_SQL, NESTED_RANK_SQL, RANKED_SQL, """vote AS (
  SELECT mode AS m, count(*) AS sel FROM nested GROUP BY 1),
best AS (SELECT mode FROM placed LEFT JOIN vote ON m = mode ORDER BY coalesce(sel, 0) DESC, ar, rr, tr, complexity, mode LIMIT 1)""",
MODE_NUMS_SQL, draws_sql("nums", 200, 3), RANK_DELTA_SQL.replace("a.mode = 'click'", "a.mode = (SELECT mode FROM best)"), """
loo AS (SELECT c.group_id, (c.tr + c.rr) / 2.0::DOUBLE - (b.tr + b.rr) / 2.0::DOUBLE AS d FROM rk c JOIN rk b ON c.group_id = b.group_id
  AND c.mode = (SELECT mode FROM best) AND b.mode = 'error'),
p AS (SELECT c.mode AS candidate, c.ar AS car, c.t AS ct, c.r AS cr, b.ar AS bar, b.t AS bt, b.r AS br,
  (SELECT avg((rank_delta < 0)::INTEGER) FROM rd) AS better, (SELECT max(d) FROM loo) AS worst,
  coalesce((SELECT sel FROM vote WHERE m = c.mode), 0) AS cs, coalesce((SELECT sel FROM vote WHERE m = 'error'), 0) AS bs
  FROM placed c, placed b WHERE c.mode = (SELECT mode FROM best) AND b.mode = 'error')""", body="""
SELECT candidate, car AS candidate_average_rank, bar AS baseline_average_rank, round(ct, 6) AS candidate_translation,
  round(bt, 6) AS baseline_translation, round(better, 6) AS better, worst AS worst_rank_delta, cs AS candidate_selections, bs AS baseline_selections,
  CASE WHEN candidate = 'error' OR (car < bar AND NOT (ct >= bt AND cr >= br) AND better >= 0.8 AND worst <= 0 AND cs >= bs)
    THEN candidate ELSE 'error' END AS recommended FROM p"""))
def official_evaluation(spark, folder):
    out = E.official_evaluation(
        modes_with_scans(spark, folder), "mode", "group_id", "error", F.length("mode"), 200, 3)
    return out.select("candidate", "candidate_average_rank", "baseline_average_rank",
                      r6("candidate_translation").alias("candidate_translation"),
                      r6("baseline_translation").alias("baseline_translation"), r6("better").alias("better"),
                      "worst_rank_delta", "candidate_selections", "baseline_selections", "recommended")


LIMITS = [0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0]
GATE_SQL = f"""g AS (SELECT threshold, truth FROM risk, (SELECT unnest({LIMITS}::DOUBLE[]) AS threshold) WHERE predicted <= threshold),
grid AS (SELECT threshold, count(*) AS true_count, avg(truth) AS true_mean, quantile_cont(truth, 0.5) AS true_median,
  quantile_cont(truth, 0.9) AS true_p90, max(truth) AS true_max, avg((truth <= 2)::INTEGER) AS true_le_2, avg((truth <= 3)::INTEGER) AS true_le_3,
  count(*) / (SELECT count(*) FROM risk)::DOUBLE AS coverage FROM g GROUP BY 1)"""


@query("gate_calibration", with_sql(RISK_SQL, GATE_SQL, body="""
SELECT threshold, true_count, round(true_mean, 6) AS true_mean, round(true_median, 6) AS true_median, round(true_p90, 6) AS true_p90,
  round(true_max, 6) AS true_max, round(true_le_2, 6) AS true_le_2, round(true_le_3, 6) AS true_le_3, round(coverage, 6) AS coverage FROM grid"""))
def gate_calibration(spark, folder):
    out = E.gate_calibration(risk_rows(spark, folder), "predicted", "truth", LIMITS)
    return out.select(*[r6(c).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("recommended_gate", with_sql(RISK_SQL, GATE_SQL, body="""
SELECT threshold, true_count, round(coverage, 6) AS coverage FROM grid WHERE true_count >= 8 AND true_p90 <= 3.7 AND true_le_3 >= 0.7
ORDER BY coverage DESC, threshold LIMIT 1"""))
def recommended_gate(spark, folder):
    grid = E.gate_calibration(risk_rows(spark, folder), "predicted", "truth", LIMITS)
    return E.recommended_gate(grid, 8, 3.7, 0.7).select("threshold", "true_count", r6("coverage").alias("coverage"))


CAPS, GAINS = [1.0, 2.0, 3.0, 4.0], [0.0, 0.5, 1.0]
ROUTES_SQL = f"""routes AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'O' THEN 'upper' ELSE 'lower' END AS jaw,
  'c' || (o_custkey % 60) AS group_id, (o_totalprice % 500.0::DOUBLE) / 100 AS first_predicted, (o_totalprice % 700.0::DOUBLE) / 100 AS second_predicted,
  (o_orderkey % 97) / 20.0::DOUBLE AS first_error, (o_custkey % 89) / 20.0::DOUBLE AS second_error FROM orders),
rg AS (SELECT *, first_predicted <= cap AND second_predicted - first_predicted >= advantage AS takes_first
  FROM routes, (SELECT unnest({CAPS}::DOUBLE[]) AS cap), (SELECT unnest({GAINS}::DOUBLE[]) AS advantage)),
re AS (SELECT *, CASE WHEN takes_first THEN first_error ELSE second_error END AS error FROM rg)"""


def route_rows(spark, folder):
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "upper").otherwise("lower").alias("jaw"),
        F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(60)).cast("string")).alias("group_id"),
        ((price % 500.0) / 100).alias("first_predicted"), ((price % 700.0) / 100).alias("second_predicted"),
        (F.pmod("o_orderkey", F.lit(97)) / 20.0).alias("first_error"), (F.pmod("o_custkey", F.lit(89)) / 20.0).alias("second_error"),
    )


@query("route_gate_grid", with_sql(ROUTES_SQL, body="""
SELECT jaw, cap, advantage, round(avg(error), 6) AS mean, round(quantile_cont(error, 0.5), 6) AS median,
  round(quantile_cont(error, 0.9), 6) AS p90, count(*) FILTER (WHERE takes_first) AS selections FROM re GROUP BY ALL"""))
def route_gate_grid(spark, folder):
    out = E.route_gate_grid(route_rows(spark, folder), ["jaw"], CAPS, GAINS)
    return out.withColumns({c: r6(c) for c in ("mean", "median", "p90")})


@query("nested_route_gate", with_sql(ROUTES_SQL, """gr AS (SELECT DISTINCT group_id AS held FROM routes),
t AS (SELECT held, jaw, cap, advantage, round(avg(error), 9) AS m, quantile_cont(error, 0.9) AS p, count(*) FILTER (WHERE takes_first) AS sel
  FROM re JOIN gr ON group_id <> held GROUP BY ALL)""", body="""
SELECT jaw, held AS group_id, cap, advantage, round(m, 6) AS mean, round(p, 6) AS p90, sel AS selections FROM (
  SELECT *, row_number() OVER (PARTITION BY jaw, held ORDER BY m, round(p, 9), sel, advantage, cap) AS r FROM t) WHERE r = 1"""))
def nested_route_gate(spark, folder):
    out = E.nested_route_gate(route_rows(spark, folder), ["jaw"], "group_id", ["case_id"], CAPS, GAINS)
    return out.withColumns({c: r6(c) for c in ("mean", "p90")})


@query("retry_trigger", with_sql(RISK_SQL, body="""
SELECT case_id, CASE WHEN case_id % 2 = 0 THEN predicted > 3 OR truth > 3.5 ELSE predicted > 2 OR truth > 3.8 END AS retry FROM risk"""))
def retry_trigger(spark, folder):
    rows = risk_rows(spark, folder)
    jaw = F.when(F.pmod("case_id", F.lit(2)) == 0, "upper").otherwise("lower")
    flag = E.needs_retry(F.col("predicted"), F.col("truth"), jaw, {"upper": (3.0, 3.5), "lower": (2.0, 3.8)})
    return rows.select("case_id", flag.alias("retry"))


@query("seed_dispersion", """
WITH v AS (SELECT o_custkey AS case_id, CASE WHEN o_totalprice % 7 < 1 THEN NULL ELSE o_totalprice END AS p FROM orders)
SELECT case_id, count(p) AS finite, round(avg(p), 3) AS mean, round(stddev_pop(p), 3) AS spread, round(quantile_cont(p, 0.5), 3) AS median
FROM v WHERE p IS NOT NULL GROUP BY 1""")
def seed_dispersion(spark, folder):
    from .bindings import rounded

    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.when(F.col("o_totalprice") % 7 < 1, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("p"),
    )
    out = S.dispersion(rows, ["case_id"], "p")
    return out.select("case_id", "finite", *[rounded(c, 3).alias(c) for c in ("mean", "spread", "median")])


@query("epoch_means", """
SELECT turn, role, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY ALL""")
def epoch_means(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("mean_length", F.length("text").cast("double"))
    out = S.metric_means(rows, ["turn", "role"], ["mean_length"])
    return out.withColumn("mean_length", r6("mean_length"))


@query("best_checkpoint", """
WITH e AS (SELECT event_type AS member, user_id AS epoch, avg(value) AS dice, max(value) AS top FROM events GROUP BY ALL)
SELECT member, count(*) AS epochs, arg_min(epoch, (-dice, epoch)) AS best_epoch, round(max(dice), 6) AS dice,
  arg_min(top, (-dice, epoch)) AS top FROM e GROUP BY 1""")
def best_checkpoint(spark, folder):
    log = table(spark, folder, "events").groupBy(
        F.col("event_type").alias("member"), F.col("user_id").alias("epoch")
    ).agg(F.avg("value").alias("dice"), F.max("value").alias("top"))
    out = S.best_checkpoint(log, "member", "epoch", "dice", ["top"])
    return out.withColumn("dice", r6("dice"))


@query("config_summary", with_sql(CANDIDATES_SQL, body="""
SELECT source_variant, target, round(avg(mean_tre_mm), 6) AS mean, min(mean_tre_mm) AS minimum, round(quantile_cont(mean_tre_mm, 0.5), 6) AS median
FROM cand GROUP BY ALL"""))
def config_summary(spark, folder):
    out = S.config_summary(candidates(spark, folder), ["source_variant", "target"], "mean_tre_mm")
    return out.withColumns({c: r6(c) for c in ("mean", "median")})


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, folder):
    return S.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])
