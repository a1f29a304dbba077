"""Content groups, folds, leakage rules, gates, templates and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K

from ..operators import consensus as Q
from ..operators import contents as C
from ..operators import grouping as G
from ..operators import selection as S
from ..operators import summaries as Z
from .bindings import (
    CANDIDATES_SQL, CONTENTS_SQL, GROUP, POINTS_SQL, POSED_SQL, TRUTHS_SQL, candidates, contents, points, posed, r6, rotation_z,
    rounded, table, truths, with_sql,
)
from .ranking_queries import EVIDENCE_SQL, evidence
from .registry import query


@query("content_groups", with_sql(CONTENTS_SQL, body="""
SELECT content_hash AS content_group, count(*) AS cases, min(case_id) AS first_case FROM contents GROUP BY 1"""))
def content_groups(spark, folder):
    groups = C.content_groups(contents(spark, folder), None, "case_id")
    return groups.groupBy("content_group").agg(F.count(F.lit(1)).alias("cases"), F.min("case_id").alias("first_case"))


SIGNED_SQL = """sg AS (SELECT content_hash AS content_group, CASE WHEN n_chars % 5 = 0 THEN -1 ELSE 1 END AS sign, case_id FROM contents),
gr AS (SELECT content_group, sign, count(*) AS size FROM sg GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY size DESC, sha256('11|' || content_group), content_group) - 1 AS p FROM gr)"""


@query("grouped_folds", with_sql(CONTENTS_SQL, SIGNED_SQL, body="""
SELECT content_group, sign, size, CASE WHEN p % 10 < 5 THEN p % 10 ELSE 9 - p % 10 END AS fold FROM rk"""))
def grouped_folds(spark, folder):
    cases = contents(spark, folder).select(
        F.col("content_hash").alias("content_group"), F.when(F.pmod("n_chars", F.lit(5)) == 0, -1).otherwise(1).alias("sign"))
    return C.grouped_folds(cases, "content_group", 5, 11, "sign")


@query("greedy_folds", "WITH RECURSIVE " + with_sql(CONTENTS_SQL, SIGNED_SQL, """od AS (SELECT *, row_number() OVER (ORDER BY sign, size DESC, sha256('11|' || content_group), content_group) AS n FROM gr),
dl AS (SELECT 0::BIGINT AS n, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL SELECT od.n, (list_position(loads, list_min(loads)) - 1)::INTEGER, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + size ELSE v END)
  FROM dl JOIN od ON od.n = dl.n + 1)""", body="""
SELECT content_group, sign, size, fold FROM od JOIN dl USING (n)""").removeprefix("WITH "))
def greedy_folds(spark, folder):
    cases = contents(spark, folder).select(
        F.col("content_hash").alias("content_group"), F.when(F.pmod("n_chars", F.lit(5)) == 0, -1).otherwise(1).alias("sign"))
    return C.greedy_folds(cases, "content_group", 5, 11, "sign")


PSEUDO_SQL = """pseudo AS (SELECT doc_id AS case_id, (doc_id * 7) % (SELECT count(*) FROM documents) AS source_case,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'exact' WHEN quality = 1 THEN 'geometry' WHEN toxic = 1 THEN 'threshold' ELSE 'cross' END AS teacher FROM labels)"""


def pseudo_rows(spark, folder):
    docs = table(spark, folder, "documents").count()
    teacher = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "exact").when(F.col("quality") == 1, "geometry").when(
        F.col("toxic") == 1, "threshold").otherwise("cross")
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("case_id"), (F.col("doc_id") * 7 % docs).alias("source_case"), teacher.alias("teacher"))


@query("leakage_safe_filter", with_sql(CONTENTS_SQL, PSEUDO_SQL, """held AS (SELECT DISTINCT content_hash FROM contents WHERE case_id % 5 = 0)""", body="""
SELECT p.case_id, p.source_case, teacher FROM pseudo p JOIN contents o ON o.case_id = p.case_id JOIN contents s ON s.case_id = p.source_case
WHERE o.content_hash NOT IN (SELECT content_hash FROM held) AND s.content_hash NOT IN (SELECT content_hash FROM held) AND teacher IN ('exact', 'geometry')"""))
def leakage_safe_filter(spark, folder):
    cont = contents(spark, folder)
    groups = C.content_groups(cont, None, "case_id")
    held = cont.where(F.pmod("case_id", F.lit(5)) == 0)
    out = C.leakage_safe(pseudo_rows(spark, folder), groups, held, "case_id", "source_case",
                         {"exact": True, "geometry": True, "cross": False}, default_kind=False)
    return out.select("case_id", "source_case", "teacher")


@query("gate_reasons", with_sql(CANDIDATES_SQL, body="""
SELECT candidate_run, coalesce(CASE WHEN source_variant = 'full' THEN 'method' WHEN mean_tre_mm > 8 THEN 'predicted_gate'
  WHEN jaw = 'upper' AND contains(target, 'component') AND mean_tre_mm > 5 THEN 'upper_tracked_gate' WHEN fit_p90_mm > 6 THEN 'p90_gate' END, 'accepted') AS reason,
  count(*) AS rows FROM cand GROUP BY ALL"""))
def gate_reasons(spark, folder):
    gates = [
        ("method", F.col("source_variant") == "full"), ("predicted_gate", F.col("mean_tre_mm") > 8),
        ("upper_tracked_gate", (F.col("jaw") == "upper") & F.contains("target", F.lit("component")) & (F.col("mean_tre_mm") > 5)),
        ("p90_gate", F.col("fit_p90_mm") > 6),
    ]
    out = C.gated(candidates(spark, folder), gates).withColumn("reason", F.coalesce("reason", F.lit("accepted")))
    return Z.counts_by(out, ["candidate_run", "reason"])


@query("bank_build", with_sql(CANDIDATES_SQL, """g AS (SELECT *, CASE WHEN mean_tre_mm > 6 THEN 'predicted_gate' WHEN fit_p90_mm > 6 THEN 'p90_gate' END AS reason FROM cand),
w AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY case_id, jaw, reason IS NULL ORDER BY candidate_run, candidate_index) END AS r FROM g)""", body="""
SELECT jaw, coalesce(reason, CASE WHEN r = 1 THEN 'accepted' ELSE 'already_present' END) AS reason, count(*) AS rows FROM w GROUP BY ALL"""))
def bank_build(spark, folder):
    rows = candidates(spark, folder).withColumn("row_id", F.struct(*GROUP, "candidate_index"))
    rows = C.gated(rows, [("predicted_gate", F.col("mean_tre_mm") > 6), ("p90_gate", F.col("fit_p90_mm") > 6)])
    accepted, rejected = C.first_wins(rows, GROUP, [F.col("candidate_run"), F.col("candidate_index")])
    both = accepted.withColumn("reason", F.lit("accepted")).unionByName(rejected)
    return Z.counts_by(both, ["jaw", "reason"])


MATCH_SQL = """d AS (SELECT doc_id, lang AS jaw, sha256(text) AS raw_hash, sha256(lower(text)) AS payload_hash, n_chars AS vertex_count, (doc_id % 3)::BIGINT AS pr FROM documents),
q AS (SELECT * FROM d WHERE doc_id % 2 = 1), b AS (SELECT * FROM d WHERE doc_id % 2 = 0),
h AS (SELECT q.doc_id, q.jaw, b.doc_id AS entry, b.pr, 0 AS k, 'raw' AS kind FROM q JOIN b USING (jaw, raw_hash) UNION ALL
  SELECT q.doc_id, q.jaw, b.doc_id, b.pr, 1, 'payload' FROM q JOIN b USING (jaw, payload_hash) UNION ALL
  SELECT q.doc_id, q.jaw, b.doc_id, b.pr, 2, 'topology' FROM q JOIN b USING (jaw, vertex_count))"""


@query("content_match", with_sql(MATCH_SQL, body="""
SELECT doc_id, jaw, entry, kind AS match_kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, jaw ORDER BY k = 2, pr, entry, k) AS r FROM h) WHERE r = 1"""))
def content_match(spark, folder):
    rows = hashed_documents(spark, folder)
    even = F.pmod("doc_id", F.lit(2)) == 0
    bank = rows.where(even).withColumnRenamed("doc_id", "entry_id")
    hits = C.content_matches(rows.where(~even), bank, "doc_id", ["priority", "entry_id"], topology=True)
    best = C.best_match(hits, "doc_id", [F.col("_k") == 2, F.col("e_priority"), F.col("e_entry_id"), F.col("_k")])
    return best.select("doc_id", "jaw", F.col("e_entry_id").alias("entry"), "match_kind")


def hashed_documents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("jaw"), F.sha2("text", 256).alias("raw_hash"), F.sha2(F.lower("text"), 256).alias("payload_hash"),
        F.col("n_chars").alias("vertex_count"), F.pmod("doc_id", F.lit(3)).alias("priority"))


@query("bank_propagation", """
WITH d AS (SELECT doc_id, lang AS jaw, sha256(text) AS raw_hash, sha256(lower(text)) AS payload_hash FROM documents),
b AS (SELECT * FROM d WHERE doc_id % 10 = 0), q AS (SELECT * FROM d WHERE doc_id % 10 <> 0),
h AS (SELECT q.doc_id, q.jaw, b.doc_id AS entry, 0 AS k, 'raw' AS kind FROM q JOIN b USING (jaw, raw_hash) UNION ALL
  SELECT q.doc_id, q.jaw, b.doc_id, 1, 'payload' FROM q JOIN b USING (jaw, payload_hash))
SELECT doc_id, jaw, entry AS source_id, kind AS match_kind, 1 AS generation FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, jaw ORDER BY k, entry) AS r FROM h) WHERE r = 1""")
def bank_propagation(spark, folder):
    rows = hashed_documents(spark, folder)
    seed = F.pmod("doc_id", F.lit(10)) == 0
    out = C.propagate_exact(rows.where(seed).withColumnRenamed("doc_id", "entry_id"), rows.where(~seed), "doc_id")
    return out.select("doc_id", "jaw", "source_id", "match_kind", "generation")


@query("template_match", with_sql(POINTS_SQL, """q AS (SELECT c_custkey AS query_id, c_custkey % 10 AS s, c_custkey % 360 AS turn FROM customer),
cnt AS (SELECT set_id FROM points GROUP BY 1 HAVING count(*) >= 3)""", body="""
SELECT query_id, s::VARCHAR AS reference_case, 'raw' AS match_kind, round(cos(radians((s * 10 - turn)::DOUBLE)), 5) AS m00, round(sin(radians((s * 10 - turn)::DOUBLE)), 5) AS m10,
  0.0::DOUBLE AS rms_mm, 1.0::DOUBLE AS transfer_confidence FROM q JOIN cnt ON set_id = s::VARCHAR"""))
def template_match(spark, folder):
    """Every customer is a query mesh: the points of one set, turned; banks hold two entries per set."""
    p = points(spark, folder)
    idx = G.positions(p, ["set_id"], [F.col("point_id")], "idx", "n")
    sets = idx.groupBy("set_id").agg(F.max("n").alias("vertex_count"), F.sha2(F.concat_ws(",", F.sum("x"), F.sum("y"), F.sum("z")), 256).alias("mesh"))
    turn = F.col("set_id").cast("double") * 10.0
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(pr).alias("kind_priority"), F.lit(e).alias("predicted_tre_mm"))
                                for k, pr, e in (("labeled", 0, 0.0), ("geometry", 2, 1.5))]))
    bank = sets.withColumn("_k", kinds).select(
        F.concat_ws("/", "set_id", "_k.kind").alias("entry_id"), F.lit("upper").alias("jaw"), F.sha2("set_id", 256).alias("raw_hash"),
        F.sha2(F.concat(F.lit("p"), F.col("set_id")), 256).alias("payload_hash"), "vertex_count", "mesh", "_k.kind_priority",
        "_k.predicted_tre_mm", F.lit(1.0).alias("confidence"), rotation_z(turn, F.lit(1.0), [F.lit(0.0)] * 3).alias("reference_transform"))
    bank_points = idx.withColumn("_e", F.explode(F.array(F.lit("labeled"), F.lit("geometry")))).select(
        F.concat_ws("/", "set_id", "_e").alias("entry_id"), "idx", "x", "y", "z")
    cust = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("query_id"), F.lit("upper").alias("jaw"), F.pmod("c_custkey", F.lit(10)).cast("string").alias("set_id"),
        F.pmod("c_custkey", F.lit(360)).cast("double").alias("turn"))
    queries = cust.join(sets, "set_id").select(
        "query_id", "jaw", F.sha2("set_id", 256).alias("raw_hash"), F.sha2(F.concat(F.lit("p"), F.col("set_id")), 256).alias("payload_hash"), "vertex_count",
        F.col("set_id").alias("mesh_id"), rotation_z(F.col("turn"), F.lit(1.0), [F.lit(0.0)] * 3).alias("pose"))
    out = C.template_match(queries, idx.withColumnRenamed("set_id", "mesh_id"), bank, bank_points, "query_id")
    return out.select("query_id", F.substring_index("e_entry_id", "/", 1).alias("reference_case"), "match_kind",
                      rounded(F.col("transform")[0], 5).alias("m00"), rounded(F.col("transform")[4], 5).alias("m10"),
                      rounded("rms_mm", 5).alias("rms_mm"), rounded("transfer_confidence", 5).alias("transfer_confidence"))


@query("teacher_lookup", """
WITH c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS own FROM customer),
p AS (SELECT o_custkey AS case_id, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
l AS (SELECT o_custkey AS case_id, max(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT case_id, CASE WHEN own IS NOT NULL THEN 'self' WHEN p.v IS NOT NULL THEN 'pseudo' ELSE 'labelled' END AS teacher_route,
  round(coalesce(own, p.v, l.v), 4) AS value FROM c LEFT JOIN p USING (case_id) LEFT JOIN l USING (case_id) WHERE coalesce(own, p.v, l.v) IS NOT NULL""")
def teacher_lookup(spark, folder):
    own = F.when(F.pmod("c_custkey", F.lit(4)) == 0, F.array("c_acctbal"))
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("case_id"), own.alias("own"))
    orders = table(spark, folder, "orders")

    def side(where):
        return orders.where(where).groupBy(F.col("o_custkey").alias("case_id")).agg(
            F.array(F.max("o_totalprice")).alias("transform"))

    out = C.lookup_teacher(rows, ["case_id"], side(F.col("o_orderstatus") == "O"), side(F.col("o_orderstatus") != "O"), "own")
    return out.select("case_id", "teacher_route", rounded(F.col("teacher_transform")[0], 4).alias("value"))


@query("resume_remaining", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def resume_remaining(spark, folder):
    done = table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.remaining(table(spark, folder, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("expected_groups", """
WITH e AS (SELECT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey + 3 AS k FROM orders)
SELECT coalesce(e.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'missing' ELSE 'extra' END AS status FROM e FULL JOIN o ON e.k = o.k WHERE e.k IS NULL OR o.k IS NULL""")
def expected_groups(spark, folder):
    e = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, folder, "orders").select((F.col("o_custkey") + 3).alias("k"))
    return C.expected_report(e, o, ["k"])


@query("common_keys", """
SELECT l_suppkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def common_keys(spark, folder):
    return C.common_keys(table(spark, folder, "lineitem"), "l_returnflag", ["l_suppkey", "l_linenumber"])


@query("hash_reconciliation", """
WITH d AS (SELECT page_id AS k, sha256(html) AS h FROM pages WHERE page_id % 10 <> 3 UNION ALL SELECT page_id, sha256(html) FROM pages WHERE page_id % 50 = 0),
dd AS (SELECT k, count(*) AS n, min(h) AS h FROM d GROUP BY 1),
a AS (SELECT page_id AS k, CASE WHEN page_id % 20 = 1 THEN sha256(url) ELSE sha256(html) END AS h FROM pages WHERE page_id % 10 <> 7)
SELECT coalesce(dd.k, a.k) AS k, CASE WHEN n > 1 THEN 'duplicate' WHEN a.h IS NULL THEN 'missing' WHEN dd.h IS NULL THEN 'extra' WHEN dd.h <> a.h THEN 'mismatch' ELSE 'ok' END AS status
FROM dd FULL JOIN a ON dd.k = a.k""")
def hash_reconciliation(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("k"), "url", "html")
    plain = pages.select("k", F.sha2("html", 256).alias("digest"))
    declared = plain.where(F.pmod("k", F.lit(10)) != 3).unionByName(plain.where(F.pmod("k", F.lit(50)) == 0))
    actual = pages.where(F.pmod("k", F.lit(10)) != 7).select(
        "k", F.sha2(F.when(F.pmod("k", F.lit(20)) == 1, F.col("url")).otherwise(F.col("html")), 256).alias("digest"))
    return C.reconcile(declared, actual, "k", "digest")


@query("last_writer_wins", """
WITH u AS (SELECT o_custkey AS k, max(o_totalprice) AS v, 0 AS part FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL
  SELECT o_custkey, max(o_totalprice), 1 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL
  SELECT o_custkey, max(o_totalprice), 2 FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 1)
SELECT k, arg_max(v, part) AS v FROM u GROUP BY 1""")
def last_writer_wins(spark, folder):
    orders = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    parts = [orders.where(w).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
             for w in (status == "F", status == "P", ~status.isin("F", "P"))]
    return S.last_writer_wins(parts, ["k"])


@query("run_concat", with_sql(CANDIDATES_SQL, body="""
SELECT candidate_run, count(*) AS rows, count(CASE WHEN candidate_run <> 'A' THEN turn_deg END) AS with_turn FROM cand GROUP BY 1"""))
def run_concat(spark, folder):
    rows = candidates(spark, folder)
    run = F.col("candidate_run")
    parts = [rows.where(w) for w in (run == "A", run == "N", ~run.isin("A", "N"))]
    parts[0] = parts[0].drop("turn_deg")
    out = S.concat_runs(parts)
    return out.groupBy("candidate_run").agg(F.count(F.lit(1)).alias("rows"), F.count("turn_deg").alias("with_turn"))


@query("route_cascade", with_sql(CANDIDATES_SQL, """w AS (SELECT case_id, jaw, min(mean_tre_mm) FILTER (WHERE source_variant = 'full' AND mean_tre_mm <= 1) AS a,
  min(fit_p90_mm) FILTER (WHERE contains(target, 'adaptive') AND fit_p90_mm <= 2) AS b, min(selection_score_mm) AS c FROM cand GROUP BY ALL)""", body="""
SELECT jaw, CASE WHEN a IS NOT NULL THEN 'template' WHEN b IS NOT NULL THEN 'surface' ELSE 'ranked' END AS route, count(*) AS rows, round(avg(coalesce(a, b, c)), 6) AS mean_value
FROM w GROUP BY ALL"""))
def route_cascade(spark, folder):
    rows = candidates(spark, folder)

    def route(where, column):
        return rows.where(where).groupBy(*GROUP).agg(F.min(column).alias("value"))

    routes = [
        ("template", route((F.col("source_variant") == "full") & (F.col("mean_tre_mm") <= 1), "mean_tre_mm")),
        ("surface", route(F.contains("target", F.lit("adaptive")) & (F.col("fit_p90_mm") <= 2), "fit_p90_mm")),
        ("ranked", route(F.lit(True), "selection_score_mm")),
    ]
    out = C.route_cascade(routes, GROUP, ["value"])
    return out.groupBy("jaw", "route").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("value")).alias("mean_value"))


@query("epoch_sample", """
WITH p AS (SELECT doc_id FROM labels WHERE quality = 1), l AS (SELECT doc_id FROM labels WHERE quality = 0), e AS (SELECT unnest([0, 1, 2]) AS epoch),
d AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY sha256('4p|' || epoch || '|' || doc_id), doc_id) AS r FROM p, e),
u AS (SELECT epoch, doc_id, true AS pseudo FROM d WHERE r <= round_even(0.25::DOUBLE * (SELECT count(*) FROM p), 0) UNION ALL SELECT epoch, doc_id, false FROM l, e)
SELECT epoch, doc_id, pseudo, row_number() OVER (PARTITION BY epoch ORDER BY sha256('4o|' || epoch || '|' || doc_id), pseudo::INTEGER, doc_id) AS place FROM u""")
def epoch_sample(spark, folder):
    labels = table(spark, folder, "labels")
    return C.epoch_sample(labels.where("quality = 0"), labels.where("quality = 1"), "doc_id", 3, 0.25, 4)


@query("bank_audit", with_sql(CANDIDATES_SQL, body="""
SELECT candidate_run, count(*) AS entries, count(*) FILTER (WHERE mean_tre_mm > 3 + 1e-8) AS over_gate FROM cand GROUP BY 1"""))
def bank_audit(spark, folder):
    return C.bank_audit(candidates(spark, folder).withColumnRenamed("mean_tre_mm", "predicted_tre_mm"), "candidate_run", 3.0)


@query("prediction_filter", """
WITH p AS (SELECT c_custkey AS case_id, (c_custkey * 37) % 5000 AS u, (c_custkey * 53) % 5000 AS l, (c_acctbal % 100.0::DOUBLE) / 100 AS conf, (c_custkey % 50) / 50.0::DOUBLE AS ent FROM customer)
SELECT case_id, round(conf - 0.35::DOUBLE * ent - 0.08::DOUBLE * (abs(ln(greatest(u, 1) / 2200.0::DOUBLE)) + abs(ln(greatest(l, 1) / 2200.0::DOUBLE))), 6) AS score
FROM p WHERE u BETWEEN 500 AND 4500 AND l BETWEEN 500 AND 4500 AND conf >= 0.2 AND ent <= 0.8""")
def prediction_filter(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("case_id"), (F.col("c_custkey") * 37 % 5000).alias("u"), (F.col("c_custkey") * 53 % 5000).alias("l"),
        ((F.col("c_acctbal") % 100.0) / 100).alias("conf"), ((F.col("c_custkey") % 50) / 50.0).alias("ent"))
    kept = rows.where(F.col("u").between(500, 4500) & F.col("l").between(500, 4500) & (F.col("conf") >= 0.2) & (F.col("ent") <= 0.8))
    return kept.select("case_id", r6(K.prediction_score("conf", "ent", "u", "l")).alias("score"))


@query("consensus_confidence", with_sql(CANDIDATES_SQL, body="""
SELECT case_id, jaw, round(pow(exp(-max(fit_p90_mm) / 2) * exp(-min(mean_tre_mm) / 2) * exp(-min(fit_score_mm) / 0.6::DOUBLE) * exp(-max(fit_p90_mm) / 2)
  * least(1.0::DOUBLE, min(target_coverage_2mm) / 0.6::DOUBLE), 0.2::DOUBLE), 6) AS confidence, round(exp(-0.5::DOUBLE * pow(max(fit_p90_mm) / 2 / 1.5::DOUBLE, 2)), 6) AS agreement
FROM cand GROUP BY ALL"""))
def consensus_confidence(spark, folder):
    per = candidates(spark, folder).groupBy(*GROUP).agg(
        F.max("fit_p90_mm").alias("p90"), F.min("mean_tre_mm").alias("rank"), F.min("fit_score_mm").alias("fit"), F.min("target_coverage_2mm").alias("cover"))
    return per.select(*GROUP, r6(K.consensus_confidence("p90", "rank", "fit", "p90", "cover")).alias("confidence"),
                      r6(K.agreement("p90", F.lit(2.0), 1.5)).alias("agreement"))


@query("pseudo_targets", with_sql(CANDIDATES_SQL, POSED_SQL, TRUTHS_SQL, POINTS_SQL, """sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY sha256('1|' || set_id || '|' || point_id), point_id) AS r FROM points) WHERE r <= 6),
d AS (SELECT case_id, jaw, candidate_index, sqrt(
   pow((transform[1]-truth[1])*x + (transform[2]-truth[2])*y + transform[4]-truth[4], 2) + pow((transform[5]-truth[5])*x + (transform[6]-truth[6])*y + transform[8]-truth[8], 2)
   + pow(transform[12]-truth[12], 2)) AS g FROM posed JOIN truths USING (case_id) JOIN sp ON sp.set_id = (case_id % 10)::VARCHAR WHERE case_id % 20 <> 0)""", body="""
SELECT case_id, jaw, candidate_index, round(sqrt(pow(avg(g), 2) + pow((any_value(case_id) % 3)::DOUBLE, 2)), 5) AS pseudo_tre_mm FROM d GROUP BY case_id, jaw, candidate_index"""))
def pseudo_targets(spark, folder):
    from ..operators.spatial import hashed_sample

    label = truths(spark, folder).withColumn("jaw", F.explode(F.array(F.lit("upper"), F.lit("lower")))).select(
        "case_id", "jaw", F.col("truth").alias("transform"), F.pmod("case_id", F.lit(3)).cast("double").alias("predicted_tre_mm"),
        F.when(F.pmod("case_id", F.lit(20)) == 0, 0.1).otherwise(0.9).alias("confidence"), F.pmod("case_id", F.lit(10)).cast("string").alias("set_id"))
    few = hashed_sample(points(spark, folder), ["set_id"], "point_id", 6, 1)
    out = C.pseudo_targets(posed(candidates(spark, folder)), label, few, GROUP, "set_id", "hypot", 0.5)
    return out.select(*GROUP, "candidate_index", rounded("pseudo_tre_mm", 5).alias("pseudo_tre_mm"))


@query("candidate_transfer", with_sql(CANDIDATES_SQL, POSED_SQL, """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS r FROM posed) WHERE r <= 2)""", body="""
SELECT case_id + 1000000 AS query_case, jaw, candidate_index, round(transform[4] + transform[1], 5) AS tx, round(transform[8] + transform[5], 5) AS ty FROM t WHERE case_id % 2 = 0"""))
def candidate_transfer(spark, folder):
    rows = posed(candidates(spark, folder))
    unit = rotation_z(F.lit(0.0), F.lit(1.0), [F.lit(1.0), F.lit(0.0), F.lit(0.0)])
    links = rows.where(F.pmod("case_id", F.lit(2)) == 0).select(*GROUP).distinct().withColumn(
        "query_case", F.col("case_id") + 1000000).withColumn("query_to_source", unit)
    out = C.transfer_candidates(rows, links, GROUP, ["mean_tre_mm"], "selection_score_mm", 2)
    return out.select("query_case", "jaw", "candidate_index", rounded(F.col("transform")[3], 5).alias("tx"), rounded(F.col("transform")[7], 5).alias("ty"))


SAMPLE_SQL = """sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY sha256('2|' || set_id || '|' || point_id), point_id) AS r FROM points) WHERE r <= 4)"""


def sampled_poses(spark, folder, rows):
    packs = Q.packed_sample(points(spark, folder), ["set_id"], 4, 2)
    return rows.withColumn("set_id", F.pmod("case_id", F.lit(10)).cast("string")).join(F.broadcast(packs) if packs.limit(1001).count() <= 1000 else packs, "set_id")


@query("pose_pairs", with_sql(CANDIDATES_SQL, POSED_SQL, POINTS_SQL, SAMPLE_SQL, """
g AS (SELECT a.case_id, a.jaw, a.candidate_index, b.candidate_index AS other, avg(sqrt(
   pow((a.transform[1]-b.transform[1])*x + (a.transform[2]-b.transform[2])*y + a.transform[4]-b.transform[4], 2) + pow((a.transform[5]-b.transform[5])*x + (a.transform[6]-b.transform[6])*y + a.transform[8]-b.transform[8], 2)
   + pow(a.transform[12]-b.transform[12], 2))) AS gap FROM posed a JOIN posed b ON a.case_id = b.case_id AND a.jaw = b.jaw AND a.chirality = b.chirality
   AND abs(a.transform[4] - b.transform[4]) <= 8 JOIN sp ON sp.set_id = (a.case_id % 10)::VARCHAR GROUP BY ALL)""", body="""
SELECT case_id, jaw, candidate_index, other, round(gap, 5) AS gap_mm FROM g WHERE gap <= 6"""))
def pose_pairs(spark, folder):
    rows = sampled_poses(spark, folder, posed(candidates(spark, folder)))
    return Q.pose_pairs(rows, GROUP, 6.0).withColumn("gap_mm", rounded("gap_mm", 5))


@query("evidence_consensus")
def evidence_consensus(spark, folder):
    rows = sampled_poses(spark, folder, posed(evidence(candidates(spark, folder))))
    rows = rows.withColumn("view", F.col("candidate_run")).withColumn("selection", F.col("selection_score_mm"))
    out = Q.evidence_consensus(rows, GROUP, 6.0, 40.0, {"evidence": 2, "views": 2})
    return out.withColumns({c: rounded(c, 5) for c in ("mean_disagreement_mm", "max_disagreement_mm", "objective")})


@query("consistent_cluster", with_sql(CANDIDATES_SQL, POSED_SQL, POINTS_SQL, SAMPLE_SQL, """w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, jaw, candidate_run ORDER BY fit_score_mm, candidate_index) AS rr FROM posed) WHERE rr = 1),
g AS (SELECT a.case_id, a.jaw, a.candidate_run AS ra, b.candidate_run AS rb, avg(sqrt(
   pow((a.transform[1]-b.transform[1])*x + (a.transform[2]-b.transform[2])*y + a.transform[4]-b.transform[4], 2) + pow((a.transform[5]-b.transform[5])*x + (a.transform[6]-b.transform[6])*y + a.transform[8]-b.transform[8], 2)
   + pow(a.transform[12]-b.transform[12], 2))) AS gap FROM w a JOIN w b ON a.case_id = b.case_id AND a.jaw = b.jaw AND a.chirality = b.chirality AND a.candidate_run < b.candidate_run
   JOIN sp ON sp.set_id = (a.case_id % 10)::VARCHAR GROUP BY ALL HAVING avg(sqrt(
   pow((a.transform[1]-b.transform[1])*x + (a.transform[2]-b.transform[2])*y + a.transform[4]-b.transform[4], 2) + pow((a.transform[5]-b.transform[5])*x + (a.transform[6]-b.transform[6])*y + a.transform[8]-b.transform[8], 2)
   + pow(a.transform[12]-b.transform[12], 2))) <= 15),
f AS (SELECT case_id, jaw, 3 AS size, avg(gap) AS mg, 'A,N,R' AS runs FROM g GROUP BY ALL HAVING count(*) = 3 UNION ALL SELECT case_id, jaw, 2, gap, ra || ',' || rb FROM g)""", body="""
SELECT case_id, jaw, size, round(mg, 5) AS mean_gap_mm, runs FROM (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY size DESC, round(mg, 9), runs) AS r FROM f) WHERE r = 1"""))
def consistent_cluster(spark, folder):
    rows = posed(candidates(spark, folder))
    per_run = S.first_per_key(rows, [*GROUP, "candidate_run"], [F.col("fit_score_mm"), F.col("candidate_index")])
    rows = sampled_poses(spark, folder, per_run)
    out = Q.consistent_cluster(rows, GROUP, "candidate_run", ["A", "N", "R"], 15.0, 2)
    return out.withColumn("mean_gap_mm", rounded("mean_gap_mm", 5))


@query("cross_family_sweep", with_sql(CANDIDATES_SQL, POSED_SQL, """fa AS (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS place FROM posed WHERE contains(target, 'component')),
fb AS (SELECT *, row_number() OVER (PARTITION BY case_id, jaw ORDER BY selection_score_mm, candidate_index) AS place FROM posed WHERE contains(target, 'adaptive')),
a AS (SELECT *, count(*) OVER (PARTITION BY case_id, jaw) AS pool FROM fa WHERE place <= 4), b AS (SELECT *, count(*) OVER (PARTITION BY case_id, jaw) AS pool FROM fb WHERE place <= 4),
an AS (SELECT unnest([[0,0,0],[20,0,0],[-20,0,0],[0,20,0],[0,-20,0],[0,0,20],[0,0,-20]]::DOUBLE[][]) AS o),
p AS (SELECT a.case_id, a.jaw, a.candidate_index AS ai, b.candidate_index AS bi, a.place AS ap, b.place AS bp, a.pool AS apool, b.pool AS bpool, avg(sqrt(
  pow((a.transform[1]-b.transform[1])*o[1] + (a.transform[2]-b.transform[2])*o[2] + a.transform[4]-b.transform[4], 2) + pow((a.transform[5]-b.transform[5])*o[1] + (a.transform[6]-b.transform[6])*o[2] + a.transform[8]-b.transform[8], 2)
  + pow(a.transform[12]-b.transform[12], 2))) AS gap FROM a JOIN b ON a.case_id = b.case_id AND a.jaw = b.jaw AND a.chirality = b.chirality, an GROUP BY ALL),
c AS (SELECT *, round(gap + weight * ((ap - 1) / greatest(least(apool, top) - 1, 1)::DOUBLE + (bp - 1) / greatest(least(bpool, top) - 1, 1)::DOUBLE), 9) AS cost
  FROM p, (SELECT unnest([2, 4]) AS top), (SELECT unnest([0.0, 1.0]::DOUBLE[]) AS weight) WHERE ap <= top AND bp <= top)""", body="""
SELECT case_id, jaw, top, weight, ai AS a_index, bi AS b_index, round(gap, 4) AS disagreement_mm FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, jaw, top, weight ORDER BY cost, round(gap, 9), ap, bp) AS r FROM c) WHERE r = 1"""))
def cross_family_sweep(spark, folder):
    """Matrices are made for the rows of the top lists alone, so none are sorted with the others."""
    rows = candidates(spark, folder).select(*GROUP, "candidate_index", "target", "selection_score_mm", "fit_p90_mm", "fit_score_mm", "chirality", "turn_deg")
    a, b = (posed(S.top_by_score(rows.where(F.contains("target", F.lit(family))), GROUP, "selection_score_mm", 4)) for family in ("component", "adaptive"))
    out = Q.cross_family_sweep(a, b, GROUP, [F.lit(0.0)] * 3, [2, 4], [0.0, 1.0])
    return out.select(*GROUP, "top", "weight", "a_index", "b_index", rounded("disagreement_mm", 4).alias("disagreement_mm"))
