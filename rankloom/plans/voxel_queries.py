"""Components, boundaries, class maps and resampling over the voxel view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import spatial as X
from ..operators import summaries as S
from ..operators import voxels as V
from .bindings import VOXELS_SQL, r6, rounded, voxels, with_sql
from .registry import query

CASE = ["case_id"]
AT = ["case_id", "i", "j", "k"]
AFFINE = (0.5, 0.0, 0.0, -3.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, -0.8, 4.0, 0.0, 0.0, 0.0, 1.0)
EXTENT = (24.0, 12.0, 15.0)
SHAPE = (51, 8, 20)


def mask(spark, folder, threshold=900.0):
    return voxels(spark, folder).where(F.col("hu") >= threshold)


@query("threshold_masks", with_sql(VOXELS_SQL, body="""
SELECT case_id, threshold, count(*) AS voxels, sum(i)::BIGINT AS sum_i FROM vox, (SELECT unnest([300.0, 600.0, 900.0]::DOUBLE[]) AS threshold)
WHERE hu >= threshold GROUP BY ALL"""))
def threshold_masks(spark, folder):
    out = V.threshold_masks(voxels(spark, folder), [300.0, 600.0, 900.0])
    return out.groupBy("case_id", "threshold").agg(F.count(F.lit(1)).alias("voxels"), F.sum("i").alias("sum_i"))


COMPONENTS_SQL = """m AS (SELECT case_id, i, j, k, row_number() OVER (ORDER BY case_id, i, j, k) AS node FROM vox WHERE hu >= 900),
e AS (SELECT a.node AS a, b.node AS b FROM m a JOIN m b ON a.case_id = b.case_id AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
reach AS (SELECT node AS a, node AS b FROM m UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
lab AS (SELECT a AS node, min(b) AS label FROM reach GROUP BY 1),
comp AS (SELECT m.*, label FROM m JOIN lab USING (node))"""


def components(spark, folder):
    return V.connected_components(mask(spark, folder), CASE, connectivity=6)


@query("connected_components", "WITH RECURSIVE " + with_sql(VOXELS_SQL, COMPONENTS_SQL, body="SELECT case_id, i, j, k, label FROM comp")[5:])
def connected_components(spark, folder):
    return components(spark, folder)


@query("connected_components_26")
def connected_components_26(spark, folder):
    out = V.connected_components(mask(spark, folder), CASE, connectivity=26)
    return V.component_sizes(out, CASE)


@query("large_components", "WITH RECURSIVE " + with_sql(VOXELS_SQL, COMPONENTS_SQL, """sz AS (SELECT case_id, label, count(*) AS n,
  row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, label) AS r FROM comp GROUP BY case_id, label HAVING count(*) >= 3)""", body="""
SELECT case_id, i, j, k, label FROM comp JOIN sz USING (case_id, label) WHERE r <= 4""")[5:])
def large_components(spark, folder):
    return V.large_components(mask(spark, folder), CASE, 3, 4, connectivity=6)


@query("boundary", with_sql(VOXELS_SQL, """m AS (SELECT case_id, i, j, k FROM vox WHERE hu >= 100),
n AS (SELECT a.case_id, a.i, a.j, a.k, count(*) AS c FROM m a JOIN m b ON a.case_id = b.case_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL)""",
body="SELECT case_id, i, j, k FROM n WHERE c < 27"))
def boundary(spark, folder):
    return V.boundary(mask(spark, folder, 100.0).select(*AT), CASE)


STATS_SQL = """st AS (SELECT case_id, label, count(*) AS voxels, min(i) AS li, max(i) AS hi, min(j) AS lj, max(j) AS hj, min(k) AS lk, max(k) AS hk FROM comp GROUP BY ALL),
wx AS (SELECT *, (hi - li) * 0.5::DOUBLE AS ex, (hj - lj) * 2.0::DOUBLE AS ey, (hk - lk) * 0.8::DOUBLE AS ez, 4 - 0.8::DOUBLE * (lk + hk) / 2 AS cz FROM st)"""


@query("component_stats", "WITH RECURSIVE " + with_sql(VOXELS_SQL, COMPONENTS_SQL, STATS_SQL, body="""
SELECT case_id, label, voxels, li AS lo_i, hk AS hi_k, round(ex, 6) AS extent_x, round(ey, 6) AS extent_y, round(ez, 6) AS extent_z, round(cz, 6) AS centre_z FROM wx""")[5:])
def component_stats(spark, folder):
    out = V.component_stats(components(spark, folder), CASE, AFFINE)
    return out.select("case_id", "label", "voxels", "lo_i", "hi_k", *[r6(c).alias(c) for c in ("extent_x", "extent_y", "extent_z", "centre_z")])


@query("arch_pair", "WITH RECURSIVE " + with_sql(VOXELS_SQL, COMPONENTS_SQL, STATS_SQL, """
sc AS (SELECT *, list_sort([greatest(ex, 0.5), greatest(ey, 0.5), greatest(ez, 0.5)]::DOUBLE[]) AS s FROM wx WHERE voxels * 0.8::DOUBLE >= 3
  AND greatest(ex, ey, ez, 0.5) >= 0.4::DOUBLE * 5),
ar AS (SELECT *, (abs(ln(s[1] / 3)) + abs(ln(s[2] / 4)) + abs(ln(s[3] / 5))) / 3 - 0.03::DOUBLE * ln(1 + voxels) AS score FROM sc),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9), label) AS place FROM ar) WHERE place <= 2),
ok AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY cz DESC, place) AS h FROM tp)""", body="""
SELECT case_id, label, round(score, 6) AS score, CASE WHEN h = 1 THEN 'upper' ELSE 'lower' END AS jaw FROM ok WHERE n = 2""")[5:])
def arch_pair(spark, folder):
    stats = V.component_stats(components(spark, folder), CASE, AFFINE)
    scored = V.arch_score(stats, (5.0, 3.0, 4.0), 0.8, least_mm3=3.0).withColumn("score", F.round("score", 9))
    out = V.anchor_pair(scored.withColumn("threshold", F.lit(900.0)), CASE, [900.0, 800.0])
    return out.select("case_id", "label", r6("score").alias("score"), "jaw")


@query("tracked_component", "WITH RECURSIVE " + with_sql(VOXELS_SQL, COMPONENTS_SQL, """an AS (SELECT case_id, i, j, k FROM vox WHERE p1 >= 0.3 AND k < 10),
ov AS (SELECT case_id, label, count(*) AS overlap FROM comp JOIN an USING (case_id, i, j, k) GROUP BY ALL)""", body="""
SELECT case_id, label, overlap FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overlap DESC, label) AS r FROM ov) WHERE r = 1""")[5:])
def tracked_component(spark, folder):
    anchor = voxels(spark, folder).where((F.col("p1") >= 0.3) & (F.col("k") < 10))
    return V.largest_overlap(components(spark, folder), anchor, CASE).select("case_id", "label", "overlap")


@query("region_crop")
def region_crop(spark, folder):
    stats = V.component_stats(components(spark, folder), CASE, AFFINE)
    scored = V.crop_score(stats, SHAPE).withColumn("score", F.round("score", 9))
    bounds = V.region_crop(scored, CASE, SHAPE, (0.5, 2.0, 0.8))
    inside = V.inside_bounds(voxels(spark, folder), bounds, CASE)
    counts = inside.groupBy(*CASE).agg(F.count(F.lit(1)).alias("voxels"))
    return bounds.join(counts, CASE).withColumn("cost", r6("cost"))


@query("best_component_voxels", "WITH RECURSIVE " + with_sql(VOXELS_SQL, COMPONENTS_SQL, """sz AS (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, label) AS r FROM comp GROUP BY case_id, label)""", body="""
SELECT case_id, n AS best, count(*) AS voxels FROM comp JOIN sz USING (case_id, label), (SELECT unnest([1, 2, 3]) AS n) WHERE r <= n GROUP BY ALL""")[5:])
def best_component_voxels(spark, folder):
    from ..operators.grouping import top_k

    labelled = components(spark, folder)
    ranked = top_k(V.component_sizes(labelled, CASE), CASE, [-F.col("voxels"), F.col("label")], 3, pos="place")
    grid = ranked.withColumn("best", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)]))).where(F.col("place") <= F.col("best"))
    return labelled.join(grid.select("case_id", "label", "best"), ["case_id", "label"]).groupBy("case_id", "best").agg(
        F.count(F.lit(1)).alias("voxels"))


WON_SQL = """won AS (SELECT *, 1 - p1 - p2 AS p0, CASE WHEN 1 - p1 - p2 >= p1 AND 1 - p1 - p2 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label,
  greatest(1 - p1 - p2, p1, p2) AS p FROM vox)"""


@query("winning_class", with_sql(VOXELS_SQL, WON_SQL, body="SELECT case_id, i, j, k, label, round(p, 6) AS p FROM won"))
def winning_class(spark, folder):
    return V.winning_class(voxels(spark, folder)).select(*AT, "label", r6("p").alias("p"))


@query("top_voxels", with_sql(VOXELS_SQL, WON_SQL, body="""
SELECT case_id, label, n AS requested, count(*) AS voxels, round(min(p), 6) AS lowest FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY p DESC, i, j, k) AS r FROM won WHERE label > 0), (SELECT unnest([10, 40, 200]) AS n)
WHERE r <= n GROUP BY ALL"""))
def top_voxels(spark, folder):
    out = V.top_voxels(voxels(spark, folder), CASE, [10, 40, 200])
    return out.groupBy("case_id", "label", "requested").agg(F.count(F.lit(1)).alias("voxels"), r6(F.min("p")).alias("lowest"))


CLASS_SQL = """cm AS (SELECT *, row_number() OVER (ORDER BY case_id, label, i, j, k) AS node FROM won WHERE label > 0 AND hu >= 100 AND p >= CASE label WHEN 1 THEN 0.38 ELSE 0.42 END),
ce AS (SELECT a.node AS a, b.node AS b FROM cm a JOIN cm b ON a.case_id = b.case_id AND a.label = b.label AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
cr AS (SELECT node AS a, node AS b FROM cm UNION SELECT cr.a, ce.b FROM cr JOIN ce ON cr.b = ce.a),
cl AS (SELECT a AS node, min(b) AS root FROM cr GROUP BY 1),
cz AS (SELECT case_id, label, root, count(*) AS n FROM cm JOIN cl USING (node) GROUP BY ALL HAVING count(*) >= 3),
cs AS (SELECT case_id, label, root FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY n DESC, root) AS r FROM cz) WHERE r <= 5)"""


@query("class_masks", "WITH RECURSIVE " + with_sql(VOXELS_SQL, WON_SQL, CLASS_SQL, body="""
SELECT case_id, label AS class, count(*) AS voxels, round(avg(p), 6) AS mean_p, round(abs(ln(count(*) / 2500.0::DOUBLE)), 6) AS rank_score
FROM cm JOIN cl USING (node) JOIN cs USING (case_id, label, root) GROUP BY ALL""")[5:])
def class_masks(spark, folder):
    out = V.class_masks(voxels(spark, folder), CASE, {1: 0.38, 2: 0.42}, 3, 5, minimum_hu=100.0)
    return out.groupBy("case_id", "class").agg(
        F.count(F.lit(1)).alias("voxels"), r6(F.avg("p")).alias("mean_p"),
        r6(V.support_rank(F.count(F.lit(1)))).alias("rank_score"))


@query("class_points", with_sql(VOXELS_SQL, WON_SQL, body="""
SELECT case_id, label, count(*) AS points, round(avg(0.5::DOUBLE * i - 3), 3) AS x, round(avg(2.0::DOUBLE * j + 1), 3) AS y, round(avg(4 - 0.8::DOUBLE * k), 3) AS z
FROM won WHERE label > 0 GROUP BY ALL"""))
def class_points(spark, folder):
    rows = V.to_world(V.winning_class(voxels(spark, folder)).where("label > 0"), AFFINE)
    return rows.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("points"), *[rounded(F.avg(c), 3).alias(c) for c in "xyz"])


@query("height_tails", with_sql(VOXELS_SQL, WON_SQL, """w AS (SELECT case_id, label, 4 - 0.8::DOUBLE * k AS z FROM won WHERE label > 0),
q AS (SELECT case_id, label, quantile_cont(z, 0.7) AS cut FROM w GROUP BY ALL)""", body="""
SELECT case_id, label, round(cut, 6) AS cut, count(*) AS points FROM w JOIN q USING (case_id, label) WHERE z >= cut - 1e-9 GROUP BY ALL"""))
def height_tails(spark, folder):
    from ..operators.grouping import join_null_safe, quantiles

    rows = V.to_world(V.winning_class(voxels(spark, folder)).where("label > 0"), AFFINE)
    keys = ["case_id", "label"]
    cut = quantiles(rows, keys, "z", {"cut": 0.7})
    out = join_null_safe(rows, cut, keys, "inner").where(F.col("z") >= F.col("cut") - 1e-9)
    return out.groupBy(*keys, r6("cut").alias("cut")).agg(F.count(F.lit(1)).alias("points"))


@query("probability_blend", with_sql(VOXELS_SQL, """f AS (SELECT case_id, i, j, k, 1 - p1 - p2 AS p0, p1, p2 FROM vox), s AS (SELECT case_id, i, j, k, 0.5::DOUBLE AS p0, 0.3::DOUBLE AS p1, 0.2::DOUBLE AS p2 FROM vox),
b AS (SELECT case_id, i, j, k, f.p0 * 0.5::DOUBLE + s.p0 * 0.5::DOUBLE AS a, f.p1 * 0.6::DOUBLE + s.p1 * 0.4::DOUBLE AS b, f.p2 * 0.7::DOUBLE + s.p2 * 0.3::DOUBLE AS c FROM f JOIN s USING (case_id, i, j, k))""",
body="SELECT case_id, i, j, k, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM b"))
def probability_blend(spark, folder):
    vox = voxels(spark, folder)
    first = vox.select(*AT, (1 - F.col("p1") - F.col("p2")).alias("p0"), "p1", "p2")
    second = vox.select(*AT, F.lit(0.5).alias("p0"), F.lit(0.3).alias("p1"), F.lit(0.2).alias("p2"))
    out = V.blend_probabilities(first, second, CASE, {"p0": 0.5, "p1": 0.6, "p2": 0.7})
    return out.select(*AT, *[rounded(c, 6).alias(c) for c in ("p0", "p1", "p2")])


@query("geometric_blend", with_sql(VOXELS_SQL, """b AS (SELECT case_id, i, j, k, exp(0.5::DOUBLE * ln(greatest(1 - p1 - p2, 1e-8)) + 0.5::DOUBLE * ln(0.5::DOUBLE)) AS a,
  exp(0.6::DOUBLE * ln(greatest(p1, 1e-8)) + 0.4::DOUBLE * ln(0.3::DOUBLE)) AS b, exp(0.7::DOUBLE * ln(greatest(p2, 1e-8)) + 0.3::DOUBLE * ln(0.2::DOUBLE)) AS c FROM vox)""",
body="SELECT case_id, i, j, k, round(a / (a + b + c), 5) AS p0, round(b / (a + b + c), 5) AS p1, round(c / (a + b + c), 5) AS p2 FROM b"))
def geometric_blend(spark, folder):
    vox = voxels(spark, folder)
    first = vox.select(*AT, (1 - F.col("p1") - F.col("p2")).alias("p0"), "p1", "p2")
    second = vox.select(*AT, F.lit(0.5).alias("p0"), F.lit(0.3).alias("p1"), F.lit(0.2).alias("p2"))
    out = V.blend_probabilities(first, second, CASE, {"p0": 0.5, "p1": 0.6, "p2": 0.7}, "geometric")
    return out.select(*AT, *[rounded(c, 5).alias(c) for c in ("p0", "p1", "p2")])


FOLDS_SQL = """fold AS (SELECT case_id, i, j, k, f, p1 * (1 - 0.1::DOUBLE * f) AS p1, p2 * (1 - 0.2::DOUBLE * f) AS p2 FROM vox, (SELECT unnest([0, 1, 2]) AS f)),
fp AS (SELECT *, 1 - p1 - p2 AS p0 FROM fold),
pv AS (SELECT case_id, i, j, k, avg(p0) AS a, avg(p1) AS b, avg(p2) AS c, (stddev_pop(p0) + stddev_pop(p1) + stddev_pop(p2)) / 3 AS s,
  greatest(count(*) FILTER (WHERE p0 >= p1 AND p0 >= p2), count(*) FILTER (WHERE NOT (p0 >= p1 AND p0 >= p2) AND p1 >= p2),
    count(*) FILTER (WHERE NOT (p0 >= p1 AND p0 >= p2) AND p1 < p2)) / 3.0::DOUBLE AS g FROM fp GROUP BY ALL)"""


@query("map_quality", with_sql(VOXELS_SQL, FOLDS_SQL, body="""
SELECT case_id, count(*) AS foreground_voxels, round(avg(greatest(a, b, c)), 5) AS foreground_confidence,
  round(avg(-(a * ln(greatest(a, 1e-8)) + b * ln(greatest(b, 1e-8)) + c * ln(greatest(c, 1e-8))) / ln(3)), 5) AS foreground_entropy,
  round(avg(s), 5) AS ensemble_disagreement, round(avg(g), 5) AS ensemble_consensus
FROM pv WHERE NOT (a >= b AND a >= c) GROUP BY 1"""))
def map_quality(spark, folder):
    f = F.col("fold")
    folds = voxels(spark, folder).withColumn("fold", F.explode(F.array(*[F.lit(n) for n in range(3)])))
    folds = folds.withColumn("p1", F.col("p1") * (1 - 0.1 * f)).withColumn("p2", F.col("p2") * (1 - 0.2 * f))
    out = V.map_quality(folds.withColumn("p0", 1 - F.col("p1") - F.col("p2")), CASE, "fold")
    return out.select("case_id", "foreground_voxels", *[rounded(c, 5).alias(c) for c in (
        "foreground_confidence", "foreground_entropy", "ensemble_disagreement", "ensemble_consensus")])


@query("label_volumes", with_sql(VOXELS_SQL, WON_SQL, body="""
SELECT case_id, count(*) FILTER (WHERE label = 1) AS upper_voxels, count(*) FILTER (WHERE label = 2) AS lower_voxels FROM won GROUP BY 1"""))
def label_volumes(spark, folder):
    return V.label_volumes(V.winning_class(voxels(spark, folder)), CASE)


@query("registration_ids", with_sql(VOXELS_SQL, WON_SQL, body="""
SELECT case_id, CASE label WHEN 1 THEN 1 WHEN 2 THEN 17 ELSE 0 END AS object_id, count(*) AS voxels FROM won GROUP BY ALL"""))
def registration_ids(spark, folder):
    rows = V.winning_class(voxels(spark, folder)).withColumn("object_id", V.registration_ids(F.col("label")))
    return S.counts_by(rows, ["case_id", "object_id"]).withColumnRenamed("rows", "voxels")


@query("dice", with_sql(VOXELS_SQL, WON_SQL, """t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 0 ELSE label END AS truth FROM won), c AS (SELECT unnest([1, 2]) AS cls)""", body="""
SELECT case_id, cls AS label, round((2.0::DOUBLE * count(*) FILTER (WHERE label = cls AND truth = cls) + 1) / (count(*) FILTER (WHERE label = cls) + count(*) FILTER (WHERE truth = cls) + 1), 6) AS dice
FROM t, c GROUP BY ALL"""))
def dice(spark, folder):
    won = V.winning_class(voxels(spark, folder)).select(*AT, "label")
    truth = won.withColumn("label", F.when(F.pmod("k", F.lit(3)) == 0, 0).otherwise(F.col("label")))
    return V.dice(won, truth, CASE).withColumn("dice", r6("dice"))


@query("distinct_masks", with_sql(VOXELS_SQL, """t AS (SELECT unnest([350.0, 400.0, 720.0, 750.0, 800.0]::DOUBLE[]) AS threshold),
m AS (SELECT case_id, threshold, sha256(string_agg(i || ',' || j || ',' || k, ';' ORDER BY i, j, k)) AS d FROM vox, t WHERE hu >= threshold GROUP BY ALL)""", body="""
SELECT case_id, threshold, min(threshold) OVER (PARTITION BY case_id, d) AS rep_threshold FROM m"""))
def distinct_masks(spark, folder):
    configs = V.threshold_masks(voxels(spark, folder), [350.0, 400.0, 720.0, 750.0, 800.0])
    _, mapping = V.distinct_masks(configs, CASE, ["threshold"])
    return mapping.select("case_id", "threshold", "rep_threshold")


@query("postprocess_sweep", with_sql(VOXELS_SQL, WON_SQL, """t AS (SELECT unnest([0.3, 0.4, 0.5]::DOUBLE[]) AS threshold),
p AS (SELECT case_id, i, j, k, label, threshold FROM won, t WHERE label > 0 AND p >= threshold),
tr AS (SELECT case_id, label, count(*) AS n FROM won WHERE label > 0 AND k % 3 <> 0 GROUP BY ALL),
g AS (SELECT case_id, label, threshold, count(*) AS n, count(*) FILTER (WHERE k % 3 <> 0) AS o FROM p GROUP BY ALL)""", body="""
SELECT threshold, round(avg((2.0::DOUBLE * o + 1) / (g.n + tr.n + 1)), 6) AS mean, round(min((2.0::DOUBLE * o + 1) / (g.n + tr.n + 1)), 6) AS minimum,
  round(quantile_cont((2.0::DOUBLE * o + 1) / (g.n + tr.n + 1), 0.5), 6) AS median FROM g JOIN tr USING (case_id, label) GROUP BY 1"""))
def postprocess_sweep(spark, folder):
    won = V.winning_class(voxels(spark, folder)).where("label > 0")
    truth = won.where(F.pmod("k", F.lit(3)) != 0).select(*AT, "label")
    sweep = V.threshold_masks(won, [0.3, 0.4, 0.5], "p")
    chosen, mapping = V.distinct_masks(sweep.withColumnRenamed("label", "class"), ["case_id", "class"], ["threshold"])
    per = chosen.groupBy("case_id", "class", "threshold").agg(F.count(F.lit(1)).alias("n"))
    hits = chosen.join(truth.withColumnRenamed("label", "class"), ["case_id", "class", "i", "j", "k"]).groupBy(
        "case_id", "class", "threshold").agg(F.count(F.lit(1)).alias("o"))
    size = truth.groupBy("case_id", F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("t"))
    score = per.join(hits, ["case_id", "class", "threshold"], "left").join(size, ["case_id", "class"])
    score = score.withColumn("dice", (2.0 * F.coalesce("o", F.lit(0)) + 1) / (F.col("n") + F.col("t") + 1))
    back = mapping.join(score.select("case_id", "class", F.col("threshold").alias("rep_threshold"), "dice"), ["case_id", "class", "rep_threshold"])
    out = S.config_summary(back, ["threshold"], "dice")
    return out.withColumns({c: r6(c) for c in ("mean", "minimum", "median")})


@query("intensity_sample", with_sql(VOXELS_SQL, """q AS (SELECT case_id, i, j, k, i + 0.25::DOUBLE AS fi, j + 0.5::DOUBLE AS fj FROM vox WHERE hits >= 2),
c AS (SELECT q.case_id, q.i, q.j, q.k, (CASE WHEN di = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END) * 0.5::DOUBLE * coalesce(v.hu, -1000) AS w
  FROM q CROSS JOIN (SELECT unnest([0, 1]) AS di) CROSS JOIN (SELECT unnest([0, 1]) AS dj) LEFT JOIN vox v ON v.case_id = q.case_id AND v.i = q.i + di AND v.j = q.j + dj AND v.k = q.k)""", body="""
SELECT case_id, i, j, k, round(sum(w), 6) AS sampled FROM c GROUP BY ALL"""))
def intensity_sample(spark, folder):
    vox = voxels(spark, folder)
    at = vox.where(F.col("hits") >= 2).select("case_id", *[F.col(c).alias(f"g{c}") for c in "ijk"])
    index = [F.col("gi") + 0.25, F.col("gj") + 0.5, F.col("gk").cast("double")]
    out = V.trilinear(at, vox, CASE, ["gi", "gj", "gk"], "hu", index)
    return out.select("case_id", *[F.col(f"g{c}").alias(c) for c in "ijk"], r6("sampled").alias("sampled"))


@query("intensity_evidence", with_sql(VOXELS_SQL, body="""
SELECT case_id, j AS variant, round(avg(greatest(least(hu * 2, 3000), -500)) + 850 * avg((hu * 2 >= 700)::INTEGER) + 350 * avg((hu * 2 >= 1400)::INTEGER), 6) AS evidence
FROM vox GROUP BY ALL"""))
def intensity_evidence(spark, folder):
    rows = voxels(spark, folder).select("case_id", F.col("j").alias("variant"), (F.col("hu") * 2).alias("sampled"))
    return V.intensity_evidence(rows, ["case_id", "variant"]).withColumn("evidence", r6("evidence"))


@query("resampled_grid", with_sql(VOXELS_SQL, """g AS (SELECT * FROM (SELECT DISTINCT case_id FROM vox), (SELECT unnest(range(0, 12)) AS i), (SELECT unnest(range(0, 5)) AS j), (SELECT unnest(range(0, 8)) AS k)),
c AS (SELECT g.case_id, g.i, g.j, g.k, (CASE WHEN dk = 1 THEN (g.k % 2) * 0.5::DOUBLE ELSE 1 - (g.k % 2) * 0.5::DOUBLE END) * coalesce(v.hu, -1000) AS w
  FROM g CROSS JOIN (SELECT unnest([0, 1]) AS dk) LEFT JOIN vox v ON v.case_id = g.case_id AND v.i = g.i * 2 AND v.j = g.j AND v.k = g.k // 2 + dk)""", body="""
SELECT case_id, i, j, k, round(sum(w), 6) AS hu FROM c GROUP BY ALL"""))
def resampled_grid(spark, folder):
    vox = voxels(spark, folder)
    target = (1.0, 0.0, 0.0, -3.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, -0.4, 4.0, 0.0, 0.0, 0.0, 1.0)
    out = V.resample(vox.select("case_id").distinct(), vox, CASE, (12, 5, 8), target, AFFINE)
    return out.withColumn("hu", r6("hu"))


@query("clipped_intensity", with_sql(VOXELS_SQL, body="SELECT case_id, i, j, k, round((greatest(least(hu * 5, 3000), -500) - 500) / 1000, 6) AS scaled FROM vox"))
def clipped_intensity(spark, folder):
    return voxels(spark, folder).select(*AT, r6(K.clip_intensity(F.col("hu") * 5)).alias("scaled"))


@query("weak_labels", with_sql(VOXELS_SQL, """sd AS (SELECT case_id, 1 AS label, i, j, k FROM vox WHERE p1 >= 0.47 AND k % 4 = 0 UNION ALL SELECT case_id, 2, i, j, k FROM vox WHERE p2 >= 0.5 AND k % 4 = 2),
q AS (SELECT * FROM vox WHERE hu >= 500),
d AS (SELECT q.case_id, q.i, q.j, q.k, label, round(sqrt(pow(q.i - sd.i, 2) + pow(q.j - sd.j, 2) + pow(q.k - sd.k, 2)), 9) AS dist FROM q JOIN sd ON q.case_id = sd.case_id
  AND pow(q.i - sd.i, 2) + pow(q.j - sd.j, 2) + pow(q.k - sd.k, 2) <= 2.25)""", body="""
SELECT case_id, i, j, k, arg_min(label, (dist, label)) AS label FROM d GROUP BY ALL"""))
def weak_labels(spark, folder):
    vox = voxels(spark, folder)
    one = vox.where((F.col("p1") >= 0.47) & (F.pmod("k", F.lit(4)) == 0)).withColumn("label", F.lit(1))
    two = vox.where((F.col("p2") >= 0.5) & (F.pmod("k", F.lit(4)) == 2)).withColumn("label", F.lit(2))
    seeds = one.unionByName(two).select("case_id", "label", "i", "j", "k")
    return V.weak_labels(vox, seeds, CASE, 1.5, 500.0)


@query("guided_surface", with_sql(VOXELS_SQL, """m AS (SELECT case_id, i, j, k FROM vox WHERE hu >= 100),
n AS (SELECT a.case_id, a.i, a.j, a.k FROM m a JOIN m b ON a.case_id = b.case_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL HAVING count(*) < 27),
s AS (SELECT case_id, i, j, k FROM vox WHERE p2 >= 0.5 AND p1 >= 0.3),
d AS (SELECT n.case_id, n.i, n.j, n.k, min(sqrt(pow((n.i - s.i) * 0.5::DOUBLE, 2) + pow((n.j - s.j) * 2, 2) + pow((n.k - s.k) * 0.8::DOUBLE, 2))) AS dist FROM n JOIN s USING (case_id) GROUP BY ALL)""", body="""
SELECT case_id, radius, count(*) AS points FROM d, (SELECT unnest([0.7, 1.1, 2.1]::DOUBLE[]) AS radius) WHERE dist <= radius GROUP BY ALL"""))
def guided_surface(spark, folder):
    vox = voxels(spark, folder)
    ident = F.struct("i", "j", "k")
    surface = V.to_world(V.boundary(mask(spark, folder, 100.0).select(*AT), CASE), AFFINE).withColumn("point_id", ident)
    support = V.to_world(vox.where((F.col("p2") >= 0.5) & (F.col("p1") >= 0.3)), AFFINE).withColumn("point_id", ident)
    near = X.nearest(surface, support, CASE)
    grid = near.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in (0.7, 1.1, 2.1)])))
    return grid.where(F.col("distance") <= F.col("radius")).groupBy("case_id", "radius").agg(F.count(F.lit(1)).alias("points"))


@query("region_surface", with_sql(VOXELS_SQL, """m AS (SELECT case_id, t AS threshold, i, j, k FROM vox, (SELECT unnest([100.0, 300.0]::DOUBLE[]) AS t) WHERE hu >= t AND i BETWEEN 10 AND 39 AND k BETWEEN 2 AND 15),
n AS (SELECT a.case_id, a.threshold, a.i, a.j, a.k FROM m a JOIN m b ON a.case_id = b.case_id AND a.threshold = b.threshold AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL HAVING count(*) < 27)""", body="""
SELECT case_id, threshold, count(*) AS points FROM n GROUP BY ALL"""))
def region_surface(spark, folder):
    vox = voxels(spark, folder).where(F.col("i").between(10, 39) & F.col("k").between(2, 15))
    masks = V.threshold_masks(vox, [100.0, 300.0]).select("case_id", "threshold", "i", "j", "k")
    return S.counts_by(V.boundary(masks, ["case_id", "threshold"]), ["case_id", "threshold"]).withColumnRenamed("rows", "points")
