"""Nearest neighbours, surface scores, samples and shapes over the point view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as X
from .bindings import POINTS_SQL, points, r6, rounded, with_sql
from .registry import query


def sides(spark, folder):
    """Points of even and odd ids as the two clouds of the same set."""
    p = points(spark, folder)
    even = F.pmod("point_id", F.lit(2)) == 0
    return p.where(even), p.where(~even)


SIDES_SQL = """a AS (SELECT * FROM points WHERE point_id % 2 = 0), b AS (SELECT * FROM points WHERE point_id % 2 = 1),
pr AS (SELECT a.set_id, a.point_id AS pa, b.point_id AS pb, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM a JOIN b USING (set_id)),
ab AS (SELECT set_id, pa AS point_id, arg_min(pb, (d2, pb)) AS nearest_id, sqrt(min(d2)) AS distance FROM pr GROUP BY ALL),
ba AS (SELECT set_id, pb AS point_id, arg_min(pa, (d2, pa)) AS nearest_id, sqrt(min(d2)) AS distance FROM pr GROUP BY ALL)"""


@query("nearest_neighbour", with_sql(POINTS_SQL, SIDES_SQL, body="SELECT set_id, point_id, nearest_id, round(distance, 6) AS distance FROM ab"))
def nearest_neighbour(spark, folder):
    a, b = sides(spark, folder)
    return X.nearest(a, b, ["set_id"]).withColumn("distance", r6("distance"))


@query("nearest_in_set", with_sql(POINTS_SQL, body="""
SELECT p.set_id, p.point_id, round(sqrt(min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2))), 6) AS distance
FROM points p JOIN points q ON p.set_id = q.set_id AND p.point_id <> q.point_id GROUP BY ALL"""))
def nearest_in_set(spark, folder):
    p = points(spark, folder)
    return X.nearest(p, p, ["set_id"], exclude_self=True).select("set_id", "point_id", r6("distance").alias("distance"))


@query("radius_counts", with_sql(POINTS_SQL, body="""
SELECT p.set_id, p.point_id, count(*) FILTER (WHERE pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= 0.1::DOUBLE * 0.1::DOUBLE) AS within_0,
  count(*) FILTER (WHERE pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= 0.25::DOUBLE * 0.25::DOUBLE) AS within_1
FROM points p JOIN points q ON p.set_id = q.set_id GROUP BY ALL"""))
def radius_counts(spark, folder):
    p = points(spark, folder)
    return X.near_counts(p, p, ["set_id"], ["x", "y", "z"], [0.1, 0.25])


@query("radius_join", with_sql(POINTS_SQL, SIDES_SQL, body="""
SELECT set_id, point_id FROM a WHERE EXISTS (SELECT 1 FROM pr WHERE pr.set_id = a.set_id AND pa = point_id AND d2 <= 0.08::DOUBLE * 0.08::DOUBLE)"""))
def radius_join(spark, folder):
    a, b = sides(spark, folder)
    return X.within_radius(a, b, ["set_id"], 0.08).select("set_id", "point_id")


SCORE_SQL = """rk AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY distance, point_id) AS p, count(*) OVER (PARTITION BY set_id) AS n FROM ab),
rb AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY distance, point_id) AS p, count(*) OVER (PARTITION BY set_id) AS n FROM ba)"""


@query("one_way_score", with_sql(POINTS_SQL, SIDES_SQL, SCORE_SQL, body="""
SELECT set_id, max(n) AS points, round(avg(distance) FILTER (WHERE p <= least(n, greatest(32, floor(n * 0.7::DOUBLE)))), 6) AS score,
  round(quantile_cont(distance, 0.5), 6) AS median, round(quantile_cont(distance, 0.9), 6) AS p90, round(avg((distance <= 0.1)::INTEGER), 6) AS within_0p1
FROM rk GROUP BY 1"""))
def one_way_score(spark, folder):
    a, b = sides(spark, folder)
    out = X.fit_score(X.nearest(a, b, ["set_id"]), ["set_id"], ["point_id"], within=(0.1,), sized_by=a)
    return out.select("set_id", "points", *[r6(c).alias(c) for c in ("score", "median", "p90", "within_0p1")])


@query("two_way_score", with_sql(POINTS_SQL, SIDES_SQL, SCORE_SQL, """s AS (SELECT set_id,
  avg(distance) FILTER (WHERE p <= least(n, greatest(32, floor(n * 0.7::DOUBLE)))) AS ss FROM rk GROUP BY 1),
t AS (SELECT set_id, avg(distance) FILTER (WHERE p <= least(n, greatest(32, floor(n * 0.35::DOUBLE)))) AS ts,
  avg((distance <= 0.1)::INTEGER) AS c1, avg((distance <= 0.2)::INTEGER) AS c2 FROM rb GROUP BY 1)""", body="""
SELECT set_id, round(ss, 6) AS source_score, round(ts, 6) AS target_score, round(c1, 6) AS coverage_0p1, round(c2, 6) AS coverage_0p2,
  round((ss + 0.5::DOUBLE * ts) / 1.5::DOUBLE, 6) AS score FROM s JOIN t USING (set_id)"""))
def two_way_score(spark, folder):
    a, b = sides(spark, folder)
    out = X.two_way_score(a, b, ["set_id"], within=(0.1, 0.2))
    return out.select("set_id", *[r6(c).alias(c) for c in ("source_score", "target_score", "coverage_0p1", "coverage_0p2", "score")])


@query("support_metrics", with_sql(POINTS_SQL, SIDES_SQL, SCORE_SQL, """s AS (SELECT set_id, avg(distance) FILTER (WHERE p <= greatest(1, ceil(n * 0.2::DOUBLE))) AS tr,
  quantile_cont(distance, 0.5) AS md FROM rk GROUP BY 1), t AS (SELECT set_id, avg(distance) FILTER (WHERE p <= greatest(1, ceil(n * 0.2::DOUBLE))) AS tr,
  quantile_cont(distance, 0.5) AS md FROM rb GROUP BY 1), ca AS (SELECT set_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY 1),
cb AS (SELECT set_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM b GROUP BY 1)""", body="""
SELECT set_id, round(s.tr, 6) AS source_trim20, round(t.tr, 6) AS target_trim20, round((s.tr + t.tr) / 2, 6) AS symmetric_trim20,
  round(s.md, 6) AS source_median, round(t.md, 6) AS target_median,
  round(sqrt(pow(ca.x - cb.x, 2) + pow(ca.y - cb.y, 2) + pow(ca.z - cb.z, 2)), 6) AS centroid_error_mm
FROM s JOIN t USING (set_id) JOIN ca USING (set_id) JOIN cb USING (set_id)"""))
def support_metrics(spark, folder):
    a, b = sides(spark, folder)
    out = X.support_metrics(a, b, ["set_id"])
    return out.select("set_id", *[r6(c).alias(c) for c in (
        "source_trim20", "target_trim20", "symmetric_trim20", "source_median", "target_median", "centroid_error_mm")])


@query("nearest_neighbour_chamfer", with_sql(POINTS_SQL, SIDES_SQL, """p AS (SELECT set_id, avg(distance) AS d, avg((distance <= 2)::INTEGER) AS s FROM ab GROUP BY 1),
t AS (SELECT set_id, avg(distance) AS d, avg((distance <= 2)::INTEGER) AS s FROM ba GROUP BY 1)""", body="""
SELECT set_id, round(p.d, 6) AS predicted_to_target_mm, round(t.d, 6) AS target_to_predicted_mm, p.s AS precision_at_2mm, t.s AS coverage_at_2mm,
  round((p.d + t.d) / 2, 6) AS symmetric_chamfer_mm FROM p JOIN t USING (set_id)"""))
def nearest_neighbour_chamfer(spark, folder):
    a, b = sides(spark, folder)
    out = X.surface_metrics(a, b, ["set_id"])
    return out.select("set_id", r6("predicted_to_target_mm").alias("predicted_to_target_mm"), r6("target_to_predicted_mm").alias("target_to_predicted_mm"),
                      "precision_at_2mm", "coverage_at_2mm", r6("symmetric_chamfer_mm").alias("symmetric_chamfer_mm"))


@query("spaced_sample", with_sql(POINTS_SQL, """o AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY point_id) - 1 AS idx, count(*) OVER (PARTITION BY set_id) AS n FROM points),
k AS (SELECT DISTINCT set_id, floor(i * (n - 1) / (least(n, 16) - 1)::DOUBLE)::BIGINT AS idx FROM (SELECT DISTINCT set_id, n FROM o), (SELECT unnest(range(0, 16)) AS i) WHERE i < least(n, 16))""",
body="SELECT set_id, point_id FROM o JOIN k USING (set_id, idx)"))
def spaced_sample(spark, folder):
    return X.spaced_sample(points(spark, folder), ["set_id"], "point_id", 16).select("set_id", "point_id")


@query("hashed_sample", with_sql(POINTS_SQL, body="""SELECT set_id, point_id FROM (
  SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY sha256('9|' || set_id || '|' || point_id), point_id) AS r FROM points) WHERE r <= 12"""))
def hashed_sample(spark, folder):
    return X.hashed_sample(points(spark, folder), ["set_id"], "point_id", 12, 9).select("set_id", "point_id")


@query("rigid_fit")
def rigid_fit(spark, folder):
    """Every set against its own points turned by 20 degrees about z and shifted; the fit must undo it."""
    p = points(spark, folder)
    c, s = F.cos(F.radians(F.lit(20.0))), F.sin(F.radians(F.lit(20.0)))
    moved = p.select("set_id", "x", "y", "z", (c * F.col("x") - s * F.col("y") + 1.0).alias("u"),
                     (s * F.col("x") + c * F.col("y") - 2.0).alias("v"), (F.col("z") + 0.5).alias("w"))
    out = X.rigid_fit(moved, ["set_id"], ["x", "y", "z"], ["u", "v", "w"])
    m = F.col("fitted")
    return out.select("set_id", "pairs", *[rounded(m[i], 5).alias(f"m{i:02d}") for i in range(12)])


from .registry import TWINS  # noqa: E402

_turn = "radians(20.0::DOUBLE)"
_fit = [f"cos({_turn})", f"-sin({_turn})", "0", "1", f"sin({_turn})", f"cos({_turn})", "0", "-2", "0", "0", "1", "0.5"]
TWINS["rigid_fit"] = with_sql(POINTS_SQL, body="SELECT set_id, count(*) AS pairs, " + ", ".join(
    f"round(({v})::DOUBLE, 5) AS m{i:02d}" for i, v in enumerate(_fit)) + " FROM points GROUP BY 1")


@query("principal_axes")
def principal_axes(spark, folder):
    out = X.principal_axes(points(spark, folder), ["set_id"])
    return out.select("set_id", *[rounded(f"c{c}", 6).alias(f"c{c}") for c in "xyz"],
                      *[rounded(F.col("axes")[i], 6).alias(f"a{i}") for i in range(9)])


@query("tail_cut")
def tail_cut(spark, folder):
    return X.tail_cut(points(spark, folder), ["set_id"], [0.25, 0.5]).groupBy("set_id", "side", "fraction").agg(
        F.count(F.lit(1)).alias("kept"), *[r6(F.avg(c)).alias(c) for c in "xyz"])


@query("normal_agreement")
def normal_agreement(spark, folder):
    a, b = sides(spark, folder)
    near = X.nearest(a, b, ["set_id"])
    out = X.normal_agreement(near, X.point_normals(a, ["set_id"], 0.15), X.point_normals(b, ["set_id"], 0.15), ["set_id"], floor=0.1)
    return out.withColumn("normal_abs_cosine", r6("normal_abs_cosine"))
