"""A class, a run or a folder that holds most rows is not the work of one task."""

from pyspark.sql import functions as F

from rankloom.operators import models as L
from rankloom.sources import files as A


def test_pairs_of_a_class_stay_in_their_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.range(800, numPartitions=8).select(F.pmod("id", F.lit(2)).cast("double").alias("label"), (F.col("id") + 1.0).alias("weight"))
        data = L.balanced(pairs)
        assert data.rdd.getNumPartitions() == 8
        assert {r["label"]: round(r["w"], 9) for r in data.groupBy("label").agg(F.sum("weight").alias("w")).collect()} == {0.0: 1.0, 1.0: 1.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_group_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000, numPartitions=2).select(
            F.when(F.col("id") < 10, "B").otherwise("A").alias("candidate_run"), F.lit(1).alias("case_id"), F.lit("upper").alias("jaw"),
            F.col("id").alias("candidate_index"), F.lit(0).alias("_hidden"))
        A.write_candidates(rows, str(tmp_path / "sink"))
        A.write_candidates(rows.where("candidate_run = 'B'"), str(tmp_path / "sink"))
        files = {run: len(list((tmp_path / "sink" / f"candidate_run={run}").rglob("*.parquet"))) for run in "AB"}
        assert files["A"] >= 2
        back = spark.read.parquet(str(tmp_path / "sink"))
        assert back.count() == back.select("candidate_index").distinct().count() == 4000 and "_hidden" not in back.columns
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
