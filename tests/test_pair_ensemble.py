"""The ensemble scores each pair of candidates once, and makes matrices for its pool alone."""

import datetime
import random

from rankloom.plans import feature_queries as Q


def test_pairs_are_scored_once(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    day = datetime.date(1997, 1, 1)
    rows = [(i, 1 + i % 6, rng.randrange(1, 40), i % 7 + 1, float(rng.randrange(1, 51)), rng.uniform(900, 9e4), rng.randrange(11) / 100, rng.randrange(9) / 100,
             "ANR"[i % 3], "OF"[i // 6 % 2], day) for i in range(240)]
    spark.createDataFrame(rows, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,
        l_tax double, l_returnflag string, l_linestatus string, l_shipdate date""").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, pools, seeds, top = [], [], Q.S.seed_aggregates, Q.S.run_balanced_top
    monkeypatch.setattr(Q.S, "run_balanced_top", lambda df, *a: pools.append(df.columns) or top(df, *a))
    monkeypatch.setattr(Q.S, "seed_aggregates", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or seeds(df, *a))
    out = Q.pair_ensemble(spark, str(tmp_path)).collect()
    assert len(pools) == 1 and "transform" not in pools[0]
    assert len(plans) == 2 and all("Join" not in p and "UDF" not in p for p in plans)  # scores are read, not worked out again
    assert len({r.case_id for r in out}) == len(out) > 0
