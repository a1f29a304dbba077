"""Steps that failed on larger tables, next to plain results."""

import numpy as np

from rankloom.operators import grouping as G


def test_leave_one_out_sorts_counted_values_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("g", int(u), i, float(v)) for i, (u, v) in enumerate(zip(rng.integers(0, 4, 4000), rng.integers(0, 9, 4000)))]
    df = spark.createDataFrame(rows, "g string, u int, i int, v double")
    sorted_rows, plain = [], G.positions
    monkeypatch.setattr(G, "positions", lambda df, *a, **k: sorted_rows.append(df.count()) or plain(df, *a, **k))
    monkeypatch.setattr(G, "PLACES", 64, raising=False)
    got = {r["u"]: (r["q"], r["m"]) for r in G.quantiles_without(df, ["g"], "u", "v", ["i"], {"q": 0.9, "m": 0.5}).collect()}
    assert max(sorted_rows) <= 36
    for u in range(4):
        rest = [r[3] for r in rows if r[1] != u]
        assert got[u] == (np.quantile(rest, 0.9), np.quantile(rest, 0.5))
