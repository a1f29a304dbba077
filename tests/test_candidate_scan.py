"""The whole job of a query whose files were cut by key ranges."""

from rankloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_candidate_scan_takes_whole_nations(spark):
    rows = catalog.QUERIES["candidate_scan"](spark, SMALL).collect()
    assert {r["case_id"] for r in rows} <= {str(n) for n in range(25)}
    assert len(rows) == spark.read.parquet(f"{SMALL}/customer.parquet").count()
