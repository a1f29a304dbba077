from rankloom.operators.generation import content_pairs

SIDE = "jaw string, raw_digest string, payload_digest string"


def test_pairs_meet_once_and_are_shuffled_again_only_if_ids_recur(spark):
    """All pairs were shuffled once more before, to keep one row of each."""
    rows = [(i, "upper" if i % 3 else "lower", f"R{i % 7}" if i % 5 else None, f"p{i % 4}" if i % 6 else None) for i in range(60)]
    entries = [(100 + i, j, r and r.lower(), p, None if i % 2 else 0.1 * i) for i, j, r, p in rows]
    e = spark.createDataFrame(entries, f"entry_id long, {SIDE}, predicted_mm double")
    for given in (rows, rows + [(7, "lower", "r1", "P1"), (7, "upper", "r0", None)]):
        out = content_pairs(spark.createDataFrame(given, f"query_id long, {SIDE}"), e, 1.5)
        want = {}
        for q, jaw, raw, payload in given:
            for n, other, r, p, mm in entries:
                if jaw == other and (mm or 0.0) <= 1.5:
                    same = [a is not None and b is not None and a.lower() == b.lower() for a, b in ((raw, r), (payload, p))]
                    if any(same):
                        want[q, n] = "raw" if same[0] or want.get((q, n)) == "raw" else "payload"
        got = [tuple(r) for r in out.collect()]
        assert sorted(got) == sorted((*k, v) for k, v in want.items())
        assert ("Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()) == (len(given) > len(rows))
