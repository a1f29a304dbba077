import duckdb
import pytest

from rankloom.llm import mixing, registry, url_filter
from rankloom.llm.url_filter import Rule


def rows_of(frame):
    order = sorted(frame.columns)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in order)) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.TWINS))
def test_twins(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    cursor = con.execute(registry.TWINS[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    wanted = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[i] for i in order)) for r in cursor.fetchall()), key=repr)
    assert rows_of(registry.QUERIES[name](spark, folder)) == wanted


def test_addresses(spark):
    urls = ["http://A.Example.org/es/x?q", "https://example.org/en/12#a", "https://notexample.org/es/", "http://x.com/fr", "http://x.com/fr/", "http://COM/de/a",
            "x.com/de/", None, "", "http://", "http://org", "http://a.org/", "ftp://b.net/de/?u=://c.com/de/"]
    frame = spark.createDataFrame([(i, u, "keep", "clash") for i, u in enumerate(urls)], "page_id int, url string, html string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame, list(url_filter.RULES)).collect()}
    assert found[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[2] == ("notexample.org", "/es/", "org/", "allow")
    assert found[3] == ("x.com", "/fr", None, "allow") and found[4][2] == "com/fr/" and found[5] == ("com", "/de/a", "com/de/", "block")
    assert found[6] == found[7] == found[8] == ("", "", None, "allow") and found[9] == ("", "", None, "allow")
    assert found[10] == ("org", "", None, "allow") and found[11][2] == "org/" and found[12] == ("b.net", "/de/", None, "allow")
    assert url_filter.judge_urls(frame.limit(0), list(url_filter.RULES)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(frame, [], default="block").collect()} == {"block"}


def test_many_rules_against_a_scan(spark):
    rules = [Rule("block" if i % 3 else "allow", f"h{i % 40}.net", f"/p{i % 7}" * (i % 4)) for i in range(400)]
    urls = [f"http://s.h{i % 50}.net/p{i % 7}/p{i % 5}" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    best = {(r.host, r.path): r for r in sorted(rules, key=lambda r: r.verdict)}.values()
    for r in url_filter.judge_urls(frame, rules).collect():
        fits = [x for x in best if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        top = max(fits, key=lambda x: (len(x.text), len(x.host)), default=None)
        assert (r.rule, r.verdict) == ((top.text, top.verdict) if top else (None, "allow"))


def test_targets(spark):
    """Weights 5, 2, 1, 5: the first source is full at 30, the others share what is left."""
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 1)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 3 and abs(got["b"] - 178 * 2 / 3) < 1e-9 and abs(got["c"] - 178 / 3) < 1e-9


def test_mix(spark, odd, documents):
    found = mixing.mix(documents, bucket_rows=7)
    assert rows_of(found) == rows_of(mixing.mix(documents.repartition(5)))
    for r in found.groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect():
        assert r["sum(taken)"] == int(r["max(target)"])
    assert found.filter("taken > 3 * size OR taken < 0").count() == 0
    mixed = mixing.mix(odd)
    assert mixed.count() == odd.count() and mixed.filter("size = 0 AND taken > 0").count() == 0
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.filter("doc_id IN (2, 3)")).agg({"taken": "sum"}).first()[0] == 0
