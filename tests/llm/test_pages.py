"""Pages: archives read back, URL rules."""

import pytest
from pyspark.sql import functions as F

from tallywake.llm import urls, warc
from tallywake.llm.common import work_dir

BIG = "<html>" + "é" * 100
PAGES = [(1, "http://a.example.org/x", BIG), (2, "no scheme", BIG), (3, None, None), (4, "http://A.Com/de/1?q#f", "short"), (5, "http://b.com", "short"), (None, "http://x\ny.com/fr/", BIG), (6, "http://c.net/%0A", "z" * 600000), (2, "no scheme", BIG)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, n int")


def test_round_trip(spark, pages):
    out = work_dir(spark, "warc")
    records, index = warc.archive_pages(spark, pages, out)
    rows = records.collect()
    assert len(rows) == len(PAGES)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in rows}
    assert kinds[1] == ("response", None) and kinds[2] == ("revisit", 1) and kinds[None] == ("revisit", 1) and kinds[4] == kinds[5] == ("response", None)
    assert {r.url for r in rows} == {p[1] or "" for p in PAGES}
    html = {r.page_id: r.html for r in warc.fetch(index, out).collect()}
    assert html[6] == "z" * 600000 and html[1] == BIG and html[2] is None and html[3] == ""
    assert warc.archive_pages(spark, pages.limit(0), work_dir(spark, "warc"))[1].isEmpty()


def test_seek_table():
    assert warc.read_seek_table(b"data" + warc.seek_table([(3, 9), (4, 1)])) == [(3, 9), (4, 1)]
    with pytest.raises(ValueError):
        warc.read_seek_table(b"0" * 20)


def test_rules(pages):
    got = {(r.page_id, r.host): r for r in urls.judge(pages).collect()}
    r = got[4, "a.com"]
    assert (r.path, r.rule, r.verdict) == ("/de/1", "com/de/", "block")
    assert got[1, "a.example.org"].rule == "org/" and got[3, ""].verdict == "allow" and got[2, ""].path == ""
    assert got[5, "b.com"].rule is None and urls.judge(pages).count() == len(PAGES)
    assert urls.judge(pages.limit(0)).count() == 0


def test_mined_rules_match_by_brute_force(spark):
    seen = [(f"http://w{k % 5}.spam{k % 2}.com/de/{k}", "block") for k in range(40)] + [(f"http://w{k % 5}.good.com/fr/{k}", "allow") for k in range(40)]
    labelled = spark.createDataFrame(seen, "url string, verdict string").withColumn("tokens", urls.tokens_of(F.col("url")))
    rules = urls.mine(labelled)
    found = rules.collect()
    assert found and all(r.confidence >= urls.MIN_CONFIDENCE for r in found)
    new = spark.createDataFrame([("http://x.spam1.net/de/7",), ("http://q.net/fr/",), ("http://q.net/zz",)], "url string").withColumn("tokens", urls.tokens_of(F.col("url")))
    got = {r.url: r.mined for r in urls.match(new, rules).collect()}
    for r in new.collect():
        fit = [x for x in found if set(x.antecedent) <= set(r.tokens)]
        assert (r.url in got) == bool(fit)
    assert got["http://x.spam1.net/de/7"] == "block" and got["http://q.net/fr/"] == "allow"


def test_long_urls_are_mined(spark):
    """URLs of 40 tokens that always stand together are one item, not 2**40."""
    long = "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    seen = [(f"http://w.{'spam' if k % 2 else 'good'}.com/{long}/{'de' if k % 2 else 'fr'}", "block" if k % 2 else "allow") for k in range(40)]
    labelled = spark.createDataFrame(seen, "url string, verdict string").withColumn("tokens", urls.tokens_of(F.col("url")))
    found = {(tuple(r.antecedent), r.verdict) for r in urls.mine(labelled).collect()}
    assert found == {(("h:spam",), "block"), (("p:de",), "block"), (("h:good",), "allow"), (("p:fr",), "allow")}
