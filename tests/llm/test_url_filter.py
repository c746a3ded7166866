import duckdb
import pandas as pd
from pyspark.sql import functions as F

from sparkwarden.llm import url_filter as U

SCHEMA = "page_id long, url string, html string"


def judged(spark, rows, **extra):
    df = spark.createDataFrame(rows, SCHEMA)
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    return {(r.page_id, r.url_host): r for r in U.judge(df).withColumn("url_host", F.col("host")).collect()}


def test_rules_and_parsing(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q", None), (2, "http://a.example.net/de/x", None), (3, "http://x.example.com/de/1#t", None),
        (4, "http://example.org/fr/", None), (5, None, None), (6, "no scheme", None), (7, "http://net", None), (8, "http://notnet/", None), (9, "http://h.example.org?x/fr/", None),
    ]
    got = {k[0]: v for k, v in judged(spark, rows, host="clash", verdict="clash").items()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 10)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("a.example.net", "/de/x", "net/", "block"), ("x.example.com", "/de/1", "example.com/de/", "block"),
        ("example.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "", None, "allow"), ("notnet", "/", None, "allow"), ("h.example.org", "", None, "allow"),
    ]


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    rows = [(1, "http://spam.test.net/", None), (2, "http://friend.test.com/", '<a href="http://spam.test.net/x">'), (3, "http://clean.test.com/", '<a href="http://good.test.org/">'), (4, "http://good.test.org/fr/", None)]
    got = {k[0]: v for k, v in judged(spark, rows).items()}
    assert got[2].verdict == "block" and got[2].distrust > 0.5
    assert got[3].verdict == "allow" and got[3].trust == 0


def test_empty_and_repeated(spark):
    assert judged(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.net/", None)] * 3, SCHEMA)
    assert U.judge(df).count() == 3


def test_sql_agrees(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr')[i % 5 % 3]}/{i}", f'<a href="https://h{i * 3 % 7}.example.{("com", "net", "org")[i % 2]}/x">' if i % 2 else None) for i in range(120)]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    got = {tuple(r) for r in U.op5_url_filters(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    assert got == set(c.execute(U.oracle()).fetchall())


def test_no_host_is_blocked_by_a_built_in_name(spark):
    names = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm", "other-spam")
    df = spark.createDataFrame([(i, f"http://www.{x}.example.com/en/", "<a href='/x'>") for i, x in enumerate(names)], SCHEMA)
    assert {r.verdict for r in U.judge(df).collect()} == {"allow"}
    seeds = spark.createDataFrame([("www.OTHER-spam.example.com", None, 1.0), (None, 1.0, 1.0)], "host string, trust double, distrust double")
    given = U.judge(df, seeds=seeds).collect()
    assert {r.page_id for r in given if r.verdict == "block"} == {6}


def test_a_host_is_blocked_through_edges_alone(spark):
    """No rule fits the middle hosts; distrust comes two links back from a blocked one, however the links are written."""
    for link in ("<a href=\"http://bad.net/x\">", "<A HREF = 'https://BAD.net'>", "<a href=//bad.net/x>", "<a href=' //bad.net?q'>"):
        rows = [(1, "http://bad.net/", None), (2, "http://one.com/", link), (3, "http://two.com/", '<a href="//one.com/">'), (4, "http://other.com/", "<a href='/bad.net/'> <a href='x//bad.net'>")]
        got = {k[0]: v for k, v in judged(spark, rows).items()}
        assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "block", "block", "allow"], link
        assert got[2].rule is None and got[2].distrust > got[3].distrust > 0.05


def test_very_long_html_and_a_hot_host(spark):
    rows = [(1, "http://hub.com/", "".join(f'<a href="http://h{i}.com/">x</a>' for i in range(20_000)))] + [(i + 2, f"http://hub.com/{i}", None) for i in range(500)] + [(900, "http://h7.com/", "<a href='//bad.net'>"), (901, "http://bad.net/", "")]
    got = {k[0]: v for k, v in judged(spark, rows).items()}
    assert got[900].verdict == "block" and len(got) == 503 and len({got[i].verdict for i in range(1, 502)}) == 1
