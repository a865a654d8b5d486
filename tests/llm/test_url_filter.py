import numpy as np
from pyspark.sql import functions as F

from quillet.llm import url_filter as U
from quillet.llm.common import DigestArray


def test_canonical_and_candidates(spark):
    rows = {
        "HTTP://User:pw@WWW.Example.com:80/a/?utm_source=x&b=1&ref=q#top": "example.com/a/?b=1",
        "https://example.com:443/a/": "example.com/a",
        "http://a.b.example.org:8080/?ref=1": "a.b.example.org:8080",
        "nonsense": "",
    }
    x = spark.createDataFrame([(k,) for k in rows], "url string").select("url", U.canonical("url").alias("c"), U.candidates("url").alias("all")).collect()
    for r in x:
        if r.url == "nonsense":
            assert r.all == []
        else:
            assert r.c == rows[r.url]
    assert [r.all for r in x if ":8080" in r.url] == [["a.b.example.org:8080", "a.b.example.org", "b.example.org", "example.org"]]


def test_blocked_like_a_loop_with_edges(spark):
    pages = spark.createDataFrame(
        [(1, "http://bad.com/x", "k"), (2, "http://sub.bad.com/y", "k"), (3, "http://good.com/p?ref=1", "k"), (4, None, "k"), (5, "", "k"), (6, "http://good.com/q", "k"), (1, "http://bad.com/x", "k"), (None, "http://bad.com", "k"), (7, "http://notbad.com/" + "z" * 50_000, "k")],
        "page_id long, url string, entry string",
    ).withColumn("c", F.lit(1)).withColumn("id", F.lit("x"))
    entries = spark.createDataFrame([("bad.com",), ("good.com/p",), (None,), ("",), ("bad.com",)], "entry string")
    got = sorted((r.page_id or 0, r.url, r.entry) for r in U.blocked(pages, U.build(entries)).collect())
    assert got == [(0, "http://bad.com", "bad.com"), (1, "http://bad.com/x", "bad.com"), (1, "http://bad.com/x", "bad.com"), (2, "http://sub.bad.com/y", "bad.com"), (3, "http://good.com/p?ref=1", "good.com/p")]
    assert U.blocked(pages, U.build(entries.limit(0))).count() == 0
    assert U.blocked(pages.limit(0), U.build(entries)).count() == 0


def test_colliding_digests_are_told_apart(spark):
    df = spark.createDataFrame([(5, "a"), (5, "b"), (-1, "c"), (None, "d"), (5, "a")], "k long, v string")
    d = DigestArray.store(df, "k", "v", "test", per_file=1)
    which, where = d.find(np.array([5, 7, 2**64 - 1, 5], np.uint64))
    assert sorted(zip(which.tolist(), d.values(where).to_pylist())) == [(0, "a"), (0, "b"), (2, "c"), (3, "a"), (3, "b")]
    assert d.has(np.array([5, 6], np.uint64)).tolist() == [True, False]


def test_spam_entries_of_pages_without_rows_or_html(spark):
    pages = spark.createDataFrame([("http://a.com/1", "x %%% y"), ("http://a.com/2", None), ("http://b.com/1", "fine"), (None, "%%%")], "url string, html string")
    assert {r.entry for r in U.spam_entries(pages).collect()} == {"a.com/1", "a.com"}
    assert U.spam_entries(pages.limit(0)).count() == 0
