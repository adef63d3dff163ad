"""References in columns: the examples of RFC 3986 and random ones against the standard library."""

import random
from urllib.parse import urljoin

from lyceum.catalog import QUERIES
from lyceum.functions import url as U
from lyceum.functions import urljoin as J
from pyspark.sql import functions as F

BASE = "http://a/b/c/d;p?q"
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": BASE,
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/",
    "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http://a/b/c/g",
}


def both(spark, pairs):
    df = spark.createDataFrame(pairs, "base string, url string")
    return df.select("base", "url", U.joined(F.col("base"), F.col("url")).alias("joined"), J.resolved(F.col("base"), F.col("url")).alias("resolved"))


def test_examples_of_the_rfc(spark):
    for r in both(spark, [(BASE, u) for u in RFC]).collect():
        assert (r.joined, r.resolved) == (RFC[r.url], RFC[r.url]), r.url


def test_random_references(spark):
    rng = random.Random(4)
    pieces = ["a", "b.html", ".", "..", "/", "/", "//", "?", "#", ";", ":", "http:", "https://", "h.example", "mailto:", "é", " ", "\t", "%20", "x=1", "...", "HTTP://", "file:"]
    bases = ["http://a/b/c/d;p?q", "https://h.example", "https://h.example/", "http://H/x//y/../z;q", "", "file:///a/b", "mailto:x@y", "a/b", "//n/p", "http://a?q", " http://a/b\n"]
    pairs = [(rng.choice(bases), "".join(rng.choices(pieces, k=rng.randrange(0, 7)))) for _ in range(6000)]
    for r in both(spark, pairs).collect():
        wanted = urljoin(r.base, r.url)
        assert (r.joined, r.resolved) == (wanted, wanted), (r.base, r.url)


def test_nulls_and_brackets(spark):
    rows = both(spark, [(None, "a"), ("http://a/", None), ("http://a/", "http://[x/"), ("http://a/", "//x]/"), ("http://[::1]/a", "b")]).collect()
    assert [r.joined for r in rows] == [None, None, None, None, "http://[::1]/b"]


def test_links_run_no_python_but_the_parser(spark):
    for name in ("link_filter_typed", "page_file_links", "page_data_images"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan, name
