"""Stated inputs and outputs: url hashes, ranks, indexes, stems."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions.stem import porter, stemmed
from millrace.functions.text import page_words
from millrace.functions.urls import normalized_link, short_id, url_hash
from millrace.plans import index as I
from millrace.plans import links as G
from millrace.plans import rank as R

RANKS = {"1": 1.191681575822917, "2": 1.1637322274926893, "3": 0.644586196684393}


def defined_hash(url):
    """The key from its definition: signed bytes of the SHA-1, each as two letters."""
    out = ""
    for b in hashlib.sha1(url.encode()).digest():
        n = b if 0 < b < 128 else 255 + (b - 256 if b else 0)
        out += chr(97 + n % 26) + "acegikmoqs"[n // 26]
    return out


def test_url_hash(spark):
    urls = [f"http://host{i}.org:80/page{i}" for i in range(200)] + ["", "http://ü.org/"]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string").select("url", url_hash(F.col("url")).alias("h"))
    assert {r["url"]: r["h"] for r in df.collect()} == {**{u: defined_hash(u) for u in urls}, None: None}


def _graph(spark, edges, extra=()):
    nodes = sorted({a for a, _ in edges} | {"1", "2", "3"} | set(extra))
    return spark.createDataFrame([(n,) for n in nodes], "row_key string"), spark.createDataFrame(edges, "src string, dst string")


EDGES = [("1", "2"), ("2", "1"), ("2", "3"), ("3", "1")]


def test_pagerank_three_nodes(spark):
    got = {r["row_key"]: r["rank"] for r in R.pagerank(*_graph(spark, EDGES), eps=0.001).collect()}
    assert got.keys() == RANKS.keys()
    assert all(abs(got[k] - v) < 0.001 for k, v in RANKS.items())


def test_pagerank_source_and_sink(spark):
    pages, edges = _graph(spark, [*EDGES, ("5", "elsewhere")], ["4", "5"])
    got = {r["row_key"]: r["rank"] for r in R.pagerank(pages, edges, eps=0.01).collect()}
    assert got.keys() == {"1", "2", "3", "4", "5"}
    assert abs(got["4"] - 0.15) < 1e-9 and abs(got["5"] - 0.15) < 1e-9
    assert all(abs(got[k] - v) < 0.01 for k, v in RANKS.items())


def test_pagerank_options(spark):
    pages, edges = _graph(spark, EDGES)
    back = {r["row_key"]: r["rank"] for r in R.pagerank(pages, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), rounds=5, reverse=True).collect()}
    forth = {r["row_key"]: r["rank"] for r in R.pagerank(pages, edges, rounds=5).collect()}
    assert back == pytest.approx(forth)
    loops = edges.union(spark.createDataFrame([("1", "1")], edges.schema))
    kept = {r["row_key"]: r["rank"] for r in R.pagerank(pages, loops, rounds=1, drop_self=True).collect()}
    assert kept["2"] == pytest.approx(0.15 + 0.85 / 2)
    same = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "row_key string, domain string")
    low = {r["row_key"]: r["rank"] for r in R.pagerank(pages, edges, rounds=1, domains=same, same_domain_weight=0.3).collect()}
    assert low["2"] == pytest.approx(0.15 + 0.85 * 0.3)
    assert R.pagerank(pages.limit(0), edges, rounds=2).count() == 0


def test_links_resolve_to_the_graph(spark):
    rows = [(str(i), f"http://foo.com:80/page{i}.html", p) for i, p in ((1, '<a href="/page2.html">x</a>'), (2, '<a href="/page1.html">x</a> <A HREF="http://foo.com/page3.html#top">y</A>'), (3, "<a class=q href='../page1.html'>x</a><a href='mailto:a@b'>m</a>"))]
    pages = spark.createDataFrame(rows, "row_key string, url string, page string")
    got = {(r["row_key"], r["link"]) for r in G.links_of(pages).collect()}
    page = "http://foo.com:80/page{}.html".format
    assert got == {("1", page(2)), ("2", page(1)), ("2", page(3)), ("3", page(1))}


@pytest.mark.parametrize(
    "link,base,expected",
    [
        ("/a//b", "https://x.org:443/p/q", "https://x.org:443/a/b"),
        ("c d", "http://x.org:80/p/q", "http://x.org:80/p/c%20d"),
        ("//y.org/z", "https://x.org/p", "https://y.org:443/z"),
        ("http://x.org:8080", "http://x.org:80/", "http://x.org:8080/"),
        ("#top", "http://x.org:80/", None),
        ("java|script", "http://x.org:80/", None),
        ("ftp://x.org/", "http://x.org:80/", None),
    ],
)
def test_normalized_link(spark, link, base, expected):
    assert spark.range(1).select(normalized_link(F.lit(link), F.lit(base)).alias("u")).first()["u"] == expected


def test_index_goldens(spark):
    rows = [("1", "apples Apples Guavas apples guavas"), ("2", "apples dates apples dates dates Guavas"), ("3", "Guavas <b>guavas</b>\tguavas,  apples"), ("4", None), ("5", "")]
    df = spark.createDataFrame(rows, "k string, t string")
    tokens = I.tokens_of(df, "k", page_words(F.col("t")))
    got = {(r["word"], r["doc"]): r["positions"] for r in I.postings(tokens).collect()}
    assert got == {("apples", "1"): [0, 1, 3], ("apples", "2"): [0, 2], ("apples", "3"): [3], ("dates", "2"): [1, 3, 4], ("guavas", "1"): [2, 4], ("guavas", "2"): [5], ("guavas", "3"): [0, 1, 2]}
    lists = {r["word"]: r["postings"] for r in I.posting_lists(tokens).collect()}
    assert lists["guavas"] == "3:0 1 2,1:2 4,2:5" and lists["apples"] == "1:0 1 3,2:0 2,3:3"
    stems = {r["word"] for r in I.with_stems(tokens).select("word").distinct().collect()}
    assert stems == {"apples", "appl", "dates", "date", "guavas", "guava"}
    served = {(r["word"], r["doc"]): r["doc_tf"] for r in I.served_index(tokens).collect()}
    assert served["dates", "2"] == pytest.approx(1.0) and served["apples", "2"] == pytest.approx(0.4 + 0.6 * 2 / 3)


def test_positions_are_capped(spark):
    df = spark.createDataFrame([("1", "w " * 50)], "k string, t string")
    row = I.served_index(I.tokens_by_space(df, "k", "t")).first()
    assert row["positions"] == list(range(19)) and row["tf"] == 50


# Published examples of the stemmer.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopefulness": "hope", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll",
}


def test_porter(spark):
    assert {w: porter(w) for w in STEMS} == STEMS
    df = spark.createDataFrame([(w,) for w in [*STEMS, None, "", "é"]], "w string").select("w", stemmed(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == {**STEMS, None: None, "": "", "é": "é"}


def test_ids(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", "a", None, "cc", "ca"]], "k string")
    got = [(r["key"], r["number"], r["id"]) for r in I.id_dictionary(df, "k", start=25).orderBy("number").collect()]
    assert got == [("a", 25, "zaaaa"), ("b", 26, "abaaa"), ("ca", 27, "bbaaa"), ("cc", 28, "cbaaa")]
    assert spark.range(1).select(short_id(F.lit(26**4)).alias("i")).first()["i"] == "aaaab"
