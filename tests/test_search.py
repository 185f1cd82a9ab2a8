import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import lookups as L
from millrace.plans import crawl as C
from millrace.plans import search as S
from millrace.plans import suggest as Q
from millrace.sources import fetch as X
from millrace.sources.html import main_lines, text_of


def test_closest_against_all_choices():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 5))) for _ in range(rng.randint(1, 4))]
        best = min(max(c) - min(c) for c in itertools.product(*lists))
        got = S.closest(lists, 0, 100)
        assert max(got) - min(got) == best and all(g in x for g, x in zip(got, lists))
    assert S.closest([[1], []]) == [] and S.closest([]) == [] and S.closest([[0], [50]]) == []


def test_phrase_score():
    assert S.phrase_score([7]) == pytest.approx(0.7 / 2 + 0.3)
    assert S.phrase_score([3, 4]) == pytest.approx(0.7 / 3 + 0.3)
    assert S.phrase_score([4, 3]) == pytest.approx(0.7 / 3 + 0.15)
    assert S.phrase_score([1, 5, 9], compat=True) == pytest.approx(0.7 / 6 + 0.3 / 2)
    assert S.phrase_score([]) == 0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_snippet(spark):
    text = F.lit("a b c d e f g b")
    assert one(spark, S.snippet(text, F.array(F.lit(3), F.lit(1)), 4)) == "<b>b</b> c <b>d</b> e"
    assert one(spark, S.snippet(text, F.array().cast("array<int>"), 3)) == "a b c"
    assert one(spark, S.snippet(text, F.array(F.lit(7)), 4)) == "f g b"


def test_bands_and_titles(spark):
    got = [one(spark, S.place_band(F.lit(d))) for d in (0, -50, 100, 700, 1500, 9000)]
    assert got == [1.0, 0.8, 0.6, 0.4, 0.2, 0.1]
    assert one(spark, S.title_match(F.lit("Old Library"), F.lit("a library"), ["library"])) == pytest.approx(1 / 3)
    assert one(spark, S.title_match(F.lit(""), F.lit(""), ["library"])) == 0


def test_search_end_to_end(spark, tmp_path):
    pages = spark.createDataFrame([("d1", "Red boats", "u1", None, "red boats sail far"), ("d2", "Other", "u2", "x", "boats far away are red"), ("d3", None, None, None, "green boats"), ("d4", "n", "u", "d", None)], "doc string, title string, url string, description string, text string")
    from millrace.plans import index as I

    index = I.served_index(I.tokens_by_space(pages, "doc", "text"))
    ranks = spark.createDataFrame([("d1", 0.5), ("d1", 0.9), ("d2", None)], "url_hash string, rank double")
    rows = S.search("Red-boats", index, pages, ranks).collect()
    assert [r["doc"] for r in rows] == ["d1", "d2"]
    assert rows[0]["rank"] == 0.9 and rows[1]["rank"] == 0.0 and rows[0]["snippet"].startswith("<b>red</b> <b>boats</b>")
    assert S.search("nothing-here", index, pages, ranks).count() == 0
    assert S.search("Red-boats", index, pages, ranks, offset=1).count() == 1
    assert S.search("red", index, pages.limit(0), ranks.limit(0)).count() == 2
    # the same from a stored index and stored pages, of which only the buckets of the words and results are read
    kept = I.store_index(index, str(tmp_path / "index"), 8)
    texts = I.store_pages(pages, str(tmp_path / "pages"), 8)
    assert kept.documents == 3 and S.search("Red-boats", kept, texts, ranks).collect() == rows
    plan = S.of_words(kept, ["red"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket").replace("PartitionFilters: [(bucket", "PartitionFilters: [bucket") or "bucket" in plan.split("PartitionFilters:")[1][:60]
    assert S.of_words(kept, []).count() == 0 and texts.of([]).count() == 0
    assert S.search("red-red-boats", index, pages, ranks, query_tf=True, drop=None).collect()[0]["tfidf"] > rows[0]["tfidf"]
    near = {r["doc"]: r["score"] for r in S.place_search(kept, spark.createDataFrame([("d1", "19104"), ("d2", "500")], "row_key string, zip string"), ["red", "boats"], 19104).collect()}
    assert near["d1"] == pytest.approx(2 + S.phrase_score([0, 1])) and near["d2"] < near["d1"]
    assert {r["doc"]: r["lists"] for r in S.positions_of(index, ["red", "far"]).collect()}["d1"] == {"red": [0], "far": [3]}


def test_result_cache(spark):
    asked = []

    def run(query):
        asked.append(query)
        return spark.range(25).orderBy("id")

    cache = S.ResultCache(run, most=20, queries=1, stop_words=frozenset({"the"}))
    assert [r["id"] for r in cache.page("the-Red-boat", 10, 5)] == [10, 11, 12, 13, 14] and [r["id"] for r in cache.page("red-boat", 18)] == [18, 19]
    assert len(asked) == 1 and [r["id"] for r in cache.page("red-boat", 50, 2)] == [0, 1]
    cache.page("mill")
    cache.page("red-boat")
    assert len(asked) == 3


def test_image_tags(spark):
    from millrace.plans import index as I

    page = '<img src="/a.png" alt="Old\nMill" title="T"><IMG alt="x" src="b.png"><img alt="none">'
    df = spark.createDataFrame([("k", "http://s.org:80/d/p.html", page), ("n", None, page), ("z", "u", None)], "row_key string, url string, page string")
    got = {(r["row_key"], r["src"]): (r["address"], r["alt"], r["title"]) for r in I.image_tags(df).collect()}
    assert got[("k", "/a.png")] == ("http://s.org:80/a.png", "old mill", "t") and got[("k", "b.png")] == ("http://s.org:80/d/b.png", "x", "") and got[("n", "/a.png")][0] is None and len(got) == 4


def test_suggestions(spark):
    words = spark.createDataFrame([(w,) for w in ("library", "libraries", "liberty", "harbour", "harbor", "harbor")], "word string")
    assert [r["word"] for r in Q.completions(words, "lib", 2).collect()] == ["liberty", "libraries"]
    assert [tuple(r) for r in Q.near_words(words, "libary", 2).collect()] == [("library", 1), ("liberty", 2)]
    assert Q.corrected(words, "libraru of harber 42", frozenset({"of"})) == "library of harbor 42"
    assert {r["suggestion"] for r in Q.corrected_last(words, "old harbr").collect()} == {"old harbor", "old harbour"}
    assert Q.contains(words, "library") and not Q.contains(words, "lib") and Q.starts_any(words, "lib") and not Q.starts_any(words, "x")
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b a b c".split())], "doc int, pos int, word string")
    t = Q.transitions(tokens)
    assert {(r["gram"], r["next"]): r["n"] for r in t.collect()} == {("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 1}
    assert {r["next"] for r in Q.followers(t, "b").collect()} == {"a", "c"}
    walk = Q.random_text(t, "a", 5, 3)
    assert walk == Q.random_text(t, "a", 5, 3) and walk.startswith("a b")


def test_robots(spark):
    rules = X.robots_rules("User-agent: *\nDisallow: /a\nAllow: /a/b # why\nCrawl-delay: 2\n\nUser-agent: me\nUser-agent: you\nDisallow: /\n")
    assert ("*", "crawl-delay", "2") in rules and ("you", "disallow", "/") in rules and ("*", "allow", "/a/b") in rules
    assert X.robots_rules(None) == []
    r = spark.createDataFrame([("h", *x) for x in rules], "key string, agent string, action string, value string")
    urls = spark.createDataFrame([("h", p) for p in ("/", "/a", "/a/b/c", "/x")] + [("other", "/a")], "key string, path string")
    assert sorted((x["key"], x["path"]) for x in X.allowed_paths(urls, r, "z").collect()) == [("h", "/"), ("h", "/a/b/c"), ("h", "/x"), ("other", "/a")]
    assert [(x["key"], x["path"]) for x in X.allowed_paths(urls, r, "me").collect()] == [("other", "/a")]


def test_crawl_loop(spark):
    pages = [("http://a.org:80/", "200", '<a href="/b">b</a><a href="http://bad.org/">q</a>'), ("http://a.org:80/b", "200", '<a href="/">up</a> <a href="/gone">g</a>')]
    table = spark.createDataFrame([(u, c, "text/html", p, None) for u, c, p in pages], "url string, responsecode string, contenttype string, page string, fetched_at timestamp_ntz")
    seeds = spark.createDataFrame([("http://a.org:80/",)], "url string")
    got = {r["url"]: r["responsecode"] for r in C.crawl(seeds, X.TableFetcher(table)).pages.collect()}
    assert got == {"http://a.org:80/": "200", "http://a.org:80/b": "200", "http://a.org:80/gone": "404"}
    short = C.crawl(seeds, X.TableFetcher(table), rounds=1)
    assert [r["url"] for r in short.pages.collect()] == ["http://a.org:80/"] and {r["url"] for r in short.frontier.collect()} >= {"http://a.org:80/b"}


def test_crawl_obeys_robots_and_pauses(spark):
    links = "".join(f'<a href="/p{i}">x</a>' for i in range(12)) + '<a href="/private/x">x</a>'
    pages = [("http://a.org:80/robots.txt", "User-agent: *\nDisallow: /private\nCrawl-delay: 3"), ("http://a.org:80/", links), *((f"http://a.org:80/p{i}", "page") for i in range(12))]
    table = spark.createDataFrame([(u, "200", "text/html", p, None) for u, p in pages], "url string, responsecode string, contenttype string, page string, fetched_at timestamp_ntz")
    seeds = spark.createDataFrame([("http://a.org:80/",)], "url string")
    clock = C.StepClock()
    began = clock.now()
    got = {r["url"]: r["responsecode"] for r in C.crawl(seeds, X.TableFetcher(table), clock=clock, per_host=4).pages.collect()}
    assert got["http://a.org:80/private/x"] == "robots" and sum(c == "200" for c in got.values()) == 13  # more than ten pages of one host
    assert (clock.now() - began).total_seconds() >= 3 * 3


class Busy:
    """Answers 429 to the first call, then as the table does."""

    def __init__(self, table):
        self.table, self.calls = table, 0

    def fetch(self, urls):
        out = X.TableFetcher(self.table).fetch(urls)
        self.calls += 1
        return out.withColumns({"responsecode": F.lit("429"), "retry_after": F.lit(7.0)}) if self.calls == 1 else out


def test_crawl_backs_off(spark):
    table = spark.createDataFrame([("http://a.org:80/", "200", "text/html", "page", None)], "url string, responsecode string, contenttype string, page string, fetched_at timestamp_ntz")
    clock = C.StepClock()
    began = clock.now()
    got = C.crawl(spark.createDataFrame([("http://a.org:80/",)], "url string"), Busy(table), robots=False, clock=clock)
    assert [r["responsecode"] for r in got.pages.collect()] == ["200"] and (clock.now() - began).total_seconds() >= 7 and got.frontier.count() == 0


def test_lookups(spark):
    urls = spark.createDataFrame([("h1", "http://x.a.org:80/p?q=1", 3.0), ("h2", "http://x.a.org:80/p?q=2", 2.0), ("h3", "http://y.a.org:80/z", 1.0), ("h4", "http://z.a.org:80/z", 0.5), ("h5", "http://b.org:80/", 0.1)], "url_hash string, url string, rank double")
    assert [r["url_hash"] for r in L.diverse_top(urls, 2, 3).collect()] == ["h1", "h3", "h5"]
    assert L.drop_then_best(urls, 100, 2).count() == 2 and L.drop_then_best(urls, 1, 2).count() == 1
    black = spark.createDataFrame([("http://x.*",), (None,)], "pattern string")
    assert L.without_blacklisted(urls.select("url"), black).count() == 3
    same = spark.createDataFrame([("k1", "b", "same"), ("k2", "a", "same"), ("k3", "c", None)], "row_key string, url string, page string")
    assert {(r["row_key"], r["canonical"]) for r in L.first_of_content(same).collect()} == {("k1", "k2"), ("k2", "k2")}
    assert [r["position"] for r in L.top_per_group(urls.withColumn("g", F.lit(1)), "g", [F.desc("rank")], 2).collect()] == [1, 2]
    d = L.with_details(urls.select("url_hash"), spark.createDataFrame([("h1", "t")], "url_hash string, title string"), "url_hash", ["title"])
    assert {r["url_hash"]: r["title"] for r in d.collect()}["h2"] == ""


def test_text_functions(spark):
    assert one(spark, T.valid_word(F.lit("tree"))) and not one(spark, T.valid_word(F.lit("treee"))) and not one(spark, T.valid_word(F.lit("ab"))) and not one(spark, T.valid_word(F.lit("a1b")))
    assert one(spark, T.named_places(F.lit("from New York, to Boston"), ["Boston", "New York", "York", "Paris"])) == ["Boston", "New York", "York"]
    assert one(spark, T.zip_codes(F.lit("ZIP code: 19104 and zip 12"))) == ["zip code: 19104"]
    assert one(spark, T.images_html(F.array(F.lit("a"), F.lit("b")))) == '<img src="a"><img src="b">'
    none = F.lit(None).cast("string")
    assert one(spark, T.file_title(none, F.lit("http://www.a.org/x/report.pdf"), F.lit("application/pdf"))) == "report PDF from a.org"
    assert one(spark, T.file_title(F.lit("Own"), F.lit("http://a.org/x"), none)) == "Own" and one(spark, T.file_title(F.lit(""), F.lit("x.bin"), F.lit("?"))) == "x from unknown domain"
    assert one(spark, T.file_icon(F.lit("application/pdf"), {"application/pdf": "p.png"}, "d.png")) == "p.png" and one(spark, T.file_icon(none, {}, "d.png")) == "d.png"
    assert one(spark, T.min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.5
    assert T.query_terms("Red--Blue-red") == ["red", "blue"]
    assert one(spark, U.root_url(F.lit("http://a/b?c#d"))) == "http://a/b"
    assert one(spark, U.host_of(F.lit("nonsense"))) == "Unknown" and one(spark, U.top_domain(F.lit("http://a.b.c:80/x"))) == "b.c"
    assert [one(spark, X.ip_address(F.lit(i))) for i in ("1.2.3.4", "256.1.1.1", "1:2:3:4:5:6:7:8")] == [True, False, True]
    assert [one(spark, X.weather_text(F.lit(c))) for c in (0, 3, 45, 57, 65, 66, 77, 82, 85, 99)] == ["Clear sky", "Partly cloudy", "Unknown", "Drizzle", "Rain", "Unknown", "Snow", "Rain showers", "Unknown", "Thunderstorm"]
    assert T.query_terms("The-Libraries-of-the-town", frozenset({"the", "of"}), {"libraries": "library"}) == ["library", "town"] and T.query_terms("the", frozenset({"the"})) == ["the"]
    assert T.query_counts("red-boat-red") == {"red": 2, "boat": 1}
    page = F.lit('<meta property="og:latitude" content="1.5"><meta property="og:longitude" content="2">')
    assert one(spark, T.page_location(page)) == "1.5,2" and one(spark, T.page_location(F.lit("<p>"))) == ""
    assert [one(spark, U.unwanted_link(F.lit(u))) for u in ("http://x.org/AD/1", "https://www.nbcnews.com:443/select/a", "http://x.org/?u=mailto:z", "http://x.org/mill")] == [True, True, True, False]
    assert [round(one(spark, U.domain_drop_share(F.lit(u))), 1) for u in ("http://a.org:80/x", "http://a.io/x", "http://a.test/x")] == [0.1, 0.3, 0.8]
    assert one(spark, U.random_looking(F.lit("http://a.org/1/2/3/4/abcdefghijk"))) and not one(spark, U.random_looking(F.lit("http://a.org/abcdefghijk")))


def test_letters_of_all_scripts(spark):
    page = F.lit("<head><title>no</title></head><p onclick='x()'>Übermäßig schön été</p><script>var a</script><noscript>off</noscript><p>Книга, Privacy Policy!</p><footer>end</footer>")
    assert one(spark, T.body_letters(page)).split() == "übermäßig schön été книга".split()
    assert one(spark, T.paragraph_letters(F.lit("<h1>Été 5</h1>x<p class=a>Книга <b>и</b> кот</p>"))) == "été книга b и b кот"
    assert one(spark, T.sanitized(F.lit("L'été, №5: Книга\u00a0да"))) == "L'été 5 Книга да"


def test_visible_text():
    page = "<html><head><title>t</title><style>x{}</style></head><body><nav>menu</nav><p>One <b>bold</b> word here.<script>var a;</script></p><footer>f</footer><div>tail text</div></body></html>"
    assert text_of(page) == "One bold word here. tail text" and "menu" not in text_of(page) and text_of(None) is None and text_of("") == ""
    assert main_lines("<p>short</p><p>a line that is long enough</p><p>see http://x.org for all the rest</p>") == "a line that is long enough"
