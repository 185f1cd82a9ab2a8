import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.functions.lexicon import lemmatized
from millrace.operators import kv as K
from millrace.plans import index as I
from millrace.sources import fetch as X


def test_seeds_files_and_sink(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text(" http://a.org/ \n\n\t\nhttp://b.org/\n")
    assert [r["url"] for r in X.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["http://a.org/", "http://b.org/"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.txt").write_bytes("naïve text".encode())
    rows = X.files(spark, str(tmp_path / "docs")).collect()
    assert [r["text"] for r in rows] == ["naïve text"]
    assert X.files(spark, str(tmp_path / "docs"), parse=lambda b: str(len(b))).first()["text"] == "11"
    X.processed_keys_sink(spark.createDataFrame([("k1",)], "row_key string"), str(tmp_path / "done"))
    X.processed_keys_sink(spark.createDataFrame([("k2",)], "row_key string"), str(tmp_path / "done"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "done")).collect()) == ["k1", "k2"]


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        code = {"/moved": 302, "/gone": 404, "/busy": 429}.get(self.path, 200)
        self.send_response(code)
        if code == 302:
            self.send_header("Location", "/new")
        if code == 429:
            self.send_header("Retry-After", "9")
        self.send_header("Content-Type", f"text/html; charset={'no-such' if self.path == '/odd' else 'utf-8'}")
        if self.path == "/broken":
            self.send_header("Content-Length", "100000")
        self.end_headers()
        self.wfile.write(("<p>größer</p>" + "x" * 6_000_000 * (self.path == "/long")).encode())

    do_HEAD = do_GET

    def log_message(self, *_):
        pass


def test_http_fetcher(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}{p}",) for p in ("/", "/moved", "/gone", "/busy", "/odd", "/long", "/broken")] + [("http://127.0.0.1:1/",), ("not a url",)], "url string")
    got = {r["url"].removeprefix(base): r for r in X.HttpFetcher("millrace-test").fetch(urls).collect()}
    heads = {r["url"].removeprefix(base): r for r in X.HttpFetcher("millrace-test").head(spark.createDataFrame([(f"{base}/",), (f"{base}/moved",), ("not a url",)], "url string")).collect()}
    assert heads["/"]["responsecode"] == "200" and heads["/"]["contenttype"].startswith("text/html") and heads["/moved"]["location"] == "/new" and heads["not a url"]["error"]
    server.shutdown()
    assert got["/"]["responsecode"] == "200" and got["/"]["page"] == "<p>größer</p>"
    assert got["/moved"]["responsecode"] == "302" and got["/moved"]["location"] == "/new" and got["/gone"]["responsecode"] == "404"
    assert got["http://127.0.0.1:1/"]["responsecode"] == "0" and got["not a url"]["error"].startswith("ValueError")
    assert got["/busy"]["retry_after"] == 9 and got["/odd"]["page"] == "<p>größer</p>" and "no-such" in got["/odd"]["error"]
    assert len(got["/long"]["page"]) > 6_000_000 and "IncompleteRead" in got["/broken"]["error"]


def test_host_limits(spark):
    from millrace.operators.lookups import with_host_limit

    hosts = spark.createDataFrame([("a.org", "2024-01-01 00:00:00", 5.0), ("b.org", "2024-01-01 00:00:00", None)], "host string, last_access string, crawl_delay double").withColumn("last_access", F.col("last_access").cast("timestamp_ntz"))
    urls = spark.createDataFrame([("http://a.org:80/1",), ("http://b.org:80/2",), ("http://b.org:80/1",), ("http://c.org:80/1",)], "url string")
    got = {r["url"]: r["fetch"] for r in with_host_limit(urls, hosts, F.lit("2024-01-01 00:00:02").cast("timestamp_ntz")).collect()}
    assert got == {"http://a.org:80/1": False, "http://b.org:80/1": True, "http://b.org:80/2": False, "http://c.org:80/1": True}


def test_command_line(spark, capsys):
    for argv in (["put", "cli_cells", "r", "c", "v"], ["count", "cli_cells"], ["get", "cli_cells", "r", "c"], ["scan", "cli_cells"], ["rename", "cli_cells", "cli_other"], ["delete", "cli_other"]):
        K.main(argv)
    out = capsys.readouterr().out
    assert "1\n" in out and "value='v'" in out
    assert not spark.catalog.tableExists("cli_other")


def test_lexicon(spark):
    words = spark.createDataFrame([("Records", 1), ("the", 2), ("unknown", 3), ("mill", 4), (None, 5)], "word string, pos int")
    dictionary = spark.createDataFrame([("records",), ("The",), ("mill",), ("mill",), (None,)], "word string")
    lemmas = spark.createDataFrame([("records", "record")], "word string, lemma string")
    stops = spark.createDataFrame([("the",)], "word string")
    got = {(r["word"], r["pos"]) for r in lemmatized(words, dictionary, lemmas, stops).collect()}
    assert got == {("record", 1), ("mill", 4)}


def test_places_and_depth(spark):
    pages = spark.createDataFrame([("k1", "1.2.3.4"), ("k2", "9.9.9.9"), ("k3", None)], "row_key string, ip string")
    places = spark.createDataFrame([("1.2.3.4", "19104"), ("1.2.3.4", "20000"), (None, "1")], "ip string, zip string")
    assert [tuple(r) for r in I.place_index(pages, places).collect()] == [("19104", "k1")]
    share = spark.range(1).select(U.depth_drop_share(F.lit("http://a.org:80/1/2/3/4/5/6/7/8?x=/9")).alias("s")).first()["s"]
    assert share == 0.5
    kept = spark.range(2000).select(U.thinned(F.concat(F.lit("http://a.org:80/1/2/3/4/5/6/7/"), F.col("id"))).alias("k")).where("k").count()
    assert abs(kept / 2000 - 0.5) < 0.1
