"""Where pages come from: a fetcher interface, seeds, robots rules, places and weather codes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Fetcher(Protocol):
    """Fetches a frame with a column url; adds responsecode, contenttype, page, location (of a redirect), retry_after (seconds), error and fetched_at."""

    def fetch(self, urls: DataFrame) -> DataFrame: ...


class TableFetcher:
    """Answers from a table of pages that were crawled before; unknown addresses give 404."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def fetch(self, urls: DataFrame) -> DataFrame:
        have = self.pages.groupBy("url").agg(F.max(F.struct("fetched_at", "responsecode", "contenttype", "page")).alias("_p"))
        none = F.lit(None)
        return urls.select("url").distinct().join(have, "url", "left").select(
            "url", F.coalesce("_p.responsecode", F.lit("404")).alias("responsecode"), "_p.contenttype", "_p.page", none.cast("string").alias("location"), none.cast("double").alias("retry_after"), none.cast("string").alias("error"), "_p.fetched_at"
        )


class HttpFetcher:
    """Fetches whole bodies with the standard library, without following redirects, in as many tasks as the frame has partitions.

    Whatever goes wrong with an address, a bad url, an unknown charset or a broken answer, is its ``error`` and leaves the others alone; its responsecode is 0 if there was none.
    """

    def __init__(self, agent: str, timeout: float = 3.0):
        self.agent, self.timeout = agent, timeout

    def head(self, urls: DataFrame) -> DataFrame:
        """url, responsecode, contenttype, length, location, error, asked by HEAD alone."""
        agent, timeout = self.agent, self.timeout

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import http.client
            import urllib.parse

            for batch in batches:
                rows = []
                for url in batch["url"]:
                    try:
                        at = urllib.parse.urlsplit(url)
                        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
                        connection = kind(at.hostname or "", at.port, timeout=timeout)
                        connection.request("HEAD", urllib.parse.urlunsplit(("", "", at.path or "/", at.query, "")), headers={"User-Agent": agent})
                        r = connection.getresponse()
                        rows.append((url, str(r.status), r.headers.get("Content-Type"), r.headers.get("Content-Length"), r.headers.get("Location"), None))
                        connection.close()
                    except Exception as e:  # noqa: BLE001 one bad address must not fail the others
                        rows.append((url, "0", None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["url", "responsecode", "contenttype", "length", "location", "error"])

        return urls.select("url").distinct().mapInPandas(run, "url string, responsecode string, contenttype string, length string, location string, error string")

    def fetch(self, urls: DataFrame) -> DataFrame:
        agent, timeout = self.agent, self.timeout

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import urllib.error
            import urllib.request

            class Stay(urllib.request.HTTPRedirectHandler):
                def redirect_request(self, *_):
                    return None

            opener = urllib.request.build_opener(Stay)

            def decoded(body: bytes, charset: str | None) -> tuple[str, str | None]:
                try:
                    return body.decode(charset or "utf-8", "replace"), None
                except LookupError:
                    return body.decode("utf-8", "replace"), f"unknown charset {charset}"

            def wait_of(value: str | None) -> float | None:
                try:
                    return float(value) if value else None
                except ValueError:
                    return None  # a date; the default pause serves

            for batch in batches:
                rows = []
                for url in batch["url"]:
                    try:
                        with opener.open(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                            page, error = decoded(r.read(), r.headers.get_content_charset())
                            rows.append((url, str(r.status), r.headers.get("Content-Type"), page, None, None, error))
                    except urllib.error.HTTPError as e:
                        rows.append((url, str(e.code), None, None, e.headers.get("Location"), wait_of(e.headers.get("Retry-After")), None))
                    except Exception as e:  # noqa: BLE001 one bad address must not fail the others
                        rows.append((url, "0", None, None, None, None, f"{type(e).__name__}: {e}"))
                out = pd.DataFrame(rows, columns=["url", "responsecode", "contenttype", "page", "location", "retry_after", "error"]).astype({"retry_after": "float64"})
                yield out.assign(fetched_at=pd.Timestamp.now())

        return urls.select("url").distinct().mapInPandas(run, "url string, responsecode string, contenttype string, page string, location string, retry_after double, error string, fetched_at timestamp_ntz")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed lines of a text file that aren't blank."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("url")).where("url <> ''")


def processed_keys_sink(rows: DataFrame, path: str, key: str = "row_key") -> None:
    rows.select(F.col(key).alias("value")).write.mode("append").text(path)


def files(spark: SparkSession, path: str, parse=None) -> DataFrame:
    """path, text of files; ``parse`` turns bytes into text (UTF-8 by default), for formats whose parser is installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [(parse or (lambda b: bytes(b).decode("utf-8", "replace")))(c) for c in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def robots_rules(text: str | None) -> list[tuple[str, str, str]]:
    """(agent, action, value) of a robots file; actions are allow, disallow and crawl-delay. Consecutive agents share the rules below them."""
    out: list[tuple[str, str, str]] = []
    agents: list[str] = []
    rules = False
    for line in (text or "").splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if rules:
                agents, rules = [], False
            agents.append(value.lower())
        elif name in ("allow", "disallow", "crawl-delay") and agents:
            rules = True
            if value:
                out += [(a, name, value) for a in agents]
    return out


def host_rules(hosts: DataFrame, key: str = "row_key") -> DataFrame:
    """key, agent, action, value of every host's robots file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(batch["key"], batch["robots"]) for r in robots_rules(t)], columns=["key", "agent", "action", "value"])

    return hosts.where("robots is not null").select(F.col(key).alias("key"), "robots").distinct().mapInPandas(run, "key string, agent string, action string, value string")


def allowed_paths(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """The rows of ``urls`` (key, path, ...) that the rules allow: the longest matching rule decides, allowing wins a tie; the agent's own rules go before those for all."""
    own = rules.where(F.col("agent").isin(agent.lower(), "*") & F.col("action").isin("allow", "disallow"))
    named = own.where(F.col("agent") == agent.lower()).select("key").distinct().withColumn("_named", F.lit(True))
    used = own.join(named, "key", "left").where((F.col("agent") == agent.lower()) | F.col("_named").isNull()).select("key", "action", F.col("value").alias("_v"))
    hits = urls.select("key", "path").distinct().join(used, "key").where(F.col("path").startswith(F.col("_v")))
    best = hits.groupBy("key", "path").agg(F.max(F.when(F.col("action") == "allow", F.length("_v"))).alias("_a"), F.max(F.when(F.col("action") == "disallow", F.length("_v"))).alias("_d"))
    bad = best.where("_d is not null and (_a is null or _a < _d)").select("key", "path")
    return urls.join(bad, ["key", "path"], "left_anti")


def ip_address(s: Column) -> Column:
    """Whether a text is an IPv4 or IPv6 address."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return s.rlike(rf"^({part}\.){{3}}{part}$") | s.rlike(r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")


# The names of WMO weather codes, first and last code of each; all others are unknown.
WEATHER = ((0, 0, "Clear sky"), (1, 3, "Partly cloudy"), (51, 57, "Drizzle"), (61, 65, "Rain"), (71, 77, "Snow"), (80, 82, "Rain showers"), (95, 99, "Thunderstorm"))


def weather_text(code: Column) -> Column:
    """The name of a WMO weather code."""
    out = F.lit("Unknown")
    for low, high, name in WEATHER:
        out = F.when(code.between(low, high), name).otherwise(out)
    return out
