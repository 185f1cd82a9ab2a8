"""The crawl as a loop over frontiers."""

from __future__ import annotations

import datetime as dt
import time
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import crawlable, top_domain, url_hash, url_parts
from millrace.operators.lookups import with_host_limit, without_blacklisted
from millrace.plans.links import links_of, wanted_links
from millrace.session import cut
from millrace.sources.fetch import Fetcher, allowed_paths, host_rules

#: Seconds that a host is left alone after 429 where it names none.
BACK_OFF = 60.0
PAGE = "row_key string, url string, responsecode string, contenttype string, page string, fetched_at timestamp_ntz"
HOSTS = "host string, last_access timestamp_ntz, crawl_delay double, not_before timestamp_ntz"
RULES = "key string, agent string, action string, value string"


class Clock(Protocol):
    """Tells the time and waits."""

    def now(self) -> dt.datetime: ...

    def wait(self, seconds: float) -> None: ...


class SystemClock:
    def now(self) -> dt.datetime:
        return dt.datetime.now()

    def wait(self, seconds: float) -> None:
        time.sleep(seconds)


class StepClock:
    """A clock that only waiting moves, for crawls that are answered from tables."""

    def __init__(self, start: dt.datetime = dt.datetime(2024, 1, 1)):
        self.at = start

    def now(self) -> dt.datetime:
        return self.at

    def wait(self, seconds: float) -> None:
        self.at += dt.timedelta(seconds=seconds)


class Crawl(NamedTuple):
    """Pages that were fetched (or refused by their robots file, responsecode ``robots``), and addresses left over; none unless ``rounds`` ended the crawl."""

    pages: DataFrame
    frontier: DataFrame


def frontier_step(
    frontier: DataFrame, crawled: DataFrame, hosts: DataFrame, now: Column, seeds: DataFrame | None = None, blacklist: DataFrame | None = None, pause: float = 1.0, per_host: int | None = 1
) -> DataFrame:
    """url, host, fetch of the frontier's addresses that are new, crawlable, in the seeds' domains and not blacklisted; ``fetch`` says which go now, ``per_host`` for each host."""
    urls = frontier.where("url is not null").select("url").distinct().where(crawlable(F.col("url")))
    urls = urls.withColumn("_h", url_hash(F.col("url"))).join(crawled.select(F.col("row_key").alias("_h")), "_h", "left_anti").drop("_h")
    if seeds is not None:
        urls = urls.withColumn("_d", top_domain(F.col("url"))).join(seeds.select(top_domain(F.col("url")).alias("_d")).distinct(), "_d", "left_semi").drop("_d")
    if blacklist is not None:
        urls = without_blacklisted(urls, blacklist)
    return with_host_limit(urls, hosts, now, pause, per_host)


def _origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1))


def crawl(
    seeds: DataFrame,
    fetcher: Fetcher,
    rounds: int | None = None,
    blacklist: DataFrame | None = None,
    agent: str = "millrace",
    pause: float = 0.0,
    per_host: int | None = 1,
    robots: bool = True,
    clock: Clock | None = None,
) -> Crawl:
    """Rounds of fetching and link extraction from the seeds until the frontier is empty, or for ``rounds``: the pages, and what was left.

    Every origin's robots file is fetched once, before its first page; what it forbids for ``agent`` is refused, and its crawl delay holds where it is longer than ``pause``. A host that
    answers 429 is left alone as long as it asks, or ``BACK_OFF`` seconds, and the address is tried again. When every address left waits for its host, the clock waits.
    """
    spark = seeds.sparkSession
    clock = clock or SystemClock()
    pages = [spark.createDataFrame([], PAGE)]
    seen = spark.createDataFrame([], "row_key string")
    hosts = spark.createDataFrame([], HOSTS)
    rules = spark.createDataFrame([], RULES)
    origins = spark.createDataFrame([], "origin string")
    frontier = seeds.select("url")
    done = 0
    while rounds is None or done < rounds:
        now = F.lit(clock.now()).cast("timestamp_ntz")
        plan = cut(frontier_step(frontier, seen, hosts, now, seeds, blacklist, pause, per_host))
        if plan.isEmpty():
            frontier = plan.select("url")
            break
        if robots:
            new = cut(plan.select(_origin(F.col("url")).alias("origin")).distinct().join(origins, "origin", "left_anti"))
            if not new.isEmpty():
                texts = fetcher.fetch(new.select(F.concat("origin", F.lit("/robots.txt")).alias("url"))).where("responsecode = '200' and page is not null")
                found = cut(host_rules(texts.select(_origin(F.col("url")).alias("origin"), F.col("page").alias("robots")), "origin"))
                rules, origins = cut(rules.unionByName(found)), cut(origins.unionByName(new))
                own = found.where(F.col("agent").isin(agent.lower(), "*") & (F.col("action") == "crawl-delay"))
                host = F.lower(F.regexp_replace(F.regexp_extract("key", r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", ""))
                delays = own.select(host.alias("host"), F.lit(None).cast("timestamp_ntz").alias("last_access"), F.expr("try_cast(value as double)").alias("crawl_delay"), F.lit(None).cast("timestamp_ntz").alias("not_before"))
                hosts = cut(hosts.unionByName(delays.where("crawl_delay is not null")))
        due = plan.where("fetch").select("url", _origin(F.col("url")).alias("key"), F.coalesce(url_parts(F.col("url"))["path"], F.lit("/")).alias("path"))
        go = cut(allowed_paths(due, rules, agent).select("url") if robots else due.select("url"))
        refused = due.select("url").join(go, "url", "left_anti").select("url", F.lit("robots").alias("responsecode"), *(F.lit(None).cast("string").alias(c) for c in ("contenttype", "page", "location")), now.alias("fetched_at"), F.lit(None).cast("double").alias("retry_after"))
        answers = fetcher.fetch(go)
        got = cut(answers.select("url", "responsecode", "contenttype", "page", "location", "fetched_at", "retry_after").unionByName(refused).withColumn("row_key", url_hash(F.col("url"))))
        if got.isEmpty():  # every address waits for its host
            clock.wait(max(pause, 1.0))
            continue
        done += 1
        busy = got.where("responsecode = '429'")
        kept = got.where("responsecode <> '429'")
        pages.append(kept.select("row_key", "url", "responsecode", "contenttype", "page", "fetched_at"))
        seen = cut(seen.unionByName(kept.select("row_key")))
        host = F.lower(F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1), r"^www\.", ""))
        touched = got.where("responsecode <> 'robots'").select(host.alias("host"), now.alias("last_access"), F.lit(None).cast("double").alias("crawl_delay"), F.lit(None).cast("timestamp_ntz").alias("not_before"))
        later = busy.select(host.alias("host"), F.lit(None).cast("timestamp_ntz").alias("last_access"), F.lit(None).cast("double").alias("crawl_delay"), (now + F.make_dt_interval(secs=F.coalesce("retry_after", F.lit(BACK_OFF)).cast("decimal(18,6)"))).alias("not_before"))
        state = hosts.unionByName(touched).unionByName(later).groupBy("host").agg(F.max("last_access").alias("last_access"), F.max("crawl_delay").alias("crawl_delay"), F.max("not_before").alias("not_before"))
        hosts = cut(state)
        moved = kept.where("location is not null").select(F.col("location").alias("url"))
        found = wanted_links(links_of(kept.where("responsecode = '200'"))).select(F.col("link").alias("url"))
        frontier = cut(plan.where("not fetch").select("url").union(found).union(moved).union(busy.select("url")).distinct())
    whole = pages[0]
    for p in pages[1:]:
        whole = whole.unionByName(p)
    return Crawl(whole, frontier)
