"""Lookups, anti-joins and top-k selections that the search and crawl plans are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.urls import host_of, root_url, top_domain, wildcard_regex

#: Blacklist patterns that are merged into one.
ONE_PATTERN = 5_000


def resolved(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Ids replaced by what they stand for; unknown ids are dropped."""
    return rows.join(ids, key)


def with_details(rows: DataFrame, details: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Details of each row, empty where there are none."""
    return rows.join(details.select(key, *columns), key, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def best_ranks(ranks: DataFrame) -> DataFrame:
    """One rank for each url_hash, the greatest of those given; null ranks don't count."""
    return ranks.where("url_hash is not null and rank is not null").groupBy("url_hash").agg(F.max("rank").alias("rank"))


def with_rank(rows: DataFrame, ranks: DataFrame, missing: float | None = 0.0) -> DataFrame:
    """The rank of each url_hash; rows without one get ``missing``, or are dropped if that is none."""
    if missing is None:
        return rows.join(best_ranks(ranks), "url_hash")
    return rows.join(best_ranks(ranks), "url_hash", "left").withColumn("rank", F.coalesce("rank", F.lit(missing)))


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def without_blacklisted(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """Urls that match none of the wildcard patterns (a configuration table). All patterns become one, compiled once for each task, up to ``ONE_PATTERN`` of them; beyond that they are joined."""
    bad = patterns.where("pattern is not null").select(wildcard_regex(F.col("pattern")).alias("_p")).distinct()
    rows = bad.limit(ONE_PATTERN + 1).collect()  # bounded by ONE_PATTERN
    if len(rows) > ONE_PATTERN:
        return urls.join(bad, F.expr("url rlike _p"), "left_anti")
    return urls.where(~F.col("url").rlike("|".join(sorted(f"(?:{r['_p']})" for r in rows))) | F.col("url").isNull()) if rows else urls


def first_of_content(pages: DataFrame) -> DataFrame:
    """row_key, canonical: of pages with the same content, the one with the least url."""
    content = F.sha1("page")
    first = pages.where("page is not null").groupBy(content.alias("_c")).agg(F.min(F.struct("url", "row_key")).alias("_m"))
    return pages.where("page is not null").select("row_key", content.alias("_c")).join(first, "_c").select("row_key", F.col("_m.row_key").alias("canonical")).distinct()


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group with their position. Spark keeps k rows of a group in each partition before the shuffle."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("position") <= k)


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def drop_then_best(rows: DataFrame, drop: int | None, best: int, seed: int = 0) -> DataFrame:
    """At most ``drop`` rows by a seeded hash of url_hash (all rows if it is none), and of those the ``best`` by rank."""
    kept = rows if drop is None else rows.orderBy(F.xxhash64("url_hash", F.lit(seed)), "url_hash").limit(drop)
    return kept.orderBy(F.desc("rank"), "url_hash").limit(best)


def diverse_top(rows: DataFrame, per_domain: int = 2, limit: int = 10) -> DataFrame:
    """By rank, one page for each domain and root url, at most ``per_domain`` of a domain, ``limit`` in all."""
    order = [F.desc("rank"), F.asc("url")]
    one = top_per_group(rows.withColumn("domain", top_domain(F.col("url"))).withColumn("_g", F.concat_ws("|", "domain", root_url(F.col("url")))), "_g", order, 1).drop("_g", "position")
    return top_per_group(one, "domain", order, per_domain).drop("position").orderBy(*order).limit(limit)


def with_host_limit(frontier: DataFrame, hosts: DataFrame, now: Column, pause: float = 1.0, per_host: int | None = 1) -> DataFrame:
    """url, host, fetch: the first ``per_host`` urls of each host (all if it is none) that was not visited within ``pause`` seconds, or its crawl delay, are fetched, the others wait.

    A host may also have ``not_before``, a time until which it asked to be left alone.
    """
    late = F.max("not_before") if "not_before" in hosts.columns else F.lit(None).cast("timestamp_ntz")
    state = hosts.where("host is not null").groupBy("host").agg(F.max("last_access").alias("_last"), F.max("crawl_delay").alias("_delay"), late.alias("_late"))
    known = frontier.withColumn("host", F.lower(host_of(F.col("url")))).join(state, "host", "left")
    free = F.col("_last").isNull() | (F.col("_last") + F.make_dt_interval(secs=F.greatest(F.coalesce("_delay", F.lit(0.0)), F.lit(pause)).cast("decimal(18,6)")) <= now)
    free = free & (F.col("_late").isNull() | (F.col("_late") <= now))
    first = F.lit(True) if per_host is None else F.row_number().over(W.partitionBy("host").orderBy("url")) <= per_host
    return known.withColumn("fetch", free & first).select("url", "host", "fetch")
