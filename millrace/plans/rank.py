"""PageRank as a loop of joins and aggregates, its lineage cut every few rounds."""

from __future__ import annotations

from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def weighted_edges(
    pages: DataFrame, edges: DataFrame, decay: float = 0.85, domains: DataFrame | None = None, same_domain_weight: float = 1.0, drop_self: bool = False, reverse: bool = False
) -> DataFrame:
    """src, dst, w: what share of its rank a page hands to each crawled target.

    The out-degree counts all distinct links, also those to pages that were never crawled and those that hand on nothing; rank sent there is lost.
    ``domains`` (row_key, domain) lowers links inside one domain to ``same_domain_weight``.
    """
    e = edges.select("src", "dst").distinct()
    if reverse:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    nodes = pages.select("row_key").distinct()
    e = e.join(nodes.withColumnRenamed("row_key", "dst"), "dst", "left_semi").join(nodes.withColumnRenamed("row_key", "src"), "src", "left_semi")
    e = e.join(degree, "src").withColumn("w", decay / F.col("degree"))
    if drop_self:
        e = e.where("src <> dst")
    if domains is not None and same_domain_weight != 1.0:
        d = domains.select("row_key", "domain").distinct()
        e = e.join(d.select(F.col("row_key").alias("src"), F.col("domain").alias("_s")), "src", "left").join(d.select(F.col("row_key").alias("dst"), F.col("domain").alias("_d")), "dst", "left")
        e = e.withColumn("w", F.when(F.col("_s") == F.col("_d"), F.col("w") * same_domain_weight).otherwise(F.col("w")))
    return e.select("src", "dst", "w")


def step(ranks: DataFrame, edges: DataFrame, decay: float = 0.85, base: float | None = None) -> DataFrame:
    """One round: every page gets what it is handed, plus ``base`` (1 - decay)."""
    handed = edges.join(ranks.select(F.col("row_key").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("row_key")).agg(F.sum(F.col("rank") * F.col("w")).alias("in"))
    new = (F.lit(1 - decay if base is None else base) + F.coalesce("in", F.lit(0.0))).alias("rank")
    return ranks.join(handed, "row_key", "left").select("row_key", new, F.col("rank").alias("prev"))


def converged_share(ranks: DataFrame, eps: float) -> DataFrame:
    """The percentage of pages whose rank changed by less than ``eps``."""
    return ranks.agg((F.avg((F.abs(F.col("rank") - F.col("prev")) < eps).cast("double")) * 100).alias("percent"))


def pagerank(
    pages: DataFrame,
    edges: DataFrame,
    eps: float = 0.01,
    percent: float = 100.0,
    max_rounds: int | None = None,
    decay: float = 0.85,
    sink_spread: bool = False,
    without_sources: bool = False,
    cut_every: int = 5,
    rounds: int | None = None,
    sticky: bool = False,
    **weights,
) -> DataFrame:
    """row_key, rank, from 1 for each page until ``percent`` of the pages change by less than ``eps``, or for exactly ``rounds``.

    With ``sticky`` a page that changed by at most ``eps`` once counts as converged from then on. With ``without_sources`` only pages with inbound links have a rank, and every one
    of them gets decay squared for each page without. With ``sink_spread`` pages without links hand decay * rank / N to all. A page without links to it ends at 1 - decay. No pages
    give no ranks. Ranks that have not converged after ``max_rounds``, where that is given, are an error.

    The edges stay partitioned by their source while the rounds last, so that a round shuffles ranks and partial sums, never the edges.
    """
    nodes = pages.where("row_key is not null").select("row_key").distinct()
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lift = 0.0
    if without_sources:
        targets = edges.select(F.col("dst").alias("row_key")).distinct()
        lift = decay * decay * nodes.join(targets, "row_key", "left_anti").count()
        nodes = nodes.join(targets, "row_key", "left_semi")
    e = cut(weighted_edges(nodes, edges, decay, **weights)).repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    ranks = cut(nodes.withColumns({"rank": F.lit(1.0), "prev": F.lit(0.0), "calm": F.lit(False)}))
    if sink_spread:
        n = max(1, ranks.count())
        idle = cut(nodes.join(edges.select(F.col("src").alias("row_key")).distinct(), "row_key", "left_anti"))
    for k in count(1):
        base = 1 - decay + lift
        if sink_spread:
            base += decay * (ranks.join(idle, "row_key", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]) / n
        after = step(ranks.select("row_key", "rank"), e, decay, base)
        if sticky:
            after = after.join(ranks.select("row_key", F.col("calm").alias("_calm")), "row_key").withColumn("calm", F.col("_calm") | (F.abs(F.col("rank") - F.col("prev")) <= eps)).drop("_calm")
        ranks = after
        if rounds is None or k % cut_every == 0 or k == rounds:  # the stop rule reads every round
            ranks = cut(ranks)
        if rounds is None:
            share = ranks.agg(F.avg(F.col("calm").cast("double")) * 100) if sticky else converged_share(ranks, eps)
            if (got := share.first()[0]) is None or got >= percent:
                break
            if k == max_rounds:
                raise RuntimeError(f"{got:.2f} % of the pages have converged after {k} rounds")
        elif k == rounds:
            break
    e.unpersist()
    return ranks.select("row_key", "rank")


def rank_histogram(ranks: DataFrame, digits: int = 2) -> DataFrame:
    scale = 10**digits
    return ranks.where("rank is not null").groupBy((F.floor(F.col("rank") * scale) / scale).alias("bin")).agg(F.count(F.lit(1)).alias("pages"))
