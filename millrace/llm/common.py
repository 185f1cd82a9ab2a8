"""What several of the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def site_of(url: Column) -> Column:
    """Host of a url in lower case, without port and leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def key128(text: Column) -> Column:
    """A 128-bit key of a text, short enough to shuffle in place of it."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def with_site(processed: DataFrame, crawl: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` plus ``site`` of each processed row; a null url is taken from the crawl's row of the same key.

    Only rows without a url take part in the join. Rows whose site stays unknown have a null ``site``.
    """
    own = processed.where("url is not null").select(*keep, site_of(F.col("url")).alias("site"))
    urls = (
        crawl.where("url is not null and row_key is not null")
        .groupBy("row_key")
        .agg(F.max("url").alias("_url"))
    )
    lost = (
        processed.where("url is null")
        .select(*keep)
        .join(urls, "row_key", "left")
        .select(*keep, site_of(F.col("_url")).alias("site"))
    )
    return own.unionByName(lost)


#: Most texts or pages that a Python worker holds at once.
TEXT_BATCH = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_texts(rows: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` for rows with whole texts or pages: the session's Arrow batches are lowered to ``TEXT_BATCH`` rows where they are larger, since Spark bounds them by rows, not bytes."""
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_BATCH, "10000")) <= TEXT_BATCH:
        conf.set(_BATCH, str(TEXT_BATCH))
    return rows.mapInPandas(function, schema)


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows, at most twice as many, chosen by a hash of ``key``. The rows are counted first, so only the sample itself leaves the executors."""
    share = min(1.0, n / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * n)
