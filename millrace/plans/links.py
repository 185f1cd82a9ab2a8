"""Link extraction and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import normalized_link, unwanted_link, url_hash

#: An attribute ``href`` anywhere in the tag of a link, its value in double, single or no quotes.
HREF = r"""(?i)<a\s[^>]*?(?<=[\s"'])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: The same, with quotes only.
QUOTED_HREF = r"""(?i)<a\s[^>]*?(?<=[\s"'])href\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def raw_links(page: Column, quoted_only: bool = False) -> Column:
    """The addresses of all links of a page, in order."""
    pattern, groups = (QUOTED_HREF, 2) if quoted_only else (HREF, 3)
    found = F.regexp_extract_all(page, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda tag: F.concat(*(F.regexp_extract(tag, pattern, k + 1) for k in range(groups))))


def links_of(pages: DataFrame, quoted_only: bool = False) -> DataFrame:
    """row_key, url, link: the distinct normalised links of every page."""
    found = pages.where("page is not null and url is not null").select("row_key", "url", F.explode(raw_links(F.col("page"), quoted_only)).alias("raw"))
    return found.select("row_key", "url", normalized_link(F.col("raw"), F.col("url")).alias("link")).where("link is not null").distinct()


def listed_links(processed: DataFrame) -> DataFrame:
    """As ``links_of``, from links kept one per line."""
    found = processed.where("links is not null and url is not null").select("row_key", "url", F.explode(F.split("links", "\n")).alias("raw"))
    return found.select("row_key", "url", normalized_link(F.col("raw"), F.col("url")).alias("link")).where("link is not null").distinct()


def wanted_links(links: DataFrame) -> DataFrame:
    return links.where(~unwanted_link(F.col("link")))


def edges_of(links: DataFrame) -> DataFrame:
    """src, dst of distinct links as url hashes."""
    return links.select(F.col("row_key").alias("src"), url_hash(F.col("link")).alias("dst")).distinct()


def edges_from_cells(cells: DataFrame) -> DataFrame:
    """src, dst of wide rows: the row links to each of its columns."""
    return cells.where("row_key is not null and col is not null").select(F.col("row_key").alias("src"), F.col("col").alias("dst")).distinct()


def crawled_only(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges whose target was crawled."""
    return edges.join(pages.select(F.col("row_key").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """node, neighbours: sorted distinct neighbours joined by line feeds."""
    node, other = ("dst", "src") if reverse else ("src", "dst")
    return edges.groupBy(F.col(node).alias("node")).agg(F.array_join(F.array_sort(F.collect_set(other)), "\n").alias("neighbours"))


def sinks(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that link nowhere."""
    return pages.select("row_key").distinct().join(edges.select(F.col("src").alias("row_key")), "row_key", "left_anti")


def anchor_texts(pages: DataFrame) -> DataFrame:
    """dst, src, text: the anchor texts from one page to one target in sorted order, joined by <br>."""
    tag = F.regexp_extract_all("page", F.lit(HREF + "[^>]*>(?s:.*?)</a>"), F.lit(0))
    found = pages.where("page is not null and url is not null").select("row_key", "url", F.explode(tag).alias("tag"))
    text = F.trim(F.regexp_replace(F.regexp_replace("tag", r"<[^>]*>", " "), r"\s+", " "))
    linked = found.select("row_key", normalized_link(F.element_at(raw_links(F.col("tag")), 1), F.col("url")).alias("link"), text.alias("text")).where("link is not null and text <> ''")
    return linked.distinct().groupBy(url_hash(F.col("link")).alias("dst"), F.col("row_key").alias("src")).agg(F.array_join(F.array_sort(F.collect_list("text")), "<br>").alias("text"))


def site_counts(pages: DataFrame) -> DataFrame:
    from millrace.functions.urls import top_domain

    return pages.where("url is not null").groupBy(top_domain(F.col("url")).alias("domain")).agg(F.count_distinct("row_key").alias("pages"))
