"""Keyword-stuffed pages and link lists, told from prose by the pointwise mutual information of neighbouring words.

The corpus counts of all words and of all neighbouring pairs are gathered over every page, and every page that has a pair is scored. A page whose pairs have a low
mean PMI is incoherent, word salad; pairs it repeats although their words attract each other strongly are stuffed collocations. One pass over the pages stores
their words as numbers, which parquet keeps as references to a dictionary; counts and the pages' pairs are read from those.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts
from millrace.llm.encoding import repair
from millrace.llm.pages import blocks_of
from millrace.session import stored

_END = re.compile(r"[.!?…。！？।؟][\"”»“」)）']*$")
_WORD = re.compile(r"\x00|[゠-ヿ]+|[一-鿿]+|[぀-ゟ]+|[^\W\d_゠-ヿ一-鿿぀-ゟ]+")
_WIDE = re.compile("[぀-ヿ一-鿿]")
#: A sign of a script without spaces counts as so many.
WIDE_WEIGHT = 2.5
#: Blocks of this weight that end like a sentence and are not links count as prose.
PROSE = 60
#: Times that a pair counts as seen, and as expected, besides the corpus.
SMOOTH = 0.5
#: So many pairs of usual PMI are added to each page before it is judged.
DOUBT = 40
#: Keys of texts without a page, and of texts under several keys, up to this many are broadcast (about 100 bytes each).
BROADCAST_KEYS = 300_000
#: Words whose counts are combined before they are handed on.
FLUSH = 3_000_000
#: The usual PMI is that of pages with this much prose, and with less than so much or at least this share of recurring pairs: pure prose has a lower one.
MIXED = (0.5, 0.7, 0.3)

PAGES = "id bigint, row bigint, page bigint, prose double, weight bigint, pairs int, words array<bigint>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARK = "\x00"


def _hashes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit numbers of words; block marks are 0."""
    if len(seen) > 500_000:
        seen.clear()
    if not seen:
        seen[_MARK] = 0
    try:
        return np.array([seen[w] for w in words], dtype=np.uint64)
    except KeyError:
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([seen[w] for w in words], dtype=np.uint64)


def _pairs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every pair of neighbours inside a block, and where it begins."""
    at = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
    x = h[at] * _MIX + (h[at + 1] ^ (h[at + 1] >> np.uint64(29)))
    return x ^ (x >> np.uint64(32)), at


def page_shape(page: str) -> tuple[float, float, list[str]]:
    """Share of prose, weight of all text, and its words with a mark between blocks."""
    total = prose = 0.0
    texts = []
    for b in blocks_of(page):
        if b.tag == "title" or "noscript" in b.path:
            continue
        text = b.text
        n = len(text)
        if not text.isascii() and _WIDE.search(text):
            n *= WIDE_WEIGHT
        total += n
        if n >= PROSE and b.linked * 2 < b.words and _END.search(text[-6:]):
            prose += n
        texts.append(text)
    return prose / total if total else 1.0, total, _WORD.findall(_MARK.join(texts).lower())


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``PAGES`` of every page: its shape and its words as numbers. ``page`` is a number of the words, so that a text under several keys is one page."""
    seen: dict[str, int] = {}
    for batch in batches:
        rows = []
        for number, row, page in zip(batch["id"], batch["row"], batch["page"]):
            if (mended := repair(page)) is not None:
                page = mended[1]
            prose, weight, tokens = page_shape(page)
            h = _hashes(tokens, seen)
            rows.append((number, row, xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63), round(prose * 1000) / 1000, round(weight), np.count_nonzero((h[:-1] != 0) & (h[1:] != 0)), h.view(np.int64)))
        yield pd.DataFrame(rows, columns=["id", "row", "page", "prose", "weight", "pairs", "words"])


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The words of about ``FLUSH`` words of pages at once, a mark after each page."""
    mark, words, n = np.zeros(1, np.uint64), [], 0
    for batch in batches:
        for w in batch["words"]:
            words += (w.view(np.uint64), mark)
            n += len(w)
            if n >= FLUSH:
                yield np.concatenate(words)
                words, n = [], 0
    if words:
        yield np.concatenate(words)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for h in _parts(batches):
        k, n = np.unique(h[h != 0], return_counts=True)
        yield pd.DataFrame({"word": k.view(np.int64), "n": n})


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for h in _parts(batches):
        pairs, at = _pairs(h)
        k, first, n = np.unique(pairs, return_index=True, return_counts=True)
        at = at[first]
        yield pd.DataFrame({"pair": k.view(np.int64), "n": n, "a": h[at].view(np.int64), "b": h[at + 1].view(np.int64)})


def _page_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every page its distinct pairs, how often it has each, and how often each of the two words."""
    for batch in batches:
        own, ns, oxs, oys, sizes = [], [], [], [], []
        for w in batch["words"]:
            h = w.view(np.uint64)
            pairs, at = _pairs(h)
            k, first, n = np.unique(pairs, return_index=True, return_counts=True)
            _, code, of = np.unique(h, return_inverse=True, return_counts=True)
            of, at = of[code], at[first]
            own.append(k.view(np.int64))
            ns.append(n)
            oxs.append(of[at])
            oys.append(of[at + 1])
            sizes.append(len(k))
        if sizes:
            whole = {"page": np.repeat(batch["page"].to_numpy(), sizes), "copies": np.repeat(batch["copies"].to_numpy(), sizes)}
            yield pd.DataFrame({"pair": np.concatenate(own), **whole, "n": np.concatenate(ns), "ox": np.concatenate(oxs), "oy": np.concatenate(oys)})


def _pages(crawl: DataFrame, processed: DataFrame | None) -> DataFrame:
    """row_key, page: the pages of the crawl, and the processed texts of keys that have no page there."""
    pages = crawl.where("row_key is not null and page is not null").select("row_key", "page")
    if processed is None:
        return pages
    texts = processed.where("row_key is not null and text is not null")
    bare = texts.select("row_key").distinct().join(pages.select("row_key"), "row_key", "left_anti")
    n = bare.count()  # keys alone
    return pages.unionByName(texts.select("row_key", F.col("text").alias("page")).join(F.broadcast(bare) if n <= BROADCAST_KEYS else bare, "row_key", "left_semi")) if n else pages


def page_coherence(crawl: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """row_key, prose, weight, pairs, unsupported, recurring, repeated, mean_pmi of every page with two neighbouring words; of keys that have no page, of their text in ``processed``.

    unsupported: share of the page's neighbouring pairs that no page of another text has. recurring: share in pairs that the page has three times or more; repeated:
    in those of them with a PMI of 2 bits or more. mean_pmi: over all its pairs, by the counts of the other texts, ``SMOOTH`` added to what is seen and to what is expected: about 0
    where words meet by chance. Null and empty pages have no row; repeated rows count once.
    """
    pages = _pages(crawl, processed).select(F.monotonically_increasing_id().alias("id"), F.xxhash64("row_key").alias("row"), "page")
    pages = stored(map_texts(pages, _words, PAGES)).where("pairs > 0 or size(words) > 0")
    words, scored = pages.select("words"), pages.where("pairs > 0")
    size = float(scored.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] or 1)
    counts = map_texts(words, _count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("total"))
    corpus = (
        map_texts(words, _count_pairs, "pair bigint, n bigint, a bigint, b bigint")
        .groupBy("pair")
        .agg(F.sum("n").alias("together"), F.max("a").alias("a"), F.max("b").alias("b"))
        .join(counts.select(F.col("word").alias("a"), F.col("total").alias("x")), "a")
        .join(counts.select(F.col("word").alias("b"), F.col("total").alias("y")), "b")
        .select("pair", "together", "x", "y")
    )
    several = scored.groupBy("page").agg(F.count(F.lit(1)).cast("int").alias("copies"), F.min("id").alias("one")).where("copies > 1")
    texts = scored.select("id", "page", "words").join(F.broadcast(several) if several.count() <= BROADCAST_KEYS else several, "page", "left").where("one is null or one = id")
    n, copies = F.col("n"), F.col("copies")
    others, expected = F.col("together") - n * copies, (F.col("x") - F.col("ox") * copies) * (F.col("y") - F.col("oy") * copies) / size
    sums = (
        map_texts(texts.select("page", F.coalesce("copies", F.lit(1)).alias("copies"), "words"), _page_pairs, "pair bigint, page bigint, copies int, n int, ox int, oy int")
        .join(corpus.hint("shuffle_hash"), "pair")
        .withColumn("pmi", F.log2("together") + math.log2(size) - F.log2("x") - F.log2("y"))
        .groupBy("page")
        .agg(
            F.sum(F.when(others <= 0, n).otherwise(0)).alias("unsupported"),
            F.sum(F.when(n >= 3, n).otherwise(0)).alias("recurring"),
            F.sum(F.when((n >= 3) & (F.col("pmi") >= 2), n).otherwise(0)).alias("repeated"),
            F.sum(n * F.log2((others + SMOOTH) / (expected + SMOOTH))).alias("bits"),
        )
    )
    share = lambda c: (F.col(c) / F.col("pairs")).alias({"bits": "mean_pmi"}.get(c, c))
    scores = scored.select("page", "row", "prose", "weight", "pairs").distinct().join(sums, "page").select(F.col("row").alias("page"), "prose", "weight", "pairs", share("unsupported"), share("recurring"), share("repeated"), share("bits"))
    keys = crawl.select("row_key") if processed is None else crawl.select("row_key").unionByName(processed.select("row_key"))
    return keys.where("row_key is not null").distinct().withColumn("page", F.xxhash64("row_key")).join(scores, "page").drop("page")


def stuffed_pages(crawl: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """The rows of ``page_coherence`` that are stuffed.

    A page's mean PMI is taken relative to the median of the pages that ``MIXED`` prose with other matter or repeat themselves; ``DOUBT`` pairs of that median are added to every
    page, since few pairs prove little. What is left when the share of repeated pairs is taken off decides. Incoherent pages without prose, or with little, are stuffed; pages that are coherent word by word, with no
    prose, if they repeat themselves; and pages of any shape that are incoherent and hardly anything but repetition.
    """
    c = page_coherence(crawl, processed)
    median = lambda pages: F.percentile_approx(F.when(pages, F.col("mean_pmi")), 0.5, 1000)
    prose = F.col("prose") >= MIXED[0]
    usual = c.select(F.coalesce(median(prose & ((F.col("prose") < MIXED[1]) | (F.col("recurring") >= MIXED[2]))), median(prose), median(F.lit(True))).alias("usual"))
    n, r, p = F.col("pairs"), F.col("repeated"), F.col("prose")
    relative = (n * F.col("mean_pmi") / F.greatest("usual", F.lit(0.5)) + DOUBT) / (n + DOUBT)
    left = relative - r * n / (n + DOUBT)
    stuffed = ((p < 0.15) & (left < 0.86)) | ((p < 0.4) & (relative < 0.82)) | ((p < 0.5) & (left < 0.7)) | ((relative < 0.82) & (left < 0.4))
    return c.crossJoin(F.broadcast(usual)).where(stuffed).drop("usual")  # one row
