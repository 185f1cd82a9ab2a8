"""Ranked keyword, phrase, image, document and place search over the long indexes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import query_counts, query_terms, sigmoid
from millrace.operators.lookups import diverse_top, drop_then_best, with_rank
from millrace.plans.index import StoredIndex, StoredPages
from millrace.session import cut

#: Weights of the final version: term frequencies, rank, title, phrase.
WEIGHTS = {"tfidf": 1.0, "rank": 0.5, "title": 2.0, "phrase": 20.0}
#: Weights of the earlier versions; the second is the first with paging, the fourth picks its candidates by domain, the fifth has no phrase score.
VERSIONS = {
    1: {"tfidf": 0.4, "rank": 0.1, "title": 0.2, "phrase": 0.3},
    2: {"tfidf": 0.4, "rank": 0.1, "title": 0.2, "phrase": 0.3},
    4: {"tfidf": 0.4, "rank": 0.14, "title": 0.16, "phrase": 0.3},
    5: {"tfidf": 0.4, "rank": 0.14, "title": 0.16},
    6: WEIGHTS,
}
SPAN_LIMIT = 20
#: Up to this many candidates travel as a broadcast list of keys.
BROADCAST_CANDIDATES = 10_000


def of_words(index: DataFrame | StoredIndex, words: list[str]) -> DataFrame:
    """The rows of the words: from a stored index its buckets of them, else by a filter."""
    return index.postings(words) if isinstance(index, StoredIndex) else index.where(F.col("word").isin(words))


def keyword(postings: DataFrame | StoredIndex, word: str) -> DataFrame:
    """doc, positions of one word."""
    return of_words(postings, [word.lower()]).select("doc", "positions")


def positions_of(postings: DataFrame | StoredIndex, words: list[str]) -> DataFrame:
    """doc, lists: for every document with any of the words a map of word to positions."""
    return of_words(postings, words).groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "positions")))).alias("lists"))


def having_all(postings: DataFrame | StoredIndex, words: list[str], present_only: bool = True) -> DataFrame:
    """Documents with all words. Words that no document has are ignored if ``present_only``, else they leave nothing."""
    hits = of_words(postings, words).select("word", "doc").distinct()
    need = hits.agg(F.count_distinct("word")).scalar() if present_only else F.lit(len(set(words)))
    return hits.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == need).select("doc")


def having_any(postings: DataFrame | StoredIndex, words: list[str]) -> DataFrame:
    """Documents with any of the words and how many of them."""
    return of_words(postings, words).select("word", "doc").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("matches"))


def query_weights(postings: DataFrame | StoredIndex, words: list[str], total: float | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """word, q = log10(N / df) of the query's words, times how often each stands in the query where ``counts`` are given."""
    if total is None and isinstance(postings, StoredIndex):
        total = postings.documents
    n = F.lit(float(total)) if total is not None else postings.agg(F.count_distinct("doc").cast("double")).scalar()
    df = of_words(postings, words).groupBy("word").agg(F.count_distinct("doc").alias("_df"))
    times = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("word")] if counts else F.lit(1)
    return df.select("word", (F.log10(n / F.col("_df")) * F.coalesce(times, F.lit(1))).alias("q"))


def tfidf_scores(postings: DataFrame | StoredIndex, words: list[str], total: float | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """doc, tfidf: the sum of query weight times doc_tf over shared words."""
    own = of_words(postings, words)
    if not isinstance(postings, StoredIndex):
        total = postings.agg(F.count_distinct("doc")).first()[0] if total is None else total
        own = cut(own)  # read twice
    q = query_weights(postings if isinstance(postings, StoredIndex) else own, words, total, counts)
    return own.join(F.broadcast(q), "word").groupBy("doc").agg(F.sum(F.col("q") * F.col("doc_tf")).alias("tfidf"))  # a row for each word of the query


def cosine_scores(postings: DataFrame | StoredIndex, freqs: DataFrame, words: list[str], total: float | None = None) -> DataFrame:
    """doc, cosine of the query's weights and the documents' normalised frequencies, over the words of the query. freqs: word, doc, freq."""
    q = query_weights(postings, words, total)
    weights = normalized_tf(freqs, words).join(F.broadcast(q), "word")  # a row for each word of the query
    length = F.sqrt(q.agg(F.sum(F.col("q") * F.col("q"))).scalar())
    return weights.groupBy("doc").agg((F.sum(F.col("q") * F.col("weight")) / F.first(length)).alias("cosine"))


def normalized_tf(freqs: DataFrame, words: list[str]) -> DataFrame:
    """word, doc, weight: frequencies of the query's words, scaled to length 1 in each document."""
    own = freqs.where(F.col("word").isin(words))
    length = own.groupBy("doc").agg(F.sqrt(F.sum(F.col("freq") * F.col("freq"))).alias("_l"))
    return own.join(length, "doc").select("word", "doc", (F.col("freq") / F.col("_l")).alias("weight"))


def title_match(title: Column, description: Column, words: list[str]) -> Column:
    """The share of the distinct words of title and description that are in the query."""
    own = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", title, description)), r"[^a-z0-9]+"), lambda w: w != ""))
    hits = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in words])))
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(hits / F.size(own))


def closest(lists: list[list[int]], tolerance: int = 0, span_limit: int = SPAN_LIMIT) -> list[int]:
    """One position of each word, in the order of the lists, with the least distance between the first and the last; empty if that is above the limit."""
    if not lists or any(not len(x) for x in lists):
        return []
    at = [0] * len(lists)
    best, size = None, None
    while True:
        now = [x[i] for x, i in zip(lists, at)]
        low = min(range(len(now)), key=now.__getitem__)
        span = max(now) - now[low]
        if size is None or span < size:
            best, size = now, span
            if size <= tolerance:
                break
        at[low] += 1
        if at[low] >= len(lists[low]):
            break
    return list(best) if size <= span_limit else []


def phrase_score(positions: list[int], compat: bool = False) -> float:
    """0.7 / (span + 1) + 0.3 / (inversions + 1); 0 without positions. With ``compat``, span and order as in a heap whose least entry went last."""
    if not positions:
        return 0.0
    if compat:
        rest = sorted(positions)
        order = [*rest[1:], rest[0]]
        span = order[0] - min(order) + 1
        inversions = sum(a > b for a, b in pairwise(order))
    else:
        span = max(positions) - min(positions) + 1
        inversions = sum(a > b for a, b in pairwise(positions))
    return 0.7 / (span + 1) + 0.3 / (inversions + 1)


def phrase_scores(postings: DataFrame | StoredIndex, words: list[str], tolerance: int | None = None, span_limit: int = SPAN_LIMIT, compat: bool = False) -> DataFrame:
    """doc, best (a position of each word), span, phrase, for documents that have all words close enough."""
    tol = len(words) + 10 if tolerance is None else tolerance

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [closest([list(m[w]) if w in m else [] for w in words], tol, span_limit) for m in map(dict, batch["lists"])]
            spans = [max(b) - min(b) + 1 if b else 0 for b in best]
            yield pd.DataFrame({"doc": batch["doc"], "best": best, "span": spans, "phrase": [phrase_score(b, compat) for b in best]})

    kind = dict((postings.all() if isinstance(postings, StoredIndex) else postings).dtypes)["doc"]
    return positions_of(postings, words).mapInPandas(run, f"doc {kind}, best array<int>, span int, phrase double").where("size(best) > 0")


def two_word_span(postings: DataFrame | StoredIndex, first: str, second: str) -> DataFrame:
    """doc, gap: the least distance between two words, without Python."""
    a = of_words(postings, [first]).select("doc", F.explode("positions").alias("p"))
    b = of_words(postings, [second]).select("doc", F.explode("positions").alias("q"))
    return a.join(b, "doc").groupBy("doc").agg(F.min(F.abs(F.col("p") - F.col("q"))).alias("gap"))


def combined(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The mean of the scores' sigmoids by weight."""
    w = weights or WEIGHTS
    total = sum(w[k] for k in scores)
    out = F.lit(0.0)
    for k in sorted(scores):
        out = out + (w[k] / total) * sigmoid(scores[k])
    return out


def snippet(text: Column, positions: Column, length: int = 60) -> Column:
    """``length`` words around the first position, words whose first occurrence is a position in bold; the first words where there is no position."""
    words = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    start = F.when(F.size(positions) > 0, F.greatest(F.lit(0), F.element_at(positions, 1) - length // 2)).otherwise(F.lit(0))
    part = F.slice(words, start + 1, F.lit(length))
    mark = lambda w: F.when(F.array_contains(positions, (F.array_position(words, w) - 1).cast("int")), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)
    return F.array_join(F.transform(part, mark), " ")


def _heads(pages: DataFrame) -> DataFrame:
    """One title, description and url for each document."""
    return pages.groupBy("doc").agg(F.max(F.struct("title", "description", "url")).alias("_d")).select("doc", "_d.title", "_d.description", "_d.url")


def search(
    query: str,
    index: DataFrame | StoredIndex,
    pages: DataFrame | StoredPages,
    ranks: DataFrame,
    weights: dict[str, float] | None = None,
    offset: int = 0,
    limit: int = 10,
    drop: int | None = 300,
    candidates: int = 200,
    total: float | None = None,
    phrase: bool = True,
    diverse: bool = False,
    stop_words: frozenset[str] = frozenset(),
    lemmas: dict[str, str] | None = None,
    query_tf: bool = False,
    tolerance: int | None = None,
) -> DataFrame:
    """The ranked page of results: doc, score, tfidf, rank, title_score, phrase, title, url, snippet.

    index: word, doc, positions, doc_tf; pages: doc, title, url, description, text; ranks: url_hash, rank. The candidates are cut by rank before anything is scored; postings and
    titles are read for them alone, texts for the page of results alone (``limit`` rows). With ``diverse`` the candidates are at most two pages of a domain, not the best by rank alone.
    ``drop`` cuts the candidates by a hash before the best are taken; none keeps all. With ``query_tf`` a word weighs as often as it stands in the query. From a stored index and stored
    pages nothing is read but the buckets of the words and of the results.
    """
    words = query_terms(query, stop_words, lemmas)
    counts = query_counts(query, stop_words=stop_words, lemmas=lemmas) if query_tf else None
    stored = pages if isinstance(pages, StoredPages) else None
    pages = stored.all() if stored else pages
    w = {k: v for k, v in (weights or WEIGHTS).items() if phrase or k != "phrase"}
    if total is None:
        total = index.documents if isinstance(index, StoredIndex) else index.agg(F.count_distinct("doc")).first()[0]
    own = cut(of_words(index, words))  # read several times, and only the postings of the query's words
    ranked = with_rank(having_all(own, words).select(F.col("doc").alias("url_hash")), ranks)
    if diverse:
        named = ranked.withColumnRenamed("url_hash", "doc").join(_heads(pages).select("doc", "url"), "doc").where("url is not null")
        best = diverse_top(named, 2, candidates).select("doc", "rank")
    else:
        best = drop_then_best(ranked, drop, candidates).select(F.col("url_hash").alias("doc"), "rank")
    best = cut(best)
    among = lambda rows, few: rows.join(F.broadcast(few.select("doc")) if candidates <= BROADCAST_CANDIDATES else few.select("doc"), "doc", "left_semi")
    tf = among(own, best).join(F.broadcast(query_weights(own, words, total, counts)), "word").groupBy("doc").agg(F.sum(F.col("q") * F.col("doc_tf")).alias("tfidf"))  # a row for each word of the query
    rows = best.join(tf, "doc").join(_heads(among(pages, best)), "doc", "left").withColumn("title_score", title_match(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), words))
    scores = {"tfidf": F.col("tfidf"), "rank": F.col("rank"), "title": F.col("title_score")}
    if phrase:
        rows = rows.join(phrase_scores(among(own, best), words, tolerance).select("doc", "best", "phrase"), "doc", "left").withColumns({"phrase": F.coalesce("phrase", F.lit(0.0)), "best": F.coalesce("best", F.array().cast("array<int>"))})
        scores["phrase"] = F.col("phrase")
    else:
        rows = rows.withColumns({"phrase": F.lit(0.0), "best": F.array().cast("array<int>")})
    top = cut(rows.withColumn("score", combined(scores, w)).orderBy(F.desc("score"), "doc").offset(offset).limit(limit))
    few = stored.of([r["doc"] for r in top.select("doc").collect()]) if stored else pages.join(F.broadcast(top.select("doc")), "doc", "left_semi")  # at most limit rows
    texts = few.groupBy("doc").agg(F.max("text").alias("text"))
    done = top.join(texts, "doc", "left")
    return done.select("doc", "score", "tfidf", "rank", "title_score", "phrase", "title", "url", snippet(F.coalesce("text", F.lit("")), F.col("best")).alias("snippet")).orderBy(F.desc("score"), "doc")


class ResultCache:
    """Ranked results of recent queries on the driver, by their analysed words in order, so that paging asks Spark once.

    At most ``most`` results of each query and ``queries`` queries are kept, the least recently used go first. A page that begins past the last result is the first page.
    """

    def __init__(self, run: Callable[[str], DataFrame], most: int = 200, queries: int = 1_000, stop_words: frozenset[str] = frozenset(), lemmas: dict[str, str] | None = None):
        self.run, self.most, self.queries, self.stop_words, self.lemmas = run, most, queries, stop_words, lemmas
        self.kept: OrderedDict[str, list] = OrderedDict()

    def page(self, query: str, offset: int = 0, limit: int = 10) -> list:
        key = " ".join(query_terms(query, self.stop_words, self.lemmas))
        if key not in self.kept:
            self.kept[key] = self.run(query).limit(self.most).collect()  # a ranked page of at most ``most`` results
            if len(self.kept) > self.queries:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        rows = self.kept[key]
        offset = 0 if offset >= len(rows) else offset
        return rows[offset : offset + limit]


def place_band(difference: Column) -> Column:
    """The nearness of two ZIP numbers."""
    d = F.abs(difference)
    return F.when(d == 0, 1.0).when(d < 100, 0.8).when(d < 500, 0.6).when(d < 1000, 0.4).when(d < 2000, 0.2).otherwise(0.1)


def place_search(index: DataFrame | StoredIndex, places: DataFrame, words: list[str], zip_code: int, tolerance: int | None = None) -> DataFrame:
    """doc, score, best: documents with all words, twice the nearness of their place plus their phrase score, and where the phrase stands."""
    near = having_all(index, words).join(places.select(F.col("row_key").alias("doc"), "zip"), "doc").groupBy("doc").agg(F.max(2 * place_band(F.col("zip").cast("int") - zip_code)).alias("_near"))
    phrases = phrase_scores(index, words, tolerance).select("doc", "best", "phrase")
    return near.join(phrases, "doc", "left").select("doc", (F.col("_near") + F.coalesce("phrase", F.lit(0.0))).alias("score"), F.coalesce("best", F.array().cast("array<int>")).alias("best"))


def images_of_word(images: DataFrame, word: str) -> DataFrame:
    """doc, images of one word: the sources joined by line feeds, in order of the documents."""
    return images.where(F.col("word") == word.lower()).select("doc", "images").orderBy("doc")


def image_search(images: DataFrame, words: list[str], all_words: bool = True) -> DataFrame:
    """doc, hits: documents whose images match all words (a missing word leaves nothing), with the number of distinct images; or any, with the number of words."""
    if not all_words:
        return having_any(images, words[:8]).withColumnRenamed("matches", "hits")
    docs = having_all(images, words, present_only=False)
    own = images.where(F.col("word").isin(words)).join(docs, "doc", "left_semi")
    return own.select("doc", F.explode(F.split("images", "\n")).alias("i")).groupBy("doc").agg(F.count_distinct("i").alias("hits"))


def document_search(index: DataFrame | StoredIndex, details: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    """Details of the first documents by key that have all words that occur at all."""
    return having_all(index, words).join(details, "doc").orderBy("doc").limit(limit)
