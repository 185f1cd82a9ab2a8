"""The engine's operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions.lexicon import lemmatized
from millrace.operators import bag as B
from millrace.operators import kv as K
from millrace.operators import lookups as L
from millrace.operators import pairs as P
from millrace.plans import crawl as C
from millrace.plans import index as I
from millrace.plans import links as G
from millrace.plans import rank as R
from millrace.plans import search as S
from millrace.plans import suggest as Q
from millrace.sources import fetch as X
from millrace.session import stored_folder
from millrace.sources.html import main_text, visible_text

REGISTRY: dict = {}

# Fixed values of the queries: what the oracle SQL repeats.
WORDS = ("library", "harbour")
QUERY = "Library-harbour"
BLACKLIST = ("*pelucott*", "https://www.*.test*")
LINES = r"[\n\r]+"


def query(f):
    REGISTRY[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def words_array(text: str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def lang(code: str) -> Column:
    return F.lower(F.substring("lang", 1, 2)) == code


def docs_bag(spark, d, code=None):
    x = t(spark, d, "documents").where("text is not null")
    x = x if code is None else x.where(lang(code))
    return x.select(F.explode(words_array("text")).alias("value"))


# Bags


@query
def bag_from_table(spark, d):
    return B.from_table(t(spark, d, "pt_processed"), F.col("title"))


@query
def bag_flatmap_tokens(spark, d):
    return B.flat_map(t(spark, d, "documents").select(F.col("text").alias("value")), words_array("value"))


@query
def bag_distinct(spark, d):
    return B.distinct(docs_bag(spark, d))


@query
def bag_union(spark, d):
    return B.union(docs_bag(spark, d, "fr"), docs_bag(spark, d, "es"))


@query
def bag_intersection(spark, d):
    return B.intersection(docs_bag(spark, d, "en"), docs_bag(spark, d, "de"))


@query
def bag_filter_contains(spark, d):
    return B.containing(t(spark, d, "pt_processed").select(F.col("text").alias("value")), "harbour")


@query
def bag_filter_even(spark, d):
    return B.matching(t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("value")), F.col("value").cast("bigint") % 2 == 0)


@query
def bag_count(spark, d):
    return docs_bag(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query
def bag_take(spark, d):
    """Which 25 is open, how many is not."""
    return B.take(docs_bag(spark, d), 25).agg(F.count(F.lit(1)).alias("n"))


@query
def bag_sample(spark, d):
    """Which elements is open, their share is not."""
    bag = docs_bag(spark, d)
    return B.sample(bag, 0.25, 7).agg((F.abs(F.count(F.lit(1)) / bag.agg(F.count(F.lit(1))).scalar() - 0.25) < 0.02).alias("as_asked"))


@query
def bag_map_partitions(spark, d):
    """Adds five to every key, by iterator."""
    return B.map_partitions(t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("value")), lambda it: (str(int(v) + 5) for v in it))


@query
def bag_groupby_first(spark, d):
    """The vocabulary by first letters."""
    return B.group_by(B.distinct(docs_bag(spark, d)), F.substring("value", 1, 1))


@query
def bag_fold_sum(spark, d):
    return B.fold(t(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").alias("value")), F.sum("value").alias("total"))


# Pairs


def event_pairs(spark, d, kind: str):
    e = t(spark, d, "events").where(F.col("event_type") == kind)
    return B.map_to_pair(e.select(F.col("user_id"), F.col("event_id")), F.col("user_id"), F.col("event_id"))


@query
def pair_map_to_pair(spark, d):
    return B.map_to_pair(t(spark, d, "part").select(F.col("p_name").alias("value")), F.substring("value", 1, 1), F.col("value"))


@query
def pair_foldbykey_sum(spark, d):
    return P.fold_by_key(t(spark, d, "events").select(F.col("event_type").alias("key"), F.col("value").cast("decimal(18,4)").alias("value")), F.sum("value").cast("double"), "total")


@query
def pair_foldbykey_ordered(spark, d):
    """A fold whose result depends on order: values joined by dashes, sorted."""
    p = t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    return P.fold_by_key_ordered(p, F.lit(""), lambda acc, v: F.concat(acc, F.lit("-"), v))


@query
def pair_wordcount(spark, d):
    return docs_bag(spark, d).groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query
def pair_groupby_values(spark, d):
    return P.grouped_values(event_pairs(spark, d, "purchase"))


@query
def pair_join(spark, d):
    left = t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    return P.join(left, t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value")))


@query
def pair_join_many(spark, d):
    """k x m combinations for each key."""
    return P.join(event_pairs(spark, d, "purchase"), event_pairs(spark, d, "error"))


@query
def pair_cogroup(spark, d):
    return P.cogroup(event_pairs(spark, d, "purchase"), event_pairs(spark, d, "error"))


@query
def pair_intersection(spark, d):
    return P.intersection(t(spark, d, "pt_outgoing").select(F.col("row_key").alias("key"), F.col("col").alias("value")), t(spark, d, "pt_outgoing").select(F.col("col").alias("key"), F.col("row_key").alias("value")))


@query
def pair_flatmap(spark, d):
    p = t(spark, d, "pt_processed").where("url is not null").select(F.col("row_key").alias("key"), F.col("title").alias("value"))
    return P.flat_map(p, words_array("value"))


@query
def bag_flatmap_to_pair(spark, d):
    """Each word of a text with its length, and its first letter with the word."""
    words = t(spark, d, "eval_items").select(F.explode(words_array("text")).alias("value"))
    pair = lambda k, v: F.struct(k.cast("string").alias("key"), v.cast("string").alias("value"))
    return B.flat_map_to_pair(words, F.array(pair(F.col("value"), F.length("value")), pair(F.substring("value", 1, 1), F.col("value"))))


@query
def pair_flatmap_to_pair(spark, d):
    """The words of every title as pairs with their page."""
    p = t(spark, d, "pt_processed").where("title is not null").select(F.col("row_key").alias("key"), F.col("title").alias("value"))
    return P.flat_map_to_pair(p, F.transform(words_array("value"), lambda w: F.struct(w.alias("key"), F.col("key").alias("value"))))


# Key-value tables


def cells(spark, d):
    e = t(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("row_key"), F.col("event_type").alias("col"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("version"))


@query
def kv_get_latest(spark, d):
    return K.latest(cells(spark, d))


@query
def kv_get_version(spark, d):
    return K.get_row(cells(spark, d), "7", 5000)


@query
def kv_scan_range(spark, d):
    return K.scan(cells(spark, d), "20", "45")


@query
def kv_count(spark, d):
    return K.count_rows(cells(spark, d))


@query
def kv_put(spark, d):
    c = cells(spark, d)
    new = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("row_key"), F.lit("nation").alias("col"), F.col("n_name").alias("value"))
    return K.latest(K.put(c, new))


def nation_cells(spark, d):
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("row_key"), F.lit("nation").alias("col"), F.col("n_name").alias("value"))


@query
def kv_put_where(spark, d):
    """Written only to the rows whose latest click is the event 5000 or whose value of the column is another."""
    c = cells(spark, d)
    kind = K.latest(c).where("row_key = '7'").agg(F.max(F.struct("col", "value")).alias("m")).first()["m"]
    return K.latest(K.put_where(c, nation_cells(spark, d), kind["col"], kind["value"]))


@query
def kv_put_rows(spark, d):
    return K.latest(K.put_rows(cells(spark, d), nation_cells(spark, d)))


@query
def kv_get_cell(spark, d):
    return K.get(cells(spark, d), "7", "click")


@query
def kv_view_page(spark, d):
    page = K.view(cells(spark, d), "3", 10)
    return page.select("row_key", F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("cells"), "next_key")


@query
def kv_diff(spark, d):
    c = cells(spark, d)
    return K.differing_rows(c, c.where("col <> 'error' or version % 2 = 0"))


@query
def kv_sample_prefix3(spark, d):
    return K.sampled_by_prefix(t(spark, d, "pt_crawl"), 3, 3)


# Text


@query
def text_clean(spark, d):
    x = t(spark, d, "pt_processed").select("row_key", "title").where("title is not null").distinct()
    c = F.col("title")
    return x.select(
        "row_key", "title", T.clean_words(c).alias("words"), T.clean_word(c).alias("word"), T.before_punctuation(c).alias("head"), T.first_number(c).alias("number"), T.sanitized(c).alias("safe"), F.initcap(F.lower("title")).alias("cased")
    ).drop("cased")


@query
def text_title_case(spark, d):
    return t(spark, d, "part").select("p_partkey", T.title_case(F.col("p_name")).alias("name"))


@query
def text_strip_html(spark, d):
    x = t(spark, d, "pt_crawl").where("page is not null").select("row_key", "page").distinct()
    return x.select("row_key", T.page_letters(F.col("page")).alias("letters"), F.array_join(T.page_words(F.col("page")), " ").alias("words"))


@query
def text_metadata(spark, d):
    x = t(spark, d, "pt_crawl").where("page is not null").select("row_key", "url", "page").distinct()
    p = F.col("page")
    return x.select("row_key", T.page_title(p).alias("title"), T.page_description(p).alias("description"), T.page_icon(p, F.col("url")).alias("icon"), T.page_language(p).alias("language"), T.page_keywords(p).alias("keywords"))


@query
def text_body_letters(spark, d):
    x = t(spark, d, "pt_crawl").where("page is not null").select("row_key", "page").distinct()
    return x.select("row_key", T.body_letters(F.col("page")).alias("body"), T.paragraph_letters(F.col("page")).alias("paragraphs"))


@query
def text_visible(spark, d):
    x = t(spark, d, "pt_crawl").where("page is not null").select("row_key", "page").distinct()
    return x.select("row_key", visible_text(F.col("page")).alias("text"), main_text(F.col("page")).alias("main"))


@query
def text_english_pages(spark, d):
    x = t(spark, d, "pt_crawl").where("page is not null")
    return x.where(T.is_english(F.col("page"), F.lit(None).cast("string"))).select("row_key").distinct()


@query
def text_images(spark, d):
    return I.images_of(t(spark, d, "pt_crawl"))


@query
def text_valid_words(spark, d):
    return B.distinct(docs_bag(spark, d)).where(T.valid_word(F.col("value")))


@query
def text_images_html(spark, d):
    sources = I.images_of(t(spark, d, "pt_crawl")).groupBy("row_key").agg(F.array_sort(F.collect_set("src")).alias("s"))
    return sources.select("row_key", T.images_html(F.col("s")).alias("html"))


@query
def text_places(spark, d):
    x = t(spark, d, "pt_processed").where("text is not null").select("row_key", "text").distinct()
    return x.select("row_key", F.array_join(T.named_places(F.col("text"), ["Library", "Museum", "Storage"]), ",").alias("places")).where("places <> ''")


@query
def text_file_titles(spark, d):
    """What the pages would be called as files, without their titles."""
    x = t(spark, d, "pt_crawl").select("url", "contenttype").distinct()
    return x.select("url", "contenttype", T.file_type(F.col("contenttype")).alias("type"), T.file_title(F.lit(None).cast("string"), F.col("url"), F.col("contenttype")).alias("name"))


@query
def text_scores(spark, d):
    c = t(spark, d, "customer")
    both = c.agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    return c.join(F.broadcast(both)).select("c_custkey", F.round(T.sigmoid(F.col("c_acctbal") / 1000), 6).alias("sig"), F.round(T.min_max(F.col("c_acctbal"), F.col("low"), F.col("high")), 6).alias("scaled"))  # one row


# Urls


@query
def url_hash(spark, d):
    return t(spark, d, "pt_crawl").select("url").distinct().select("url", U.url_hash(F.col("url")).alias("hash"))


@query
def url_parts(spark, d):
    u = F.col("url")
    p = U.url_parts(u)
    return t(spark, d, "pt_crawl").select("url").distinct().select(
        "url", U.host_of(u).alias("host"), U.top_domain(u).alias("domain"), U.root_url(u).alias("root"), p["protocol"].alias("protocol"), p["port"].alias("port"), p["path"].alias("path"), U.crawlable(u).alias("crawlable"), U.unwanted_link(u).alias("unwanted")
    )


@query
def url_normalize_links(spark, d):
    return G.links_of(t(spark, d, "pt_crawl"))


@query
def url_listed_links(spark, d):
    return G.wanted_links(G.listed_links(t(spark, d, "pt_processed")))


@query
def url_site_counts(spark, d):
    return G.site_counts(t(spark, d, "pt_crawl"))


@query
def url_depth(spark, d):
    u = F.col("url")
    return t(spark, d, "pt_crawl").select("url").distinct().select("url", F.round(U.depth_drop_share(u), 6).alias("share"))


@query
def url_drop_shares(spark, d):
    u = F.col("url")
    return t(spark, d, "pt_crawl").select("url").distinct().select("url", U.domain_drop_share(u).alias("share"), U.random_looking(u).alias("random"))


@query
def url_blacklist(spark, d):
    patterns = spark.createDataFrame([(p,) for p in BLACKLIST], "pattern string")
    return L.without_blacklisted(t(spark, d, "pt_crawl").select("url").distinct(), patterns)


@query
def url_robots_rules(spark, d):
    return X.host_rules(t(spark, d, "pt_hosts"))


@query
def url_robots_allowed(spark, d):
    rules = X.host_rules(t(spark, d, "pt_hosts").where("host is not null"), "host")
    """Addresses that the hosts' robots files allow."""
    u = F.col("url")
    urls = t(spark, d, "pt_crawl").select("url").distinct().select("url", F.lower(F.regexp_extract(u, r"^[a-z]+://([^/:]+)", 1)).alias("key"), U.url_parts(u)["path"].alias("path"))
    return X.allowed_paths(urls, rules, "millrace").select("url")


# Indexes


def corpus(spark, d):
    return t(spark, d, "documents").select("doc_id", "text")


def tokens(spark, d):
    return I.tokens_by_space(corpus(spark, d), "doc_id", "text")


def tokens_together(spark, d):
    return I.tokens_by_space(corpus(spark, d), "doc_id", "text", together=True)


@query
def idx_positions(spark, d):
    return I.postings(tokens_together(spark, d)).select("word", "doc", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


@query
def idx_posting_lists(spark, d):
    """The one-string form."""
    return I.posting_lists(tokens(spark, d))


@query
def idx_posting_parts(spark, d):
    """The form in parts: how many a word has, and its documents in all of them."""
    parts = I.posting_lists(tokens(spark, d), 100)
    return parts.groupBy("word").agg((F.max("part") + 1).alias("parts"), F.sum(F.size(F.split("postings", ","))).alias("docs"))


@query
def idx_word_documents(spark, d):
    """The documents of each word, once for each occurrence."""
    return I.document_word_lists(tokens(spark, d), 1 << 40)


@query
def idx_page_words(spark, d):
    x = t(spark, d, "pt_crawl").where("page is not null").select("row_key", "page").distinct()
    return I.frequencies(I.tokens_of(x, "row_key", T.page_words(F.col("page"))))


@query
def idx_freq_first(spark, d):
    return I.frequencies(tokens_together(spark, d))


@query
def idx_stemmed(spark, d):
    return I.frequencies(I.with_stems(tokens(spark, d)))


@query
def idx_augmented_tf(spark, d):
    i = I.served_index(tokens_together(spark, d))
    return i.select("word", "doc", "tf", F.round("doc_tf", 6).alias("doc_tf"), F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("positions"))


@query
def idx_served(spark, d):
    """The stored index of the processed pages, as searches read it; their stored pages are written with it."""
    page_details(spark, d)
    return served(spark, d).all().select("word", "doc", "tf", F.round("doc_tf", 6).alias("doc_tf"))


@query
def idx_df_idf(spark, d):
    x = I.document_frequencies(tokens(spark, d))
    return x.select("word", "df", F.round("idf", 6).alias("idf"))


@query
def idx_doclist(spark, d):
    return I.document_lists(tokens(spark, d))


@query
def idx_lemmatized(spark, d):
    """Words of a dictionary (all words of two documents or more) without the stop words."""
    tk = tokens(spark, d)
    dictionary = tk.groupBy("word").agg(F.count_distinct("doc").alias("n")).where("n >= 2").select("word")
    stops = spark.createDataFrame([("the",), ("of",), ("and",), ("a",)], "word string")
    lemmas = spark.createDataFrame([("libraries", "library"), ("records", "record")], "word string, lemma string")
    return I.document_lists(lemmatized(tk, dictionary, lemmas, stops))


@query
def idx_image(spark, d):
    images = t(spark, d, "part").select(F.col("p_partkey").alias("row_key"), F.concat(F.lit("/i/"), F.col("p_partkey") % 50, F.lit(".png")).alias("src"), F.lower("p_name").alias("alt"))
    return I.image_index(images)


@query
def idx_image_dictionary(spark, d):
    return I.image_dictionary(I.images_of(t(spark, d, "pt_crawl")))


@query
def idx_places(spark, d):
    places = t(spark, d, "pt_crawl").where("ip is not null").select("ip").distinct().withColumn("zip", F.lpad(F.regexp_extract("ip", r"([0-9]+)$", 1), 5, "1"))
    return I.place_index(t(spark, d, "pt_crawl"), places)


@query
def id_dictionary(spark, d):
    return I.id_dictionary(t(spark, d, "pt_crawl"), "row_key")


@query
def idx_top_pages(spark, d):
    tk = I.tokens_by_space(t(spark, d, "pt_processed").select("row_key", "title").distinct(), "row_key", "title")
    return I.top_pages(tk, t(spark, d, "pt_pgrk"), 20)


@query
def idx_processed_table(spark, d):
    """Pages that the processed table doesn't have yet."""
    return I.processed_table(t(spark, d, "pt_crawl"), t(spark, d, "pt_processed")).select("row_key", "url", "title", "description", "links")


@query
def page_canonical(spark, d):
    return L.first_of_content(t(spark, d, "pt_crawl"))


# Search


_STORES: dict = {}


def stored_once(spark, d: str, kind: str, write):
    """What ``write`` stores for a folder, once for each application; searches then read it."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _STORES:
        _STORES[key] = write(f"{stored_folder(spark)}-{kind}-{len(_STORES)}")
    return _STORES[key]


def served(spark, d) -> I.StoredIndex:
    """The stored index of the processed pages."""

    def write(path):
        pages = t(spark, d, "pt_processed").where("text is not null").groupBy("row_key").agg(F.max("text").alias("text"))
        return I.store_index(I.served_index(I.tokens_by_space(pages, "row_key", "text", together=True)), path)

    return stored_once(spark, d, "served", write)


def page_details(spark, d) -> I.StoredPages:
    rows = t(spark, d, "pt_processed").select(F.col("row_key").alias("doc"), "title", "url", "description", "text")
    return stored_once(spark, d, "pages", lambda path: I.store_pages(rows, path))


def plain_index(spark, d) -> I.StoredIndex:
    """The stored index of the documents."""
    return stored_once(spark, d, "plain", lambda path: I.store_index(I.served_index(tokens_together(spark, d)), path))


@query
def search_keyword(spark, d):
    return S.keyword(plain_index(spark, d), "Library").select("doc", F.size("positions").alias("hits"), F.element_at("positions", 1).alias("first"))


@query
def search_and(spark, d):
    return S.having_all(plain_index(spark, d), [*WORDS, "nosuchword"])


@query
def search_any(spark, d):
    return S.having_any(plain_index(spark, d), [*WORDS, "turbine"])


@query
def search_tfidf(spark, d):
    return S.tfidf_scores(plain_index(spark, d), list(WORDS)).select("doc", F.round("tfidf", 6).alias("tfidf"))


@query
def search_normalized_tf(spark, d):
    return S.normalized_tf(I.frequencies(tokens(spark, d)), list(WORDS)).select("word", "doc", F.round("weight", 6).alias("weight"))


@query
def search_title_match(spark, d):
    x = t(spark, d, "pt_processed").select("row_key", "title", "description").distinct()
    return x.select("row_key", "title", F.round(S.title_match(F.col("title"), F.col("description"), list(WORDS)), 6).alias("score"))


@query
def search_phrase_span(spark, d):
    """The least gap of two words, by joins alone."""
    return S.two_word_span(plain_index(spark, d), *WORDS)


@query
def search_phrase(spark, d):
    p = S.phrase_scores(plain_index(spark, d), list(WORDS), tolerance=0)
    return p.select("doc", "span", F.round("phrase", 6).alias("phrase"), F.array_join(F.transform("best", lambda x: x.cast("string")), " ").alias("best"))


@query
def search_phrase_compat(spark, d):
    return S.phrase_scores(plain_index(spark, d), [*WORDS, "and"], compat=True).select("doc", "span", F.round("phrase", 6).alias("phrase"))


@query
def search_snippet(spark, d):
    """Twelve words around the first place of a word, in bold; the first twelve where it is missing."""
    docs = t(spark, d, "pt_processed").where("text is not null").groupBy(F.col("row_key").alias("doc")).agg(F.max("text").alias("text"))
    at = docs.join(S.keyword(served(spark, d), WORDS[0]), "doc", "left").withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))
    return at.select("doc", S.snippet(F.col("text"), F.col("positions"), 12).alias("snippet"))


def shown(r: DataFrame) -> DataFrame:
    """A page of results with rounded scores."""
    return r.select("doc", *(F.round(c, 6).alias(c) for c in ("score", "tfidf", "rank", "title_score", "phrase")), "title", "url", "snippet")


@query
def search_v1(spark, d):
    """The first version: other weights, no cut of the candidates that matters here."""
    r = S.search(QUERY, served(spark, d), page_details(spark, d), t(spark, d, "pt_pgrk"), S.VERSIONS[1], drop=None, candidates=100_000)
    return shown(r)


@query
def search_combined(spark, d):
    """Top ten by term frequencies, rank and title."""
    r = S.search(QUERY, served(spark, d), page_details(spark, d), t(spark, d, "pt_pgrk"), drop=None, candidates=200, phrase=False)
    return shown(r)


@query
def search_page(spark, d):
    """The second page of the final version, with phrases and snippets, of all candidates."""
    r = S.search(QUERY, served(spark, d), page_details(spark, d), t(spark, d, "pt_pgrk"), offset=10, limit=10, drop=None)
    return shown(r)


@query
def search_v2(spark, d):
    """The second version, in which a word weighs as often as it stands in the query; the second page of it."""
    r = S.search(f"{QUERY}-{WORDS[0]}", served(spark, d), page_details(spark, d), t(spark, d, "pt_pgrk"), S.VERSIONS[2], drop=None, candidates=100_000, offset=10, query_tf=True)
    return shown(r)


@query
def search_v5(spark, d):
    """The fifth version, without phrases."""
    return shown(S.search(QUERY, served(spark, d), page_details(spark, d), t(spark, d, "pt_pgrk"), S.VERSIONS[5], drop=None, candidates=200, phrase=False))


@query
def search_v4(spark, d):
    """The fourth version: candidates of many domains."""
    r = S.search(QUERY, served(spark, d), page_details(spark, d), t(spark, d, "pt_pgrk"), S.VERSIONS[4], candidates=30, diverse=True)
    return shown(r)


@query
def search_cosine(spark, d):
    return S.cosine_scores(plain_index(spark, d), I.frequencies(tokens(spark, d)), list(WORDS)).select("doc", F.round("cosine", 6).alias("cosine"))


@query
def search_positions(spark, d):
    """The places of several words in each document."""
    lists = S.positions_of(plain_index(spark, d), list(WORDS))
    one = F.transform(F.map_entries("lists"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda p: p.cast("string")), " ")))
    return lists.select("doc", F.array_join(F.array_sort(one), ";").alias("lists"))


@query
def search_details(spark, d):
    """Titles and urls of ranked pages, empty where unknown."""
    heads = t(spark, d, "pt_processed").groupBy(F.col("row_key").alias("url_hash")).agg(F.max("title").alias("title"), F.max("url").alias("url"))
    return L.with_details(L.best_ranks(t(spark, d, "pt_pgrk")).select("url_hash"), heads, "url_hash", ["title", "url"])


@query
def search_snapshot(spark, d):
    """The stored page of an address: of all rows of the first address in order, the latest."""
    pages = t(spark, d, "pt_crawl").where("page is not null")
    first = pages.agg(F.min("url")).first()[0]
    return pages.where(F.col("url") == first).groupBy("url").agg(F.max(F.struct("fetched_at", "page")).alias("m")).select("url", F.col("m.page").alias("page"))


@query
def search_key_page(spark, d):
    """The third page of ten keys."""
    return L.page_of(t(spark, d, "pt_crawl").select("row_key").distinct(), [F.asc("row_key")], 20, 10)


@query
def search_rank_sorted(spark, d):
    found = S.having_all(served(spark, d), ["library"]).select(F.col("doc").alias("url_hash"))
    return L.page_of(L.with_rank(found, t(spark, d, "pt_pgrk")), [F.desc("rank"), F.asc("url_hash")], 0, 50).select("url_hash", F.round("rank", 6).alias("rank"))


@query
def search_diverse_topk(spark, d):
    urls = t(spark, d, "pt_crawl").groupBy(F.col("row_key").alias("url_hash")).agg(F.min("url").alias("url"))
    return L.diverse_top(L.with_rank(urls, t(spark, d, "pt_pgrk"), None), 2, 30).select("url", "domain")


@query
def search_location(spark, d):
    places = t(spark, d, "pt_crawl").where("ip is not null").select("row_key", F.regexp_extract("ip", r"([0-9]+)$", 1).alias("zip")).distinct()
    found = S.place_search(served(spark, d), places, list(WORDS), 100)
    return found.select("doc", F.round("score", 6).alias("score"), F.array_join(F.transform("best", lambda x: x.cast("string")), " ").alias("best"))


@query
def search_image_and(spark, d):
    return S.image_search(idx_image(spark, d), ["small", "widget"])


@query
def search_image_fuzzy(spark, d):
    return S.image_search(idx_image(spark, d), ["small", "widget", "red"], all_words=False)


@query
def search_image_list(spark, d):
    return S.images_of_word(idx_image(spark, d), "Widget")


@query
def search_documents(spark, d):
    pdf = t(spark, d, "documents").where("source = 'pdf'")
    return S.document_search(I.postings(I.tokens_by_space(pdf, "doc_id", "text")), pdf.select(F.col("doc_id").alias("doc"), "url", "lang"), list(WORDS), 20)


@query
def search_id_lookup(spark, d):
    ids = I.id_dictionary(t(spark, d, "pt_crawl"), "row_key").select(F.col("key").alias("row_key"), "id")
    return L.resolved(ids, t(spark, d, "pt_crawl").groupBy("row_key").agg(F.min("url").alias("url")), "row_key")


@query
def search_ip_check(spark, d):
    return t(spark, d, "pt_crawl").where("ip is not null").groupBy(X.ip_address(F.col("ip")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# Graphs


def graph(spark, d):
    return G.edges_from_cells(t(spark, d, "pt_outgoing"))


@query
def graph_crawled_edges(spark, d):
    return G.crawled_only(graph(spark, d), t(spark, d, "pt_crawl"))


@query
def graph_adjacency(spark, d):
    return G.adjacency(graph(spark, d))


@query
def graph_incoming(spark, d):
    e = graph(spark, d)
    return e.groupBy("dst").agg(F.count(F.lit(1)).alias("incoming"))


@query
def graph_sinks(spark, d):
    return G.sinks(t(spark, d, "pt_crawl"), graph(spark, d))


@query
def graph_anchor_text(spark, d):
    return G.anchor_texts(t(spark, d, "pt_crawl"))


@query
def graph_pagerank(spark, d):
    """Four rounds. The tiny addend keeps exact ties of the seventh digit from depending on the order of sums."""
    return R.pagerank(t(spark, d, "pt_crawl"), graph(spark, d), rounds=4).select("row_key", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


@query
def graph_pagerank_sticky(spark, d):
    """Until every page has once changed by at most a tenth."""
    return R.pagerank(t(spark, d, "pt_crawl"), graph(spark, d), eps=0.1, sticky=True).select("row_key", F.round(F.col("rank") + 1e-9, 5).alias("rank"))


@query
def graph_pagerank_converged(spark, d):
    return R.pagerank(t(spark, d, "pt_crawl"), graph(spark, d), eps=0.01).select("row_key", F.round(F.col("rank") + 1e-9, 5).alias("rank"))


def domains(spark, d):
    return t(spark, d, "pt_crawl").groupBy("row_key").agg(U.top_domain(F.min("url")).alias("domain"))


@query
def graph_pagerank_domain_penalty(spark, d):
    """Three rounds of the in-memory variant: no self links, links inside a domain count 0.3, sinks spread their rank."""
    r = R.pagerank(t(spark, d, "pt_crawl"), graph(spark, d), rounds=3, sink_spread=True, drop_self=True, domains=domains(spark, d), same_domain_weight=0.3)
    return r.select("row_key", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


@query
def graph_pagerank_without_sources(spark, d):
    """Two rounds of the variant that ranks only pages with inbound links."""
    r = R.pagerank(t(spark, d, "pt_crawl"), graph(spark, d), rounds=2, without_sources=True)
    return r.select("row_key", F.round(F.col("rank") + 1e-9, 6).alias("rank"))


@query
def graph_converged_share(spark, d):
    p = t(spark, d, "pt_crawl")
    e = R.weighted_edges(p, graph(spark, d))
    ranks = p.select("row_key").distinct().withColumn("rank", F.lit(1.0))
    return R.converged_share(R.step(ranks, e), 0.5).select(F.round("percent", 6).alias("percent"))


@query
def graph_rank_histogram(spark, d):
    return R.rank_histogram(t(spark, d, "pt_pgrk"))


@query
def graph_join_ranks(spark, d):
    keys = t(spark, d, "pt_crawl").select(F.col("row_key").alias("url_hash")).distinct()
    return L.with_rank(keys, t(spark, d, "pt_pgrk"))


# Suggestions


@query
def suggest_prefix(spark, d):
    return Q.completions(Q.vocabulary(tokens(spark, d)), "li", 20)


@query
def suggest_fuzzy(spark, d):
    return Q.near_words(Q.vocabulary(tokens(spark, d)), "libary", 2, 10)


@query
def suggest_correct(spark, d):
    return Q.corrected_each(Q.vocabulary(tokens(spark, d)), "libary harbor", 5)


@query
def suggest_last(spark, d):
    return Q.corrected_last(Q.vocabulary(tokens(spark, d)), "the harbor", 5)


@query
def suggest_query(spark, d):
    """Every word of a query replaced by its nearest one."""
    return spark.createDataFrame([(Q.corrected(Q.vocabulary(tokens(spark, d)), "libary of harbor 42", frozenset({"of"})),)], "corrected string")


@query
def suggest_exists(spark, d):
    words = Q.vocabulary(tokens(spark, d))
    asked = ["library", "libary", "li", "qqq"]
    return spark.createDataFrame([(w, Q.contains(words, w), Q.starts_any(words, w)) for w in asked], "word string, known boolean, begins boolean")


@query
def ngram_next(spark, d):
    return Q.transitions(tokens(spark, d), 2)


@query
def ngram_followers(spark, d):
    return Q.followers(Q.transitions(tokens(spark, d), 1), "library")


@query
def suggest_letters(spark, d):
    return Q.letters_after(Q.vocabulary(tokens(spark, d)), "li")


@query
def letter_next(spark, d):
    return Q.next_letters(Q.vocabulary(tokens(spark, d)), 2)


# Crawl


@query
def crawl_frontier_step(spark, d):
    crawl = t(spark, d, "pt_crawl")
    links = G.listed_links(t(spark, d, "pt_processed")).select(F.col("link").alias("url"))
    patterns = spark.createDataFrame([(p,) for p in BLACKLIST], "pattern string")
    return C.frontier_step(links, crawl, t(spark, d, "pt_hosts"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), crawl.where("responsecode = '200'").select("url"), patterns)


@query
def crawl_loop(spark, d):
    """A whole crawl from the least address of each host, answered from the table of pages."""
    pages = t(spark, d, "pt_crawl")
    seeds = pages.groupBy(U.host_of(F.col("url")).alias("host")).agg(F.min("url").alias("url")).select("url")
    return C.crawl(seeds, X.TableFetcher(pages), per_host=None, robots=False, clock=C.StepClock()).pages.select("url", "responsecode")


@query
def crawl_fetch_table(spark, d):
    links = G.listed_links(t(spark, d, "pt_processed")).select(F.col("link").alias("url"))
    return X.TableFetcher(t(spark, d, "pt_crawl")).fetch(links).groupBy("responsecode").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_combined(spark, d)
