"""Inverted indexes in long form: one row for each word and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.stem import stemmed
from millrace.functions.text import before_punctuation, page_images, tag_attribute
from millrace.functions.urls import normalized_link, short_id
from millrace.session import cut

#: Positions kept for a word of a document.
MAX_POSITIONS = 19
#: Floor of the augmented term frequency.
FLOOR = 0.4


def tokens_by_space(docs: DataFrame, doc: str, text: str, together: bool = False) -> DataFrame:
    """doc, pos, word: split at white space, cut at punctuation, lower case. Positions count all pieces between white space, also those that leave no word.

    With ``together`` the texts are shuffled by document before they are taken apart, so that grouping and windows by (word, document) and by document need no
    shuffle of the far more numerous tokens.
    """
    own = docs.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("_t"))
    if together:
        own = own.repartition(F.col("doc"))
    pieces = F.split(F.trim(F.regexp_replace("_t", r"\s+", " ")), " ")
    return (
        own.select("doc", F.posexplode(pieces).alias("pos", "_w"))
        .select("doc", "pos", F.lower(before_punctuation(F.col("_w"))).alias("word"))
        .where("word <> ''")
    )


def tokens_of(docs: DataFrame, doc: str, words: Column) -> DataFrame:
    """doc, pos, word from an array of words."""
    return docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(words).alias("pos", "word")).where("word <> ''")


def with_stems(tokens: DataFrame) -> DataFrame:
    """Each word, and its stem at the same position where it differs. Only the distinct words are stemmed."""
    stems = tokens.select("word").distinct().withColumn("_s", stemmed(F.col("word"))).where("_s <> word and _s <> ''")
    return tokens.unionByName(tokens.join(stems, "word").select("doc", "pos", F.col("_s").alias("word")))


def postings(tokens: DataFrame) -> DataFrame:
    """word, doc, positions (sorted)."""
    return tokens.groupBy("word", "doc").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


#: Documents of a word that share one row of a list in parts.
PART = 10_000


def in_parts(rows: DataFrame, key: str, doc: str, size: int = PART) -> DataFrame:
    """``rows`` with ``part``, from 0: as many parts for a key as keep about ``size`` rows each, chosen by a hash of ``doc``, so that no task ever holds all rows of a frequent key."""
    parts = rows.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("_parts"))
    return rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64(doc), F.col("_parts")).cast("int")).drop("_parts")


def posting_lists(tokens: DataFrame, size: int | None = None) -> DataFrame:
    """word, postings: ``doc:p p p`` joined by commas, documents with more hits first, then by the first position's text and the document.

    One word's list is one string, as served. With ``size`` a list has as many numbered rows (column ``part``) as keep about so many documents in each, each ordered by itself.
    """
    p = postings(tokens).select("word", (-F.size("positions")).alias("_n"), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("_p"), F.col("doc").cast("string").alias("_d"))
    keys = ["word"] if size is None else ["word", "part"]
    p = p if size is None else in_parts(p, "word", "_d", size)
    rows = F.array_sort(F.collect_list(F.struct("_n", F.substring_index("_p", " ", 1).alias("_f"), "_d", "_p")))
    return p.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: F.concat(r["_d"], F.lit(":"), r["_p"])), ",").alias("postings"))


def frequencies(tokens: DataFrame) -> DataFrame:
    """word, doc, freq, first_pos."""
    return tokens.groupBy("word", "doc").agg(F.count(F.lit(1)).alias("freq"), F.min("pos").alias("first_pos"))


def served_index(tokens: DataFrame) -> DataFrame:
    """word, doc, positions (the first 19), tf, doc_tf (augmented: 0.4 + 0.6 * tf / greatest tf of the document)."""
    p = tokens.groupBy("word", "doc").agg(F.slice(F.array_sort(F.collect_list("pos")), 1, MAX_POSITIONS).alias("positions"), F.count(F.lit(1)).alias("tf"))
    top = F.max("tf").over(W.partitionBy("doc"))
    return p.withColumn("doc_tf", FLOOR + (1 - FLOOR) * F.col("tf") / top)


def document_frequencies(tokens: DataFrame, total: int | None = None) -> DataFrame:
    """word, df, idf = log10(N / df). N is given, or the number of documents that have words."""
    df = tokens.groupBy("word").agg(F.count_distinct("doc").alias("df"))
    n = F.lit(float(total)) if total is not None else tokens.agg(F.count_distinct("doc").cast("double")).scalar()
    return df.withColumn("idf", F.log10(n / F.col("df")))


def document_lists(tokens: DataFrame) -> DataFrame:
    """word, docs, occurrences: how many documents have it and how often, without listing repeats."""
    return tokens.groupBy("word").agg(F.count_distinct("doc").alias("docs"), F.count(F.lit(1)).alias("occurrences"))


def document_word_lists(tokens: DataFrame, size: int = PART) -> DataFrame:
    """word, part, list: the documents of each word joined by commas, once for each occurrence, in key order; frequent words have several parts."""
    rows = in_parts(tokens.groupBy("word", "doc").agg(F.count(F.lit(1)).alias("_n")), "word", "doc", size)
    names = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("doc").alias("d"), F.col("_n").alias("n")))), lambda r: F.array_repeat(r["d"].cast("string"), r["n"].cast("int"))))
    return rows.groupBy("word", "part").agg(F.array_join(names, ",").alias("list"))


def id_dictionary(keys: DataFrame, key: str, start: int = 0, buckets: int = 256) -> DataFrame:
    """Each distinct key with the next number in key order and its five-letter id.

    Numbered without one global sort in one task: keys are ranked inside ``buckets`` ranges whose bounds are quantiles of a sample of the keys, at most 100 for each range, so that
    they hold about as many each whatever the keys begin with; each range starts after those before it.
    """
    k = cut(keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct())
    total = k.count()
    share = min(1.0, 100 * buckets / max(1, total))
    sample = sorted(r["key"] for r in (k if share == 1.0 else k.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))).collect())  # about 100 for each range
    bounds = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if len(sample) >= buckets else []
    at = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("key"))) if bounds else F.lit(0)
    b = k.withColumn("_b", at)
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).cast("bigint").alias("_o"))  # a row for each range
    n = (F.row_number().over(W.partitionBy("_b").orderBy("key")) - 1 + F.col("_o") + start).alias("number")
    return b.join(F.broadcast(offsets), "_b").select("key", n).withColumn("id", short_id(F.col("number")))  # a row for each range


def images_of(pages: DataFrame) -> DataFrame:
    """row_key, src, alt of every image tag with a source."""
    return image_tags(pages).select("row_key", "src", "alt").distinct()


def image_tags(pages: DataFrame) -> DataFrame:
    """row_key, src, address, alt, title of every image tag with a source: as written, and made absolute against the page's url (null where there is none)."""
    t = pages.where("page is not null").select("row_key", "url" if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.explode(page_images(F.col("page"))).alias("tag"))
    text = lambda name: F.lower(F.trim(F.replace(tag_attribute(F.col("tag"), name), F.lit("\n"), F.lit(" "))))
    src = tag_attribute(F.col("tag"), "src")
    return t.select("row_key", src.alias("src"), normalized_link(src, F.col("url")).alias("address"), text("alt").alias("alt"), text("title").alias("title")).where("src <> ''").distinct()


def image_index(images: DataFrame, doc: str = "row_key") -> DataFrame:
    """word, doc, images: the sorted distinct sources whose alt text has the word."""
    w = images.select(F.col(doc).alias("doc"), "src", F.explode(F.split("alt", r"\s+")).alias("_w")).select("doc", "src", before_punctuation(F.col("_w")).alias("word")).where("word <> ''")
    return w.groupBy("word", "doc").agg(F.array_join(F.array_sort(F.collect_set("src")), "\n").alias("images"))


def image_dictionary(images: DataFrame) -> DataFrame:
    """hash, src, alt, row_key of every distinct source, from the page with the least key."""
    from millrace.functions.urls import url_hash

    m = images.groupBy("src").agg(F.min(F.struct("row_key", "alt")).alias("_m"))
    return m.select(url_hash(F.col("src")).alias("hash"), "src", F.col("_m.alt").alias("alt"), F.col("_m.row_key").alias("row_key"))


def place_index(pages: DataFrame, places: DataFrame) -> DataFrame:
    """zip, row_key: pages by the place of their address. places(ip, zip)."""
    known = places.where("ip is not null and zip is not null").groupBy("ip").agg(F.min("zip").alias("zip"))
    return pages.where("ip is not null").join(known, "ip").select("zip", "row_key").distinct()


def top_pages(tokens: DataFrame, ranks: DataFrame, k: int = 200) -> DataFrame:
    """word, place, doc: the k pages of each word by rank, ties by key."""
    from millrace.operators.lookups import best_ranks, top_per_group

    r = tokens.select("word", "doc").distinct().join(best_ranks(ranks).withColumnRenamed("url_hash", "doc"), "doc")
    return top_per_group(r, "word", [F.desc("rank"), F.asc("doc")], k).select("word", (F.col("position") - 1).alias("place"), "doc")


def processed_table(crawl: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The cleaned table of crawled pages that ``done`` doesn't have yet: row_key, url, title, description, text, links."""
    from millrace.functions.text import clean_words, page_description, page_title
    from millrace.operators.lookups import unseen
    from millrace.plans.links import links_of
    from millrace.sources.html import visible_text

    new = crawl if done is None else unseen(crawl, done, "row_key")
    new = new.where("page is not null").dropDuplicates(["row_key"])
    links = links_of(new).groupBy("row_key").agg(F.array_join(F.array_sort(F.collect_list("link")), "\n").alias("links"))
    page = F.col("page")
    rows = new.select("row_key", "url", "ip", page_title(page).alias("title"), page_description(page).alias("description"), clean_words(visible_text(page)).alias("text"), "fetched_at")
    return rows.join(links, "row_key", "left")


class StoredIndex:
    """An index in word buckets on disk, with its number of documents and their frequencies. Lookups read the buckets of their words alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        facts = spark.read.parquet(f"{path}/facts").first()
        self.documents, self.buckets = facts["documents"], facts["buckets"]

    def postings(self, words: list[str]) -> DataFrame:
        """The rows of the words."""
        if not words:
            return self.all().limit(0)
        rows = self.spark.read.parquet(f"{self.path}/postings")
        numbers = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "word string").select(word_bucket(F.col("word"), self.buckets)).distinct().collect()]  # the words of a query
        return rows.where(F.col("bucket").isin(numbers) & F.col("word").isin(words)).drop("bucket")

    def all(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").drop("bucket")


def word_bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def store_index(index: DataFrame, path: str, buckets: int = 64, files: int = 4) -> StoredIndex:
    """Writes an index (word, doc, ...) once, in ``buckets`` folders by a hash of the word, each in about ``files`` files by a hash of the document, sorted by word."""
    spark = index.sparkSession
    rows = index.withColumn("bucket", word_bucket(F.col("word"), buckets)).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(files))).sortWithinPartitions("bucket", "word")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    n = spark.read.parquet(f"{path}/postings").agg(F.count_distinct("doc").alias("documents"), F.lit(buckets).alias("buckets"))
    n.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return StoredIndex(spark, path)


class StoredPages:
    """Pages (doc, title, url, description, text) in buckets of their key, so that the texts of a page of results are read without scanning the others."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def of(self, docs: list) -> DataFrame:
        """The rows of a few documents."""
        rows = self.spark.read.parquet(self.path)
        if not docs:
            return rows.drop("bucket").limit(0)
        kind = dict(rows.dtypes)["doc"]
        numbers = [r[0] for r in self.spark.createDataFrame([(x,) for x in docs], f"doc {kind}").select(word_bucket(F.col("doc"), self.buckets)).distinct().collect()]  # a page of results
        return rows.where(F.col("bucket").isin(numbers) & F.col("doc").isin(docs)).drop("bucket")


def store_pages(pages: DataFrame, path: str, buckets: int = 64) -> StoredPages:
    rows = pages.where("doc is not null").withColumn("bucket", word_bucket(F.col("doc"), buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(4))).sortWithinPartitions("bucket", "doc").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return StoredPages(pages.sparkSession, path, buckets)
