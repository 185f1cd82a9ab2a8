"""Lines repeated across the documents of one site, found through trees of line templates.

Every line is sorted into a token tree of fixed depth: its site, its length in steps, then ``depth`` tokens of the line, each of a few letters, so that scripts without
spaces have tokens as well. Leaves that cover too few documents are cut off before anything else is read. Below a leaf each different line, by its letters, is a terminal node
with its words. A word that is frequent at its place among the lines of a leaf is a constant of their template, any other a wildcard slot, and neighbouring slots
are one; lines of one leaf that share no constants thus fall into different templates. All of it is sums over partitions, so trees are merged without gathering a leaf,
and a site with a third of all lines is no hot key: counts are combined before the shuffle and by finer keys than the site. A template that covers many documents of its site is
furniture, and its lines are removed.

A line on ``min_docs`` documents is never lost: all its tokens are then frequent, and path, terminal node and words depend on its letters alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import key128, with_site
from millrace.session import stored

#: Letters of a token on the path to a leaf.
TOKEN = 4
#: Each length step is so many times the one before.
STEP = 1.5
#: Leaves up to this many are broadcast (8 bytes each); beyond it they are joined by shuffle.
BROADCAST_LEAVES = 1_000_000


def letters_of(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"[^\p{L}]+", ""))


def site_lines(processed: DataFrame, crawl: DataFrame, min_letters: int = 4) -> DataFrame:
    """row_key, site, line_no, line, letters of every line with enough letters. Null texts, keys and sites have no lines."""
    docs = with_site(processed.where("text is not null and row_key is not null"), crawl, ["row_key", "text"])
    return (
        docs.where("site is not null")
        .select("row_key", "site", F.posexplode(F.split("text", "\n")).alias("_pos", "line"))
        .select("row_key", "site", (F.col("_pos") + 1).alias("line_no"), "line", letters_of(F.col("line")).alias("letters"))
        .where(F.length("letters") >= min_letters)
    )


def _leaf(depth: int) -> Column:
    """The leaf that a line's letters lead to."""
    step = F.floor(F.log(F.length("letters").cast("double")) / math.log(STEP))
    return F.xxhash64("site", step, *(F.substring("letters", 1 + TOKEN * k, TOKEN) for k in range(depth)))


def _words(line: Column) -> Column:
    """The words of a line as codes, a quarter of their size; those with digits count as one and the same."""
    parts = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^\s]*\p{N}[^\s]*", " 0 "), r"[^\p{L}0]+", " ")), " ")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.hash(w))


def _covering(rows: DataFrame, key: str, least: int, name: str) -> DataFrame:
    """The keys that stand in at least ``least`` documents, with how many."""
    return rows.groupBy(key).agg(F.count_distinct(F.xxhash64("row_key")).alias(name)).where(F.col(name) >= least)


def templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """leaf, key, template, constant, docs of every terminal node below ``lines`` (row_key, leaf, key, words).

    template: a number of the constants and slots of the node's template; constant: the share of its words that are constants; docs: documents with exactly these letters.
    """
    nodes = stored(lines.groupBy("leaf", "key").agg(F.count_distinct(F.xxhash64("row_key")).alias("docs"), F.min("words").alias("words")))
    places = nodes.select("leaf", F.col("key.a").alias("node"), "docs", F.posexplode("words").alias("place", "word"))  # leaf and half a key name a node as well as a whole key
    frequent = places.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("_n")).where(F.col("_n") >= min_docs).select("leaf", "place", "word", F.lit(True).alias("fixed"))
    shape = (
        places.drop("docs")
        .join(frequent, ["leaf", "place", "word"], "left")
        .groupBy("leaf", "node")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("word")).alias("word")))).alias("_s"), F.avg(F.coalesce("fixed", F.lit(False)).cast("int")).alias("constant"))
    )
    parts = F.transform("_s", lambda x: F.coalesce(x["word"].cast("string"), F.lit("*")))
    shape = shape.select("leaf", "node", "constant", F.xxhash64("leaf", F.regexp_replace(F.array_join(parts, " "), r"\*( \*)+", "*")).alias("template"))
    return nodes.select("leaf", "key", "docs", F.col("key.a").alias("node")).join(shape, ["leaf", "node"]).drop("node")


def repeated_lines(
    processed: DataFrame,
    crawl: DataFrame,
    min_docs: int = 5,
    depth: int = 2,
    min_constant: float = 0.6,
    min_letters: int = 4,
) -> DataFrame:
    """The lines that a site's templates repeat over many of its documents.

    Returns distinct rows row_key, line_no, docs (different row_key with exactly this line's letters), covered (row_key under its template) and constant (the share of the
    template's words that are not in a slot). A line comes out if its template covers ``min_docs`` documents and has no slot for that line, or at least ``min_constant`` of
    it is constant. Empty input gives no rows; repeated rows count once.
    """
    lines = site_lines(processed, crawl, min_letters).select("row_key", "line_no", "line", _leaf(depth).alias("leaf"), key128(F.concat_ws(" ", "site", "letters")).alias("key"))
    leaves = stored(_covering(lines, "leaf", min_docs, "_docs").select("leaf"))
    n = leaves.count()
    kept = stored(lines.join(F.broadcast(leaves) if n <= BROADCAST_LEAVES else leaves, "leaf", "left_semi").select("row_key", "line_no", "leaf", "key", _words(F.col("line")).alias("words")))
    nodes = templates(kept, min_docs).select("key", "template", "constant", "docs")
    rows = kept.select("row_key", "line_no", "key").join(nodes, "key").drop("key")
    covered = _covering(rows, "template", min_docs, "covered")
    return rows.join(covered, "template").where((F.col("constant") >= min_constant) | (F.col("docs") >= min_docs)).select("row_key", "line_no", "docs", "covered", "constant").distinct()


def without_repeated_lines(processed: DataFrame, crawl: DataFrame, **options) -> DataFrame:
    """``processed`` with a column ``clean_text``: the text without the lines that ``repeated_lines`` finds.

    Rows without text keep a null; a text made of repeated lines only becomes empty. Other columns pass through.
    """
    found = repeated_lines(processed, crawl, **options)
    drop = found.groupBy("row_key").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(
        F.transform(F.split("text", "\n"), lambda line, i: F.when(~F.array_contains("_drop", i + 1), line)),
        lambda line: line.isNotNull(),
    )
    return (
        processed.join(drop, "row_key", "left")
        .withColumn("clean_text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop("_drop")
    )
