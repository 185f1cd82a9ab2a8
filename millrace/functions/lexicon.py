"""Dictionary, lemmas and stop words. They are inputs, never bundled; frames are joined, broadcast only by the optimiser's own size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lemmatized(words: DataFrame, dictionary: DataFrame, lemmas: DataFrame | None = None, stop_words: DataFrame | None = None, column: str = "word") -> DataFrame:
    """``words`` with ``column`` in lower case as its lemma; words outside the dictionary and stop words are dropped.

    dictionary(word), lemmas(word, lemma), stop_words(word); null and repeated entries are ignored, other columns of ``words`` pass through.
    """
    known = dictionary.where("word is not null").select(F.lower("word").alias("_w")).distinct()
    out = words.withColumn("_w", F.lower(column)).join(known, "_w", "left_semi")
    if lemmas is not None:
        table = lemmas.where("word is not null and lemma is not null").groupBy(F.lower("word").alias("_w")).agg(F.min(F.lower("lemma")).alias("_l"))
        out = out.join(table, "_w", "left").withColumn("_w", F.coalesce("_l", "_w")).drop("_l")
    if stop_words is not None:
        out = out.join(stop_words.where("word is not null").select(F.lower("word").alias("_w")).distinct(), "_w", "left_anti")
    return out.withColumn(column, F.col("_w")).drop("_w")
