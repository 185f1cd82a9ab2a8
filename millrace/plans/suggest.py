"""Completion, correction and word sequences."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vocabulary(tokens: DataFrame) -> DataFrame:
    return tokens.select("word").distinct()


def completions(words: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return words.where(F.col("word").startswith(prefix)).select("word").distinct().orderBy("word").limit(limit)


def contains(words: DataFrame, word: str) -> bool:
    return not words.where(F.col("word") == word).limit(1).isEmpty()


def starts_any(words: DataFrame, prefix: str) -> bool:
    return not words.where(F.col("word").startswith(prefix)).limit(1).isEmpty()


def shared_prefix(a: Column, b: str) -> Column:
    """How many leading characters two words share."""
    out = F.lit(0)
    for n in range(1, len(b) + 1):
        out = F.when(F.substring(a, 1, n) == b[:n], F.lit(n)).otherwise(out)
    return out


def near_words(words: DataFrame, word: str, distance: int = 1, limit: int = 10) -> DataFrame:
    """Words within an edit distance, the nearest first, then the longest shared prefix, the most similar length, the word. Lengths are compared first, which is cheap."""
    w = F.col("word")
    d = F.levenshtein(w, F.lit(word), distance)
    found = words.select("word").distinct().where(F.abs(F.length(w) - len(word)) <= distance).withColumn("distance", d).where("distance >= 0")
    return found.orderBy("distance", F.desc(shared_prefix(w, word)), F.abs(F.length(w) - len(word)), "word").limit(limit).select("word", "distance")


def corrected_last(words: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The whole query with its last word replaced by each near word."""
    *first, last = query.split()
    lead = " ".join(first)
    return near_words(words, last.lower(), 2, limit).select(F.concat_ws(" ", *([F.lit(lead)] if lead else []), "word").alias("suggestion"), "distance")


def corrected_each(words: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """position, typed, word: near words for every word of the query."""
    out = None
    for k, typed in enumerate(query.lower().split()):
        rows = near_words(words, typed, 1, limit).select(F.lit(k).alias("position"), F.lit(typed).alias("typed"), "word")
        out = rows if out is None else out.unionByName(rows)
    return out


def corrected(words: DataFrame, query: str, stop_words: frozenset[str] = frozenset()) -> str:
    """Every word replaced by its nearest one, except stop words, short words and those with digits or signs."""
    out = []
    for typed in query.split():
        plain = typed.lower()
        if plain in stop_words or len(plain) < 3 or not plain.isalpha():
            out.append(typed)
            continue
        best = near_words(words, plain, 1, 1).first()
        out.append(best["word"] if best else typed)
    return " ".join(out)


def transitions(tokens: DataFrame, order: int = 1) -> DataFrame:
    """gram, next, n: how often each word follows each run of ``order`` words inside a document."""
    w = W.partitionBy("doc").orderBy("pos")
    gram = F.concat_ws(" ", *[F.col("word") if not k else F.lead("word", k).over(w) for k in range(order)])
    return tokens.select(gram.alias("gram"), F.lead("word", order).over(w).alias("next")).where("next is not null").groupBy("gram", "next").agg(F.count(F.lit(1)).alias("n"))


def followers(table: DataFrame, gram: str) -> DataFrame:
    return table.where(F.col("gram") == gram).select("next").distinct()


def next_letters(words: DataFrame, order: int = 2) -> DataFrame:
    """gram, next, n over the letters of the distinct words."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - order)).alias("_i")
    rows = words.select("word").distinct().where(F.length("word") > order).select("word", at)
    return rows.select(F.substr("word", "_i", F.lit(order)).alias("gram"), F.substr("word", F.col("_i") + order, F.lit(1)).alias("next")).groupBy("gram", "next").agg(F.count(F.lit(1)).alias("n"))


def letters_after(words: DataFrame, prefix: str) -> DataFrame:
    """Which letters can follow a prefix in the vocabulary, and in how many words."""
    own = words.select("word").distinct().where(F.col("word").startswith(prefix) & (F.length("word") > len(prefix)))
    return own.groupBy(F.substring("word", len(prefix) + 1, 1).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def random_text(table: DataFrame, start: str, length: int, seed: int = 0) -> str:
    """A seeded walk over transitions; one small query for each word."""
    rng = random.Random(seed)
    out = start.split()
    order = len(out)
    while len(out) < length:
        rows = table.where(F.col("gram") == " ".join(out[-order:])).orderBy("next").collect()  # followers of one gram
        if not rows:
            break
        out.append(rng.choices([r["next"] for r in rows], [r["n"] for r in rows])[0])
    return " ".join(out)
