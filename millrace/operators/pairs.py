"""A pair bag is a frame with string columns ``key`` and ``value``, a multimap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_map(pairs: DataFrame, elements: Column) -> DataFrame:
    """All elements of an array expression over key and value, as a bag."""
    return pairs.select(F.explode(elements).alias("value"))


def flat_map_to_pair(pairs: DataFrame, made: Column) -> DataFrame:
    return pairs.select(F.explode(made).alias("_p")).select(F.col("_p.key").cast("string").alias("key"), F.col("_p.value").cast("string").alias("value")).where("key is not null")


def fold_by_key(pairs: DataFrame, aggregate: Column, name: str = "value") -> DataFrame:
    """Per key by an associative aggregate; partial results are combined before the shuffle."""
    return pairs.groupBy("key").agg(aggregate.alias(name))


def fold_by_key_ordered(pairs: DataFrame, zero: Column, step: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
    """Per key by any expression, over the values in sorted order, from ``zero`` once. All values of a key come together in one row."""
    return pairs.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list("value")), zero, step).alias(name))


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every combination of the values of equal keys, joined by a comma. Null keys never match."""
    r = right.select("key", F.col("value").alias("_r"))
    return left.select("key", "value").join(r, "key").select("key", F.concat("value", F.lit(","), "_r").alias("value"))


def cogroup(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each key of either side ``[a,b],[c]``, the sorted values of both; a side without the key gives ``[]``."""
    side = lambda df, name: df.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias(name))
    both = side(left, "_l").join(side(right, "_r"), "key", "full")
    return both.select("key", F.concat(F.lit("["), F.coalesce("_l", F.lit("")), F.lit("],["), F.coalesce("_r", F.lit("")), F.lit("]")).alias("value"))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct pairs that are in both."""
    return left.select("key", "value").intersect(right.select("key", "value"))


def grouped_values(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))


def collect(pairs: DataFrame) -> list[tuple[str, str]]:
    return [(r["key"], r["value"]) for r in pairs.select("key", "value").collect()]
