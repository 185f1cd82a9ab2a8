"""A bag is a frame with one column ``value`` of strings; operators on it are lazy plans, nothing is stored between them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parallelize(spark: SparkSession, values: Iterable[str | None]) -> DataFrame:
    """A bag of the given strings; nulls are kept."""
    return spark.createDataFrame([(v,) for v in values], "value string")


def from_table(table: DataFrame, value: Column) -> DataFrame:
    """One element for every row; rows for which ``value`` is null give none."""
    return table.select(value.cast("string").alias("value")).where("value is not null")


def flat_map(bag: DataFrame, elements: Column) -> DataFrame:
    """All elements of an array expression over ``value``; null and empty arrays give none."""
    return bag.select(F.explode(elements).alias("value"))


def flat_map_python(bag: DataFrame, function: Callable[[str], Iterable[str] | None]) -> DataFrame:
    """As ``flat_map`` by a Python function, in Arrow batches. An exception fails the job instead of losing the element."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [x for v in batch["value"] for x in (function(v) or ())]}, dtype="object")

    return bag.select("value").mapInPandas(run, "value string")


def map_partitions(bag: DataFrame, function: Callable[[Iterator[str]], Iterable[str]], batch_rows: int = 10_000) -> DataFrame:
    """An iterator function over each partition's elements; the output is handed on in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[str] = []
        for x in function(v for batch in batches for v in batch["value"]):
            out.append(x)
            if len(out) >= batch_rows:
                yield pd.DataFrame({"value": out}, dtype="object")
                out = []
        yield pd.DataFrame({"value": out}, dtype="object")

    return bag.select("value").mapInPandas(run, "value string")


def map_to_pair(bag: DataFrame, key: Column, value: Column) -> DataFrame:
    """One pair for every element; a null key drops it."""
    return bag.select(key.cast("string").alias("key"), value.cast("string").alias("value")).where("key is not null")


def flat_map_to_pair(bag: DataFrame, pairs: Column) -> DataFrame:
    """All pairs of an array of structs (key, value) over ``value``."""
    return bag.select(F.explode(pairs).alias("_p")).select(F.col("_p.key").cast("string").alias("key"), F.col("_p.value").cast("string").alias("value")).where("key is not null")


def matching(bag: DataFrame, condition: Column) -> DataFrame:
    return bag.where(condition)


def containing(bag: DataFrame, word: str) -> DataFrame:
    return bag.where(F.col("value").contains(word))


def sample(bag: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each element independently with probability ``share``."""
    return bag.sample(False, share, seed)


def take(bag: DataFrame, n: int) -> DataFrame:
    """Any n elements, all if there are fewer."""
    return bag.limit(n)


def distinct(bag: DataFrame) -> DataFrame:
    return bag.distinct()


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All elements of both, repeated ones included."""
    return left.select("value").unionByName(right.select("value"))


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct elements that are in both."""
    return left.select("value").intersect(right.select("value"))


def group_by(bag: DataFrame, key: Column) -> DataFrame:
    """Pairs of a key and the sorted elements of that key, joined by commas. One key's elements become one string, so their number bounds what fits."""
    return bag.groupBy(key.alias("key")).agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"))


def fold(bag: DataFrame, aggregate: Column) -> DataFrame:
    """A fold by an associative aggregate such as ``sum`` or ``max``: combined in each partition first, then across them."""
    return bag.agg(aggregate)


def fold_python(bag: DataFrame, zero: str, function: Callable[[str, str], str]) -> str:
    """A fold by any function: from ``zero`` in each partition, and from ``zero`` again over their results, so zero counts partitions + 1 times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = zero
        for batch in batches:
            for v in batch["value"]:
                acc = function(acc, v)
        yield pd.DataFrame({"value": [acc]}, dtype="object")

    acc = zero
    for row in bag.select("value").mapInPandas(run, "value string").toLocalIterator():  # one row a partition
        acc = function(acc, row["value"])
    return acc


def count(bag: DataFrame) -> int:
    return bag.count()


def collect(bag: DataFrame) -> list[str]:
    return [r["value"] for r in bag.select("value").collect()]


def save_as_table(bag: DataFrame, name: str) -> DataFrame:
    bag.write.mode("overwrite").saveAsTable(name)
    return bag.sparkSession.table(name)


def destroy(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
