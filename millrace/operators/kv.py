"""Versioned wide-column tables in long form: row_key, col, value, version. The latest version of a cell wins."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "row_key string, col string, value string, version bigint"
CELL_LIMIT = 1024


def latest(cells: DataFrame) -> DataFrame:
    """One row for each cell: the value of the greatest version (of equal versions the greatest value)."""
    return cells.groupBy("row_key", "col").agg(F.max(F.struct("version", "value")).alias("_m")).select("row_key", "col", F.col("_m.value").alias("value"), F.col("_m.version").alias("version"))


def put(cells: DataFrame, new: DataFrame) -> DataFrame:
    """The table with ``new`` (row_key, col, value) written over it, each row one version above the greatest that its row had."""
    return cells.select("row_key", "col", "value", "version").unionByName(versioned(cells, new))


def versioned(cells: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the version that a put gives it: one above the greatest of its row."""
    top = cells.groupBy("row_key").agg(F.max("version").alias("_top"))
    return new.join(top, "row_key", "left").select("row_key", "col", "value", (F.coalesce("_top", F.lit(0)) + 1).cast("bigint").alias("version"))


def put_where(cells: DataFrame, new: DataFrame, if_column: str, equals: str) -> DataFrame:
    """As ``put``, only for rows whose column ``if_column`` now has the value ``equals``."""
    held = latest(cells).where((F.col("col") == if_column) & (F.col("value") == equals)).select("row_key")
    return put(cells, new.join(held, "row_key", "left_semi"))


def put_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Whole rows replaced: no older cell of a row in ``rows`` remains, and its version is above all it had."""
    kept = cells.select("row_key", "col", "value", "version").join(rows.select("row_key").distinct(), "row_key", "left_anti")
    return kept.unionByName(versioned(cells, rows.select("row_key", "col", "value")))


def get_row(cells: DataFrame, key: str, version: int | None = None) -> DataFrame:
    """A row's cells now, or as they were up to a version."""
    own = cells.where(F.col("row_key") == key)
    return latest(own if version is None else own.where(F.col("version") <= version))


def get(cells: DataFrame, key: str, col: str, version: int | None = None) -> DataFrame:
    return get_row(cells, key, version).where(F.col("col") == col).select("value")


def exists_row(cells: DataFrame, key: str) -> bool:
    return not cells.where(F.col("row_key") == key).limit(1).isEmpty()


def scan(cells: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The half-open key range; the bounds reach the Parquet reader."""
    if start is not None:
        cells = cells.where(F.col("row_key") >= start)
    if end is not None:
        cells = cells.where(F.col("row_key") < end)
    return latest(cells)


def count_rows(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("row_key").alias("n_rows"))


def sorted_rows(cells: DataFrame, start: str, limit: int) -> DataFrame:
    """The cells of the first ``limit`` row keys from ``start``."""
    keys = cells.where(F.col("row_key") >= start).select("row_key").distinct().orderBy("row_key").limit(limit)
    return latest(cells.where(F.col("row_key") >= start).join(F.broadcast(keys), "row_key", "left_semi"))  # limit rows


def view(cells: DataFrame, start: str = "", limit: int = 10) -> DataFrame:
    """A page of rows in key order: row_key, cells (a map, sorted, values cut at 1024 characters), next_key (where the next page begins, or null)."""
    page = sorted_rows(cells, start, limit + 1)
    rows = page.groupBy("row_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", F.substring("value", 1, CELL_LIMIT).alias("value"))))).alias("cells"))
    ranked = rows.withColumn("_n", F.row_number().over(W.orderBy("row_key")))  # limit + 1 rows
    return ranked.withColumn("next_key", F.max(F.when(F.col("_n") == limit + 1, F.col("row_key"))).over(W.partitionBy())).where(F.col("_n") <= limit).drop("_n")


def row_hashes(cells: DataFrame) -> DataFrame:
    """A hash of each row that doesn't depend on the order of its cells."""
    return latest(cells).groupBy("row_key").agg(F.sum(F.xxhash64("col", "value").cast("decimal(38,0)")).alias("hash"))


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of rows that differ or are on one side only, with which."""
    a, b = row_hashes(left).withColumnRenamed("hash", "_a"), row_hashes(right).withColumnRenamed("hash", "_b")
    state = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return a.join(b, "row_key", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("row_key", state.alias("side"))


def sampled_by_prefix(rows: DataFrame, letters: int = 3, keep: int = 3, key: str = "row_key") -> DataFrame:
    """The first ``keep`` keys of every prefix."""
    w = W.partitionBy(F.substring(key, 1, letters)).orderBy(key)
    return rows.select(key).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def to_cells(rows: DataFrame, key: str, version: Column, columns: list[str]) -> DataFrame:
    """A wide frame in long form; null cells are absent."""
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.col(key).cast("string").alias("row_key"), version.cast("bigint").alias("version"), F.explode(entries).alias("_e")).select("row_key", F.col("_e.col").alias("col"), F.col("_e.value").alias("value"), "version").where("value is not null")


class Store:
    """Named tables of cells in the session's catalog."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database

    def _name(self, table: str) -> str:
        return f"{self.database}.`{table}`"

    def create(self, table: str) -> None:
        """Fails if the table is there."""
        self.spark.sql(f"CREATE TABLE {self._name(table)} ({SCHEMA}) USING parquet")

    def put(self, table: str, cells: DataFrame) -> None:
        """Writes cells (row_key, col, value), each one version above the greatest of its row; a missing table is made."""
        if not self.spark.catalog.tableExists(self._name(table)):
            self.create(table)
        new = versioned(self.read(table), cells.select("row_key", "col", "value"))
        new.write.mode("append").format("parquet").saveAsTable(self._name(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def rename(self, old: str, new: str) -> None:
        """An existing target is replaced."""
        self.delete(new)
        self.spark.sql(f"ALTER TABLE {self._name(old)} RENAME TO {self._name(new)}")

    def delete(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(table)}")

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)


def main(argv: list[str] | None = None) -> None:
    """put, get, scan, count, delete and rename from a command line."""
    from millrace.session import local_session

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("command", choices=["put", "get", "scan", "count", "delete", "rename"])
    p.add_argument("table")
    p.add_argument("rest", nargs="*")
    a = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    store = Store(spark)
    if a.command == "put":
        store.put(a.table, spark.createDataFrame([tuple(a.rest[:3])], "row_key string, col string, value string"))
    elif a.command == "get":
        print(get(store.read(a.table), a.rest[0], a.rest[1]).first())
    elif a.command == "scan":
        scan(store.read(a.table), *a.rest[:2]).show(truncate=False)
    elif a.command == "count":
        print(count_rows(store.read(a.table)).first()[0])
    elif a.command == "delete":
        store.delete(a.table)
    else:
        store.rename(a.table, a.rest[0])


if __name__ == "__main__":
    main()
