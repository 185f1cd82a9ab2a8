from pyspark.sql import functions as F

from millrace.operators.kv import SCHEMA
from millrace.streaming import incremental as N


def test_latest_cells_of_a_growing_table(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("a", "x", "1", 1), ("b", "x", "1", 1)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    N.keep_latest(N.cell_stream(spark, source), target, check).awaitTermination()
    spark.createDataFrame([("a", "x", "2", 2)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    N.keep_latest(N.cell_stream(spark, source), target, check).awaitTermination()
    got = spark.read.schema(SCHEMA).parquet(f"{target}/generation=1").collect()
    assert sorted((r["row_key"], r["value"]) for r in got) == [("a", "2"), ("b", "1")]


def test_windows(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    n = N.windowed_counts(events, "ts", "event_type", "1 day").agg(F.sum("n")).first()[0]
    assert n == events.count()
