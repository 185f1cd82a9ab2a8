"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", name: str = "millrace") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's own session is used instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts: the one ``spark.checkpoint.dir`` names. Only a local master, where all tasks run on one machine, gets a temporary one if that is absent."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not given:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            given = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(given)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def stored_folder(spark: SparkSession) -> str:
    """Where this application's stored tables lie."""
    return f"{_shared_folder(spark)}/stored-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: a compact lineage cut for wide intermediate results.

    Needed where several branches read the costly result of one pass: filters are pushed below a repartition, so Spark would not share it. ``drop_stored`` deletes all of them.
    """
    spark = df.sparkSession
    path = f"{stored_folder(spark)}/{name or uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Deletes every table that this application stored. Frames still to be evaluated over them, and stored indexes, are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stored_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
