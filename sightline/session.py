"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """Single-JVM session for tests and the bench; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sightline")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # small local data: keep all cores busy instead of merging partitions below 1 MB
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def default_folder(master: str) -> str:
    """A temporary folder where driver and executors are one process; elsewhere the folder has to be named."""
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="sightline-")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or default_folder(sc.master))
    return named or sc.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    """Where this application writes below the shared folder; it stays until :func:`clear_session` or its owner removes it."""
    return f"{shared_folder(spark)}/sightline-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession) -> str:
    """New, unused path below the session's folder."""
    return f"{session_folder(spark)}/{uuid.uuid4().hex}"


def clear_session(spark: SparkSession) -> bool:
    """Delete what this application wrote to its folder, at its end: results that are still read from there are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def published(df: DataFrame) -> DataFrame:
    """``df`` as a table below the shared folder, for results that several later steps read."""
    path = f"{work_folder(df.sparkSession)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
