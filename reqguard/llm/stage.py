"""Intermediate tables in the folder that the cluster shares."""

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from reqguard.session import sent, shared_dir

__all__ = ["discard", "release", "sent", "stage"]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables made by `stage` that no result still to come reads."""
    for df in staged:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, rounds: int = 3) -> None:
    """Shuffle files of a finished step go when the driver's collector finds that nothing refers to them; this makes it
    look now. What the first look frees holds the rest, so it takes more than one."""
    for _ in range(rounds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
