"""Session and shared-folder helpers."""

import atexit
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir or, where that is unset, below the warehouse, both of which
    all executors share. It is deleted when the driver's process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    own = f"{folder}/reqguard-{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        atexit.register(_delete, spark, own)
    return own


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended first; then the folder's owner cleans it up
        pass


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back.

    Used where several later branches read the same result: each branch then reads only its own columns, and a lost
    executor costs a re-read instead of a recomputation of everything before.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value):
    """Sends a value of bounded size to each executor once; the function returned gives it in a task. It travels by
    value, classes included."""
    box = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    def get():
        held = box.value
        if len(held) == 1:
            held.append(cloudpickle.loads(held[0]))
        return held[1]

    return get
