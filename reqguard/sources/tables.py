"""Keyed state tables on parquet: latest row per key, merges and versioned snapshots."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order=("t_us", "event_id")) -> DataFrame:
    """Newest row per key, by aggregation: each task sends one row per key to the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order=("t_us", "event_id"),
           created: str = "created_us") -> DataFrame:
    """Replace rows by their newest change but keep the first ``created`` value."""
    cols = state.columns
    rest = [c for c in cols if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    rows = state.unionByName(changes.select(*cols)).groupBy(*keys).agg(F.min(created).alias("_first"), newest)
    return rows.select(*[F.col("_first" if c == created else c if c in keys else f"_row.{c}").alias(c) for c in cols])


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose key the table does not have."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def block_list(ops: DataFrame) -> DataFrame:
    """Current blocks from the log of block and unblock operations: the last operation per ip, if it is a block."""
    return latest_per_key(ops, ["ip"]).filter(F.col("op") == "block")


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in done if fs.exists(hadoop.Path(p, "_SUCCESS")))


def save_snapshot(df: DataFrame, path: str, version: int | None = None) -> int:
    """Write the next (or the given) version of a table; readers see it once it is complete."""
    version = version or max(_versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def load_snapshot(spark: SparkSession, path: str, schema=None, before: int | None = None) -> DataFrame | None:
    """Read the newest complete version (below ``before``, if given), or None when there is none."""
    versions = [v for v in _versions(spark, path) if before is None or v < before]
    if not versions:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/v={versions[-1]}")
