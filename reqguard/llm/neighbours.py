"""Each row's follower in one global order, without bringing the rows into one task."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqguard.llm.text import let

LOWEST = -(2 ** 63)
#: Rows of a range: as many as the shuffle's partitions share, but within these bounds.
LEAST_ROWS, MOST_ROWS = 500, 20_000


def heads(df: DataFrame, least: int, most: int) -> list:
    """The first place (_k, _h) of each range of rows: a row for each range, from sampled splitters."""
    n, = df.agg(F.count(F.lit(1))).first()
    parts = max(1, n // most, min(n // least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = df.select("_k", "_h").repartitionByRange(parts, "_k", "_h")
    return sorted(r["first"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("_k", "_h")).alias("first")).collect())


def range_of(firsts: list) -> Column:
    """How many ranges after the first begin at or before a row's place, by binary search in an array of their heads."""
    if len(firsts) < 2:
        return F.lit(0)
    k, h = (F.lit(np.array([f[i] for f in firsts[1:]], dtype=np.int64)) for i in (0, 1))
    low, high = F.lit(0).alias("low"), F.lit(len(firsts) - 1).alias("high")

    def step(a, _):
        def halved(mid):
            begun = (F.get(k, mid) < F.col("_k")) | ((F.get(k, mid) == F.col("_k")) & (F.get(h, mid) <= F.col("_h")))
            return F.when(a["low"] >= a["high"], a).when(begun, F.struct((mid + 1).alias("low"), a["high"].alias("high"))).otherwise(
                F.struct(a["low"].alias("low"), mid.alias("high")))
        return let(F.floor((a["low"] + a["high"]) / 2).cast("int"), halved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(firsts).bit_length())), F.struct(low, high), step, lambda a: a["low"])


def with_ranges(df: DataFrame, key: str, tie: list[str], least: int = LEAST_ROWS, most: int = MOST_ROWS) -> tuple[DataFrame, Window]:
    """Rows dealt into ranges (`_range`) of descending keys, each closed by the row that follows its last one (`_halo` is
    true), and the window in which lead() then finds every row's follower.

    After the last row comes the first. Null keys come last. Rows of equal key are in the order of a hash of the tie
    columns, so a frequent key fills as many ranges as it needs; only rows that are equal in key and tie stay together.
    The number of ranges grows with the rows; what the driver holds is one place per range.
    """
    df = df.withColumn("_k", F.bitwise_not(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)))) \
           .withColumn("_h", F.xxhash64(*tie) if tie else F.lit(0).cast("long"))
    firsts = heads(df, least, most)
    df = df.withColumn("_range", range_of(firsts))
    first_k, first_h = (F.get(F.lit(np.array([f[i] for f in firsts] or [0], dtype=np.int64)), F.col("_range")) for i in (0, 1))
    # every range begins with its head; that row closes the range before, and the very first one the last
    halo = df.filter((F.col("_k") == first_k) & (F.col("_h") == first_h)).withColumn(
        "_range", F.when(F.col("_range") == 0, len(firsts) - 1).otherwise(F.col("_range") - 1))
    both = df.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
    return both, Window.partitionBy("_range").orderBy("_halo", "_k", "_h", *tie)


def without_ranges(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_k", "_h", "_range", "_halo")
