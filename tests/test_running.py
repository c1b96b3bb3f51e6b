import pandas as pd
import pytest
from pyspark.sql import functions as F

from reqguard.operators.running import block_window, rank_blocks, running, with_pieces


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, (i * i) % 97 * 10, "hot" if i % 3 else f"k{i % 5}", i % 7) for i in range(300)]
    return spark.createDataFrame(data, "event_id long, t_us long, key string, v long")


@pytest.mark.parametrize("segment", [5, 40, 10_000])
def test_running_equals_plain_cumulation(rows, segment):
    got = running(rows, ["key"], {
        "total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high_before": ("max", F.col("v"), "before"),
        "last": ("max", F.struct("t_us", "event_id", "v"), "before")}, segment).toPandas()
    got = got.sort_values(["key", "t_us", "event_id"]).reset_index(drop=True)
    by = got.groupby("key")["v"]
    assert (got["total"] == by.cumsum()).all()
    assert (got["low"] == by.cummin()).all()
    before = by.transform(lambda s: s.cummax().shift())
    assert got["high_before"].isna().equals(before.isna())
    assert (got["high_before"].dropna() == before.dropna()).all()
    last = by.shift()
    assert all((r is None) == pd.isna(x) and (r is None or r["v"] == x) for r, x in zip(got["last"], last))


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_blocks_see_the_rows_before_them(rows, block):
    numbered = running(rows, ["key"], {"rn": ("sum", F.lit(1).cast("long"))}, 50)
    w = block_window(["key"], "rn")
    got = (rank_blocks(numbered, "rn", block, 3).withColumn("back3", F.lag("v", 3).over(w))
           .withColumn("sum3", F.sum("v").over(w.rowsBetween(-2, 0))).filter(~F.col("_ghost")).toPandas())
    got = got.sort_values(["key", "rn"]).reset_index(drop=True)
    assert len(got) == 300
    by = got.groupby("key")["v"]
    assert by.shift(3).fillna(-1).equals(got["back3"].fillna(-1).astype(float))
    assert (by.transform(lambda s: s.rolling(3, min_periods=1).sum()) == got["sum3"]).all()


def test_hot_key_is_spread_over_segments_and_input_read_once(rows):
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = running(rows.mapInArrow(counted, rows.schema), ["key"], {"n": ("sum", F.lit(1))}, 50, written=True)
    assert out.count() == 300 and seen.value == 300
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and "_seg" in plan


def test_null_keys_count_like_any_other(spark):
    rows = spark.createDataFrame([(1, 10, None, "x"), (2, 20, "a", None), (3, 30, None, "x"), (4, 40, "a", None)], "event_id long, t_us long, k string, l string")
    got = running(rows, ["k", "l"], {"n": ("sum", F.lit(1))}, 15).orderBy("event_id").collect()
    assert [r["n"] for r in got] == [1, 1, 2, 2]


def test_a_flood_of_one_key_in_one_second(spark):
    rows = spark.range(100_000).select(F.col("id").alias("event_id"), (F.col("id") * 10).alias("t_us"), F.lit("hot").alias("key"))
    got = running(rows, ["key"], {"n": ("sum", F.lit(1))}, 50_000)
    assert got.filter("n <> event_id + 1").count() == 0 and got.count() == 100_000


@pytest.mark.parametrize("piece", [7, 60, 10_000])
def test_pieces_of_crowded_segments_give_the_same(rows, piece):
    def cumulated(**options):
        out = running(rows, ["key"], {"total": ("sum", F.col("v")), "low_before": ("min", F.col("v"), "before"), "last": ("max", F.struct("t_us", "event_id"))},
                      300, **options)
        return sorted(map(tuple, out.collect()), key=repr)

    assert cumulated(piece_rows=piece) == cumulated()


def test_a_flood_of_one_key_in_one_second_lies_in_bounded_pieces(spark):
    n, bound = 100_000, 4096
    rows = spark.range(n).select(F.col("id").alias("event_id"), (F.lit(5_000_000) + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("t_us"),
                                 F.lit("flood").alias("key"), (F.col("id") % 5).alias("v"))
    rows = rows.unionByName(spark.range(50).select((F.col("id") + n).alias("event_id"), (F.col("id") * 1_000_000).alias("t_us"), F.lit("calm").alias("key"), F.lit(1).alias("v")))
    marked = rows.withColumns({"_key": F.struct("key"), "_seg": F.expr("t_us div 60000000")})
    sizes = with_pieces(marked, bound, ("t_us", "event_id")).groupBy("_key", "_seg", "_piece").count().collect()
    assert max(r["count"] for r in sizes) <= bound and sum(r["count"] for r in sizes) == n + 50
    got = running(rows, ["key"], {"rn": ("sum", F.lit(1).cast("long")), "total": ("sum", F.col("v"))}, 60_000_000, piece_rows=bound)
    last = got.groupBy("key").agg(F.max("rn").alias("rn"), F.count_distinct("rn").alias("n"), F.max_by("total", F.struct("t_us", "event_id")).alias("total")).collect()
    assert {r["key"]: (r["rn"], r["n"], r["total"]) for r in last} == {"flood": (n, n, 2 * n), "calm": (50, 50, 50)}
