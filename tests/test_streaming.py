"""Streams over several files must give what the batch operators give."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reqguard.config import LIVE
from reqguard.operators import decisions as D
from reqguard.operators import memory as M
from reqguard.operators import risk as RK
from reqguard.streaming import jobs as J
from reqguard.sources.tables import load_snapshot

CFG = replace(LIVE, block_rows=64)


@pytest.fixture(scope="module")
def files(traffic, tmp_path_factory):
    df, _ = traffic
    folder = str(tmp_path_factory.mktemp("stream"))
    for low, high in ((0, 200), (200, 330), (330, 600)):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read in the order of their times, which are whole seconds
    return folder


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_memory_stream_equals_batch(spark, traffic, files, tmp_path):
    df, _ = traffic
    J.start(stream(spark, files, df.schema), J.memory_batch(f"{tmp_path}/s", f"{tmp_path}/out", CFG, "ip"),
            f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch", "gap_var")
    want = M.deception_intent(M.behavior_deviation(M.behavior_memory(df, CFG, "ip"))).select(*got.columns)
    assert got.count() == 600 and got.exceptAll(want).count() == 0


def test_risk_stream_equals_batch(spark, traffic, tmp_path):
    df, _ = traffic
    rows = df.select("event_id", F.col("ip").alias("key"), "t_us", (F.col("event_id") % 11 * 10).cast("double").alias("raw"))
    for low, high in ((0, 250), (250, 600)):
        rows.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    J.start(stream(spark, f"{tmp_path}/in", rows.schema), J.risk_batch(f"{tmp_path}/s", f"{tmp_path}/out", CFG, evict=False),
            f"{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("event_id", "score")
    want = RK.decayed_risk(RK.numbered(rows, CFG), CFG).select("event_id", "score")
    assert got.count() == 600 and got.exceptAll(want).count() == 0


def test_rollup_stream_and_rule_dedupe(spark, traffic, files, tmp_path):
    df, _ = traffic
    source = J.with_event_time(stream(spark, files, df.schema))
    J.feature_rollup(source, 300).writeStream.format("parquet").option("path", f"{tmp_path}/o").option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/o")
    want = df.groupBy(F.expr("t_us div 300000000 * 300000000").alias("window_us"), "ip").agg(
        F.count("*").alias("requests"), F.count_distinct("endpoint").alias("unique_endpoints"))
    assert got.count() > 0 and got.select("window_us", "ip", "requests", "unique_endpoints").exceptAll(want).count() == 0

    rules = source.select(F.lit("SCAN").alias("kind"), F.col("ip").alias("key"), "ts")
    J.first_rules(rules).writeStream.format("parquet").option("path", f"{tmp_path}/r").option(
        "checkpointLocation", f"{tmp_path}/rc").trigger(availableNow=True).start().awaitTermination()
    n = spark.read.parquet(f"{tmp_path}/r").count()
    assert 6 <= n < 600


def test_feedback_uses_only_earlier_batches(spark, traffic, tmp_path):
    df, _ = traffic
    scored = D.scored(df, CFG).cache()
    run = J.feedback_batch(f"{tmp_path}/s", f"{tmp_path}/o")
    run(scored.filter("event_id < 300"), 0)
    run(scored.filter("event_id >= 300"), 1)
    run(scored.filter("event_id >= 300"), 1)  # a repeated batch changes nothing
    first = spark.read.parquet(f"{tmp_path}/o/batch=0")
    assert first.filter("path_mult <> 1 or fingerprint_mult <> 1 or signature_mult <> 1 or repeat <> 0").count() == 0
    severe = {r["endpoint"]: r["n"] for r in first.filter(D.severe()).groupBy("endpoint").agg(F.count("*").alias("n")).collect()}
    for r in spark.read.parquet(f"{tmp_path}/o/batch=1").collect():
        assert r["path_mult"] == pytest.approx(1 + 0.1 * severe.get(r["endpoint"], 0))
    both = spark.read.parquet(f"{tmp_path}/o").filter(D.severe()).count()
    total = load_snapshot(spark, f"{tmp_path}/s").filter("kind = 'path'").agg(F.sum("n")).first()[0]
    assert both == total


def test_expiry_and_correlation_batches(spark, tmp_path):
    run = J.expiry_batch(f"{tmp_path}/s")
    cols = "item string, op string, t_us long, event_id long, expires_us long"
    run(spark.createDataFrame([("a", "block", 1, 1, 50), ("b", "block", 2, 2, 10)], cols), 0)
    run(spark.createDataFrame([("a", "unblock", 5, 3, None), ("c", "block", 6, 4, None)], cols), 1)
    live = J.in_force(load_snapshot(spark, f"{tmp_path}/s"), F.lit(9)).collect()
    assert sorted(r["item"] for r in live) == ["b", "c"]

    rows = [(0, "a", [1.0, 0.0]), (0, "b", [1.0, 0.1]), (300, "c", [0.0, 1.0])]
    J.correlation_batch(f"{tmp_path}/corr")(spark.createDataFrame(rows, "window_us long, ip string, vec array<double>"), 0)
    got = {(r["window_us"], r["ip"]): r["peers"] for r in spark.read.parquet(f"{tmp_path}/corr").collect()}
    assert got == {(0, "a"): 1, (0, "b"): 1, (300, "c"): 0}


def test_late_rows_do_not_raise_scores_and_old_scores_leave(spark, tmp_path):
    from reqguard.sources.tables import load_snapshot
    second = 1_000_000
    run = J.risk_batch(f"{tmp_path}/s", f"{tmp_path}/out", CFG)
    names = "event_id long, key string, t_us long, raw double"
    run(spark.createDataFrame([(1, "a", 1000 * second, 50.0), (2, "b", 1000 * second, 2.0)], names), 0)
    run(spark.createDataFrame([(3, "a", 400 * second, 10.0)], names), 1)
    assert {r["event_id"]: r["score"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: 50.0, 2: 2.0, 3: 50.0}
    run(spark.createDataFrame([(4, "c", 1400 * second, 30.0)], names), 2)
    left = load_snapshot(spark, f"{tmp_path}/s", before=4)
    assert {r["key"]: r["t_us"] // second for r in left.collect()} == {"a": 1000, "c": 1400}


def test_expired_blocks_leave_the_state(spark, tmp_path):
    from reqguard.sources.tables import load_snapshot
    run = J.expiry_batch(f"{tmp_path}/s")
    names = "item string, op string, t_us long, event_id long, expires_us long"
    run(spark.createDataFrame([("a", "block", 1, 1, 10), ("b", "block", 1, 2, 100), ("c", "block", 1, 3, None)], names), 0)
    run(spark.createDataFrame([("d", "block", 50, 4, 60), ("b", "unblock", 50, 5, None)], names), 1)
    assert {r["item"] for r in load_snapshot(spark, f"{tmp_path}/s", before=3).collect()} == {"c", "d"}
