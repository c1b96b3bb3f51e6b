import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reqguard.config import LIVE
from reqguard.functions import scoring
from reqguard.operators import risk as RK


def step(prev, raw, dt):
    if not prev:
        score = raw
    else:
        d = math.exp(-0.005 * dt)
        score = d * prev + (1 - d) * raw
        if raw > 60:
            score = max(score, raw * 0.9)
    return math.floor(min(100.0, max(0.0, score)) * 10 + 0.5) / 10


@pytest.fixture(scope="module")
def raws(spark):
    rng, rows, t = random.Random(3), [], 0
    for i in range(900):
        t += rng.choice([10_000, 500_000, 20_000_000, 400_000_000])
        rows.append((i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 4)}", t, rng.choice([0.0, 3.3, 45.0, 61.0, 88.8, 100.0])))
    return spark.createDataFrame(rows, "event_id long, key string, t_us long, raw double"), rows


def replay(rows):
    last, out = {}, {}
    for i, key, t, raw in rows:
        prev, at = last.get(key, (0.0, t))
        last[key] = (step(prev, raw, (t - at) / 1e6), t)
        out[i] = last[key][0]
    return out


@pytest.mark.parametrize("block_rows", [4, 50, 10_000])
def test_decayed_risk_equals_replay(raws, block_rows, monkeypatch):
    df, rows = raws
    monkeypatch.setattr(RK, "FAN", 3)
    cfg = replace(LIVE, block_rows=block_rows)
    got = RK.decayed_risk(RK.numbered(df, cfg), cfg).collect()
    assert {r["event_id"]: r["score"] for r in got} == replay(rows)


def test_decayed_risk_continues_from_state(raws):
    df, rows = raws
    cfg = replace(LIVE, block_rows=20)
    half = df.filter("event_id < 450")
    first = RK.decayed_risk(RK.numbered(half, cfg), cfg)
    state = first.groupBy("key").agg(F.max_by(F.struct("t_us", "score"), "t_us").alias("s")).select("key", "s.*")
    rest = RK.decayed_risk(RK.numbered(df.filter("event_id >= 450"), cfg), cfg, state=state)
    expected = replay(rows)
    assert {r["event_id"]: r["score"] for r in rest.collect()} == {i: s for i, s in expected.items() if i >= 450}


def test_risk_levels_and_sweep(spark):
    df = spark.createDataFrame([("a", 30.0, 0), ("b", 30.1, 0), ("c", 60.1, 0), ("d", 80.1, 0), ("e", 1.0, 0)],
                               "key string, score double, t_us long")
    levels = {r["key"]: r["l"] for r in df.select("key", scoring.risk_level(F.col("score")).alias("l")).collect()}
    assert levels == {"a": "NORMAL", "b": "ELEVATED", "c": "SUSPICIOUS", "d": "MALICIOUS", "e": "NORMAL"}
    left = {r["key"]: r["current_score"] for r in RK.sweep(df, F.lit(100_000_000)).collect()}
    assert "e" not in left and left["d"] == math.floor(80.1 * math.exp(-0.5) * 10 + 0.5) / 10


def test_raw_risk_boosts(spark):
    names = "freq_score double, failure_score double, pattern_score double, payload_score double, session_score double, " \
            "baseline_score double, burst_detected boolean, acceleration double"
    df = spark.createDataFrame([(40.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, 3.0), (40.0, 0.0, 0.0, 0.0, 0.0, 0.0, True, 3.01),
                                (40.0, 31.0, 0.0, 0.0, 0.0, 0.0, False, 1.0), (40.0, 31.0, 31.0, 0.0, 0.0, 0.0, False, 1.0),
                                (100.0, 100.0, 100.0, 100.0, 100.0, 100.0, True, 9.0)], names)
    got = [(r["boosted_freq"], r["raw"], r["elevated_signals"]) for r in RK.raw_risk(df).collect()]
    expected = [(40.0, 8.8, 1), (78.0, 17.16, 1), (40.0, (8.8 + 8.68) * 1.15, 2), (40.0, (8.8 + 8.68 + 6.2) * 1.3, 3),
                (100.0, 100.0, 4)]
    for g, e in zip(got, expected):
        assert g == pytest.approx(e)
