"""Features against a plain replay written from the definitions."""

import math
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import LIVE
from reqguard.operators.features import features, min_interval, presence_changes

CFG = replace(LIVE, segment_s=60, block_rows=32)


def half_up(x, d):
    return math.floor(x * 10 ** d + 0.5) / 10 ** d


def flags(payload):
    low = payload.lower()
    return [f for f, ps in C.PAYLOAD_FLAGS.items() if payload and any(re.search(p, low) for p in ps)]


def replay(rows, key="ip"):
    out, history = {}, {}
    for r in sorted(rows, key=lambda r: (r["t_us"], r["event_id"])):
        seen = history.setdefault(r[key], [])
        seen.append(r)
        now = r["t_us"]
        win = [x for x in seen if x["t_us"] > now - 300_000_000]
        long_n = sum(x["t_us"] > now - 3_600_000_000 for x in seen)
        t = [x["t_us"] / 1e6 for x in win]
        n = len(win)
        f = {"requests_in_window": n, "acceleration": 0.0, "avg_interval": 0.0, "burst_detected": False, "freq_score": 0.0}
        if n >= 2:
            gaps = [b - a for a, b in zip([x["t_us"] for x in win], [x["t_us"] for x in win][1:])]
            f["avg_interval"] = half_up((win[-1]["t_us"] - win[0]["t_us"]) / 1e6 / (n - 1), 3)
            f["min_interval"] = half_up(min(gaps) / 1e6, 3)
            f["burst_detected"] = sum(x["t_us"] > now - 10_000_000 for x in win) > 20
            a = 1.0
            if n > 4:
                a = (3 / ((win[-1]["t_us"] - win[-4]["t_us"]) / 1e6 + 0.001)) / (
                    n / ((win[-1]["t_us"] - win[0]["t_us"]) / 1e6 + 0.001) + 0.001)
            f["acceleration"] = half_up(a, 2)
            f["freq_score"] = half_up(min(100, n / 11 * 20) if n / 11 > 2 else 0, 1)
        bad = [x["status_code"] in (401, 403, 422) for x in win]
        streak = 0
        for b in reversed(bad):
            if not b:
                break
            streak += 1
        login = sum(b and any(m in x["endpoint"] for m in ("/login", "/auth", "/api/auth")) for b, x in zip(bad, win))
        rate = sum(bad) / n
        f |= {"failure_count": sum(bad), "consecutive_failures": streak, "login_failures": login,
              "failure_rate": half_up(rate, 3),
              "failure_score": min(100, 30 * (sum(bad) > 5) + 25 * (streak > 3) + 30 * (login > 3) + 15 * (rate > 0.7))}
        paths = [x["endpoint"] for x in win]
        numbers = sorted(int(v) for p in paths for v in re.findall(r"/(\d+)", p))
        enum = sum(b - a == 1 for a, b in zip(numbers, numbers[1:])) >= 3
        scan = len(set(paths)) > 10 and n > 15
        odd = sum(x["method"] in ("DELETE", "PUT", "PATCH", "OPTIONS") for x in win)
        sens = sum(p in C.SENSITIVE_ENDPOINTS for p in paths)
        f |= {"unique_endpoints": len(set(paths)), "sensitive_hits": sens, "scan_pattern": scan,
              "enumeration_detected": enum, "unusual_methods": odd,
              "pattern_score": min(100, 25 * (sens > 3) + 35 * scan + 20 * enum + 15 * (odd > 5) + 5 * (len(set(paths)) > 8))}
        every = flags(r["payload"]) + [x for w in win[:20] for x in flags(w["payload"])]
        f |= {"total_flags_recent": len(every), "current_flags": len(flags(r["payload"])),
              "payload_score": min(100, sum(C.FLAG_SCORES[x] for x in set(every)) + 15 * (len(every) > 5))}
        ua = r["user_agent"].lower()
        bot = any(b in ua for b in C.BOT_WORDS)
        ns, na = (len({x[k] for x in win if x[k]}) for k in ("session_id", "user_agent"))
        f |= {"unique_sessions": ns, "unique_user_agents": na, "bot_indicators": bot,
              "session_score": 25 * (ns > 3) + 30 * (na > 3) + 15 * (not ua) + 20 * bot}
        base = long_n >= 10
        dev = (n / 5) / (long_n / 60 + 0.001)
        f |= {"requests_long": long_n, "has_baseline": base, "rate_deviation": half_up(dev, 2) if base else 0,
              "baseline_score": 40 if base and dev > 3 else 0}
        out[r["event_id"]] = f
    return out


@pytest.mark.parametrize("cfg", [CFG, replace(LIVE, segment_s=100_000, block_rows=100_000)])
def test_features_equal_replay(traffic, cfg):
    df, rows = traffic
    expected = replay(rows)
    got = {r["event_id"]: r.asDict() for r in features(df, cfg).collect()}
    assert len(got) == len(rows)
    for i, f in expected.items():
        for name, value in f.items():
            if name != "min_interval":
                assert got[i][name] == pytest.approx(value), (i, name)
    assert any(f["enumeration_detected"] for f in expected.values())
    assert any(f["requests_in_window"] > 20 for f in expected.values())


def test_min_interval_equals_replay(traffic):
    df, rows = traffic
    expected = replay(rows)
    got = {r["event_id"]: r["min_interval"] for r in min_interval(df, CFG).collect()}
    assert got == {i: f.get("min_interval") for i, f in expected.items()}


def test_features_do_not_depend_on_partitions(traffic):
    df, _ = traffic
    a = {tuple(r) for r in features(df.repartition(1), CFG).collect()}
    assert a == {tuple(r) for r in features(df.repartition(64), CFG).collect()}


def test_numbers_present_together_at_window_edges(spark):
    second = 1_000_000
    times = [(1, 0), (2, 10), (3, 20), (4, 299), (5, 301), (9, 640)]
    rows = [(i, 1_700_000_000 * second + t * second, "a", "GET", f"/api/users/{n}", 200, "x", "s", "")
            for i, (n, t) in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, ip string, method string, endpoint string, "
                                     "status_code long, user_agent string, session_id string, payload string")
    got = {r["event_id"]: (r["enumeration_detected"], r["unique_endpoints"]) for r in features(df, CFG).collect()}
    assert [got[i] for i in range(6)] == [(False, 1), (False, 2), (False, 3), (True, 4), (True, 4), (False, 1)]


def test_presence_leaves_out_requests_without_endpoint(spark):
    rows = [(1, 10, "a", "/x/7", "s", "u"), (2, 20, "a", None, "t", "v")]
    df = spark.createDataFrame(rows, "event_id long, t_us long, ip string, endpoint string, session_id string, user_agent string")
    got = sorted((r["what"], r["at"], r["step"]) for r in presence_changes(df, "ip", 100).collect())
    assert got == [(w, at, step) for w in ("agent", "endpoint", "session") for at, step in ((10, 1), (110, -1))]


def test_sorts_compare_a_number_and_vectors_are_made_once(spark):
    from reqguard.operators import vectors as V
    from reqguard.operators.running import running
    from reqguard.plans.queries import exploded

    df = spark.createDataFrame([(i, i, i, f"k{i}") for i in range(3)], "id long, t_us long, event_id long, key string")
    plan = running(df, ["key"], {"n": ("sum", F.lit(1))}, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_hash" in plan
    both = df.join(df.select("event_id", F.col("id").alias("y")), "event_id")
    made = exploded(both.select("event_id", V.unit(F.array(F.col("id").cast("double"), F.col("y").cast("double"))).alias("vec")))
    assert not [x for x in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "transform" in x]
    assert sorted((r["event_id"], r["dim"], round(r["value"], 6)) for r in made.collect()) == [
        (i, k, 0.707107) for i in (1, 2) for k in (0, 1)]
