"""Identity memory against a plain replay."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import LIVE
from reqguard.operators import decisions as D
from reqguard.operators import memory as M

CFG = replace(LIVE, segment_s=60, block_rows=64)


def replay(rows, key="ip"):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["t_us"], r["event_id"])):
        s = state.setdefault(r[key], {"n": 0, "hits": [], "failed": 0, "agents": set(), "t": [], "paths": [], "gaps": [],
                                      "rep": 0, "post": 0, "dwell": []})
        hit = any(x in r["endpoint"].lower() for x in C.DECEPTIVE_ROUTES)
        if hit:
            if s["hits"]:
                last_t, last_path = s["hits"][-1]
                s["rep"] += last_path == r["endpoint"]
                if r["t_us"] - last_t < 60_000_000:
                    s["dwell"].append((r["t_us"] - last_t) / 1e6)
            s["post"] += r["method"] == "POST"
            s["hits"].append((r["t_us"], r["endpoint"]))
        s["n"] += 1
        s["failed"] += r["method"] == "POST" and "login" in r["endpoint"] and "failed" in r["payload"].lower()
        if r["user_agent"]:
            s["agents"].add(r["user_agent"])
        if s["t"]:
            s["gaps"] = (s["gaps"] + [(r["t_us"] - s["t"][-1]) / 1e6])[-49:]
        s["t"], s["paths"] = (s["t"] + [r["t_us"]])[-50:], (s["paths"] + [r["endpoint"]])[-50:]
        burst = sum(r["t_us"] - t < 10_000_000 for t in s["t"])
        ratio = len(s["hits"]) / s["n"]
        dev = 15.0 * len(s["agents"]) if len(s["agents"]) > 2 else 0
        dev += min((burst - 10) * 2.0, 40.0) if burst > 10 else 0
        dev += ratio * 50 if s["n"] > 5 and ratio > 0.2 else 0
        dev += s["failed"] * 10
        if len(s["gaps"]) > 5:
            mean = sum(s["gaps"]) / len(s["gaps"])
            var = sum((g - mean) ** 2 for g in s["gaps"]) / len(s["gaps"])
            dev += 30 if var < 0.05 and mean < 2 else 0
        intent = 15 * len(s["hits"]) + 20 * s["rep"] + 40 * s["post"]
        intent += 30 if s["dwell"] and sum(s["dwell"]) / len(s["dwell"]) < 5 else 0
        out[r["event_id"]] = {"total_requests": s["n"], "sensitive_hits": len(s["hits"]), "unique_agents": len(s["agents"]),
                              "burst_density": burst, "endpoint_diversity": len(set(s["paths"])), "n_gaps": len(s["gaps"]),
                              "deviation": min(dev, 100.0), "deception": min(float(intent), 100.0)}
    return out


@pytest.mark.parametrize("cfg", [CFG, replace(LIVE, segment_s=100_000)])
def test_memory_equals_replay(traffic, cfg):
    df, rows = traffic
    got = M.deception_intent(M.behavior_deviation(M.behavior_memory(df, cfg, "ip"))).collect()
    got = {r["event_id"]: r.asDict() for r in got}
    for i, f in replay(rows).items():
        for name, value in f.items():
            assert got[i][name] == pytest.approx(value), (i, name)


def test_regular_fast_requests_score(spark):
    rows = [(i, 1_700_000_000_000_000 + i * 1_000_000, "a", "GET", "/", 200, "x", "s", "") for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, ip string, method string, endpoint string, "
                                     "status_code long, user_agent string, session_id string, payload string")
    got = {r["event_id"]: r["deviation"] for r in M.behavior_deviation(M.behavior_memory(df, CFG, "ip")).collect()}
    assert got[5] == 0.0 and got[6] == 30.0 and got[119] == 30.0


def test_multipliers_count_strictly_earlier_severe_actions(traffic):
    df, rows = traffic
    acts = D.first_pass(df, CFG).cache()
    got = {r["event_id"]: r for r in D.multipliers(acts, CFG).collect()}
    path, fp, sig = {}, {}, {}
    for r in sorted(acts.collect(), key=lambda r: (r["t_us"], r["event_id"])):
        m = got[r["event_id"]]
        sigs = [1 + 0.15 * sig.get(s, 0) for s in r["matched"]]
        assert m["path_mult"] == pytest.approx(1 + 0.1 * path.get(r["endpoint"], 0))
        assert m["fingerprint_mult"] == pytest.approx(1 + 0.25 * fp.get(r["fingerprint"], 0))
        assert m["signature_mult"] == pytest.approx(sum(sigs) / len(sigs) if sigs else 1.0)
        assert m["repeat"] == min(100, 25 * fp.get(r["fingerprint"], 0))
        if r["action"] in C.SEVERE_ACTIONS:
            path[r["endpoint"]] = path.get(r["endpoint"], 0) + 1
            fp[r["fingerprint"]] = fp.get(r["fingerprint"], 0) + 1
            for s in r["matched"]:
                sig[s] = sig.get(s, 0) + 1


def test_fingerprint_confidence(spark):
    rows = [(i, i, ip, "GET", "/", "ua", "") for i, ip in enumerate(["a", "a", "b", "a", "c", "d", "e", "f"])]
    df = spark.createDataFrame(rows, "event_id long, t_us long, ip string, method string, endpoint string, "
                                     "user_agent string, payload string")
    got = sorted((r["event_id"], r["ips_seen"], r["confidence"]) for r in M.fingerprints(df, CFG).collect())
    assert [x[1] for x in got] == [1, 1, 2, 2, 3, 4, 5, 6]
    assert [x[2] for x in got] == pytest.approx([0.5, 0.5, 0.7, 0.7, 0.8, 0.9, 1.0, 1.0])


def one_by_one(rows):
    """Decisions one after the other, with Python's own counters."""
    counts, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["t_us"], r["event_id"])):
        n = [counts.get(("path", r["endpoint"]), 0), counts.get(("fingerprint", r["fingerprint"]), 0)]
        sig = 1 + sum(counts.get(("signature", s), 0) for s in r["matched"]) * 0.15 / len(r["matched"]) if r["matched"] else 1.0
        path, actor = 1 + 0.1 * n[0], 1 + 0.25 * n[1]
        dev, ml, sg, dec, rep = r["deviation"] * actor, r["anomaly"] * actor, r["signature_score"] * sig, r["deception"] * path, min(100.0, 25.0 * n[1])
        total = 0.15 * dev + 0.2 * 100 * ml + 0.1 * rep + 0.3 * sg + 0.25 * dec
        action = ("block" if sg > 90 else "deception_flag" if dec > 80 else "block" if total > 85 else "quarantine" if total > 70
                  else "throttle" if total > 50 else "shadow_monitor" if ml * 100 > 75 or dev > 70 else "allow")
        out[r["event_id"]] = action, total, rep
        if action in ("block", "deception_flag", "quarantine"):
            for k in [("path", r["endpoint"]), ("fingerprint", r["fingerprint"]), *(("signature", s) for s in r["matched"])]:
                counts[k] = counts.get(k, 0) + 1
    return out


def test_feedback_equals_a_replay(traffic):
    df, _ = traffic
    acts = D.first_pass(df, CFG).cache()
    got = {r["event_id"]: r for r in D.with_feedback(acts, CFG).collect()}
    want = one_by_one([r.asDict() for r in acts.collect()])
    assert len(got) == len(want)
    for e, (action, total, rep) in want.items():
        assert (got[e]["action"], got[e]["repeat"]) == (action, rep) and got[e]["total_risk"] == pytest.approx(total, abs=1e-6)


def test_feedback_follows_a_chain_of_actions(spark):
    """Each action turns severe only through the one before it, so every round finds one more."""
    n = 6
    rows = [(i, i, f"/p{i // 2}", f"f{(i + 1) // 2}", [], 0.0, 0.0, 0.0, 81.0 if i == 0 else 75.0 if i % 2 else 65.0, 300.0 if i % 2 == 0 and i else 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id long, t_us long, endpoint string, fingerprint string, matched array<string>, signature_score double, "
                                     "anomaly double, unused double, deception double, deviation double")
    acts = D.decide(df.withColumn("repeat", F.lit(0.0))).cache()
    want = one_by_one([r.asDict() for r in acts.collect()])
    assert {r["event_id"]: r["action"] for r in D.with_feedback(acts, CFG).collect()} == {e: a for e, (a, _, _) in want.items()}
    first = {r["event_id"]: r["action"] for r in acts.collect()}
    assert sum(first[e] != a for e, (a, _, _) in want.items()) >= 3
