import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reqguard.operators import feedback as FB
from reqguard.operators import respond as RS
from reqguard.operators import rules as RU
from reqguard.config import LIVE
from reqguard.sources.schemas import BLOCK_OPS, RULES

S = 1_000_000


def rule(i, name, pattern, action="BLOCK", active=True, kind="PAYLOAD", expires=None, severity="HIGH", auto=False):
    return (i, name, kind, pattern, action, severity, active, 0, 0.5, 0, expires, auto, "")


def test_rule_match_skips_broken_inactive_and_other_rules(spark, monkeypatch):
    monkeypatch.setattr(RU, "MATCH_BATCH", 2)
    rules = spark.createDataFrame([
        rule(1, "flag", "cat", "FLAG"), rule(2, "broken", "(unclosed"), rule(3, "off", "cat", active=False),
        rule(4, "rate", "cat", kind="RATE"), rule(5, "empty", ""), rule(6, "caps", "SELECT"), rule(7, "all", ".")], RULES)
    df = spark.createDataFrame(list(enumerate(["a cat", "Select", "", "\n"])), "event_id long, payload string")
    got = [(r["matched_rules"], r["blocked"]) for r in RU.rule_match(df, rules).orderBy("event_id").collect()]
    assert got == [(["all", "flag"], True), (["all", "caps"], True), ([], False), ([], False)]


def test_seeding_expiry_and_order(spark):
    rules = spark.createDataFrame([rule(9, "Path Traversal", "x"), rule(10, "old", "x", expires=5), rule(11, "edge", "x", expires=6)], RULES)
    seeded = RU.seed_rules(rules)
    assert seeded.count() == 7 and seeded.filter("rule_name = 'Path Traversal'").first()["pattern"] == "x"
    live, gone = RU.expire_rules(seeded, F.lit(6))
    assert [r["rule_name"] for r in gone.collect()] == ["old"] and live.count() == 6
    order = [r["severity"] for r in RU.active_rules(seeded).collect()]
    assert order == sorted(order, reverse=True) and order[0] == "MEDIUM"


def test_effectiveness_and_confidence(spark):
    rules = spark.createDataFrame([rule(1, "a", "x"), rule(2, "b", "x")], RULES)
    outcomes = spark.createDataFrame([("a", True, 1), ("a", True, 2), ("a", False, 3), ("zz", True, 4)],
                                     "rule_name string, is_true_positive boolean, t_us long")
    eff = RU.rule_effectiveness(rules, outcomes)
    row = eff.first()
    assert eff.count() == 1 and (row["true_positives"], row["false_positives"]) == (2, 1)
    assert row["effectiveness"] == pytest.approx(0.6)
    assert {r["rule_name"]: r["confidence"] for r in RU.with_confidence(rules, eff).collect()} == {"a": pytest.approx(0.6), "b": 0.5}


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_signature_confidence_clamps_at_every_change(spark, block, monkeypatch):
    monkeypatch.setattr(RU, "FAN", 2)
    deltas = [0.3, 0.4, -0.2, 0.5, -0.9, -0.4, 0.25, 0.1, -0.05]
    df = spark.createDataFrame([("s", i, i, d) for i, d in enumerate(deltas)] + [("q", 3, 99, 0.9)],
                               "signature string, t_us long, event_id long, delta double")
    x = 0.5
    for d in deltas:
        x = max(0.0, min(1.0, x + d))
    got = {r["signature"]: r["confidence"] for r in RU.signature_confidence(df, replace(LIVE, block_rows=block)).collect()}
    assert got == {"s": pytest.approx(x), "q": 1.0}


def test_behavior_rules_once_per_actor(spark):
    names = "key string, event_id long, t_us long, score double, login_failures long, burst_detected boolean, " \
            "acceleration double, scan_pattern boolean, unique_endpoints long, enumeration_detected boolean"
    rows = [("a", 1, 10, 49.9, 6, True, 9.0, True, 20, True), ("a", 2, 20, 50.0, 6, False, 5.0, False, 12, False),
            ("a", 3, 30, 80.0, 9, False, 5.1, False, 13, True), ("b", 4, 40, 80.0, 5, False, 1.0, True, 1, False)]
    got = {(r["kind"], r["key"]): r["event_id"] for r in RU.behavior_rules(spark.createDataFrame(rows, names)).collect()}
    assert got == {("BRUTE_FORCE", "a"): 2, ("BURST", "a"): 3, ("SCAN", "a"): 3, ("ENUM", "a"): 3, ("SCAN", "b"): 4}


def ops(spark, rows):
    return spark.createDataFrame([(ip, op, "", t, i, exp, perm, 0.0) for i, (ip, op, t, exp, perm) in enumerate(rows)], BLOCK_OPS)


def test_state_in_force_at_each_request(spark):
    log = ops(spark, [("a", "block", 100, 200, False), ("a", "unblock", 150, None, False), ("a", "block", 160, 170, False),
                      ("b", "block", 100, None, False), ("c", "block", 100, 110, True), ("d", "block", 100, 300, False)])
    times = [("a", 99), ("a", 101), ("a", 151), ("a", 165), ("a", 170), ("a", 171), ("b", 10 ** 9), ("c", 10 ** 9), ("d", 99), ("e", 5)]
    reqs = spark.createDataFrame([(ip, t, 1000 + i) for i, (ip, t) in enumerate(times)], "ip string, t_us long, event_id long")
    got = {r["event_id"] - 1000: r["is_blocked"] for r in RS.state_in_force(reqs, log, LIVE).collect()}
    assert [got[i] for i in range(len(times))] == [False, True, False, True, True, False, True, True, False, False]


def test_block_holds_at_its_end_but_is_not_listed(spark):
    blocks = ops(spark, [("a", "block", 1, 50, False), ("b", "block", 1, None, True), ("c", "block", 1, None, False)])
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ip string")
    assert {r["ip"]: r["is_blocked"] for r in RS.is_blocked(keys, blocks, F.lit(50)).collect()} == {
        "a": True, "b": True, "c": True, "d": False}
    assert [r["ip"] for r in RS.active_blocks(blocks, F.lit(50)).collect()] == ["b"]
    assert not RS.is_blocked(keys, blocks, F.lit(51)).filter("ip = 'a' and is_blocked").count()


def test_response_table(spark):
    names = "event_id long, t_us long, endpoint string, fingerprint string, anomaly double, repeat double, action string, " \
            "matched array<string>"
    rows = [(1, 0, "/admin", "f", 0.0, 0.0, "block", []), (2, 1, "/login", "f", 0.0, 25.0, "throttle", ["XSS"]),
            (3, 2, "/config", "g", 0.95, 0.0, "allow", []), (4, 3, "/x", "h", 0.0, 0.0, "quarantine", ["SQLi"]),
            (5, 4, "/api/x", "h", 0.8, 5.0, "deception_flag", [])]
    out = RS.response_actions(spark.createDataFrame(rows, names))
    got = {r["event_id"]: r for r in out.collect()}
    assert got[1]["responses"] == ["temporary_route_lock(/admin)", "emergency_maintenance_banner"]
    assert got[2]["responses"] == ["temporary_route_lock(/login)", "login_throttle", "payload_sanitize_mode", "fingerprint_quarantine"]
    assert got[3]["responses"] == ["temporary_route_lock(/config)", "emergency_maintenance_banner", "payload_sanitize_mode",
                                   "secret_rotation", "deception_intensify"]
    assert got[4]["responses"] == ["fingerprint_quarantine"]
    assert got[5]["responses"] == ["secret_rotation", "deception_intensify"]
    assert got[2]["until_us"] == 1 + 1050 * S and got[2]["throttle_until_us"] == 1 + 1050 * S
    state = {(r["what"], r["item"]): r["n"] for r in RS.healing_state(out, F.lit(2 + 300 * S)).collect()}
    assert state == {("locked_route", "/login"): 1, ("throttled", "f"): 1, ("sanitize_mode", ""): 2, ("quarantined", "f"): 1,
                     ("quarantined", "h"): 1, ("secret_version", ""): 3, ("deception_mode", ""): 2}


def in_force_rules(rng, n):
    """Rules of three patterns with lives that overlap, touch, never end, or end before they begin."""
    rows = []
    for i in range(n):
        born = rng.choice([None, rng.randint(0, 60)])
        gone = rng.choice([None, rng.randint(0, 90), (born or 0) + 10])
        rows.append((i, f"r{i}", rng.choice(["PAYLOAD"] * 5 + ["RATE"]), rng.choice(["cat", "dog", "c"]), rng.choice(["BLOCK", "FLAG"]), "HIGH",
                     rng.random() < 0.9, 0, 0.5, born, gone, True, ""))
    return rows


def lives_at(r, t):
    return r[2] == "PAYLOAD" and r[6] and (r[9] is None or r[9] <= t) and (r[10] is None or t < r[10])


@pytest.mark.parametrize("segment_s", [1e-6, 7e-6, 1])
def test_rules_count_while_they_are_in_force(spark, segment_s):
    rng = random.Random(4)
    rules = in_force_rules(rng, 40)
    requests = [(i, rng.randint(0, 100), rng.choice(["a cat", "dog", "cat and dog", "c", "x", ""]), rng.random() < 0.5) for i in range(300)]
    requests += [(1000 + i, 50, "cat", True) for i in range(300)]  # many requests at one moment
    table = spark.createDataFrame(rules, RULES)
    df = spark.createDataFrame(requests, "event_id long, t_us long, payload string, bad boolean")
    cfg = replace(LIVE, segment_s=segment_s)
    got = {r["event_id"]: r for r in RU.rules_at_requests(df, table, cfg).collect()}
    sets = {}
    for r in RU.rule_sets(table).collect():
        sets.setdefault(r["rule_set"], []).append(r["rule_name"])
    assert len(got) == len(requests)
    counts = {}
    for e, t, payload, bad in requests:
        want = [r for r in rules if lives_at(r, t) and payload and r[3] in payload]
        assert (got[e]["n_rules"], got[e]["blocked"]) == (len(want), any(r[4] == "BLOCK" for r in want))
        assert sorted(n for s in got[e]["rule_sets"] for n in sets[s]) == sorted(r[1] for r in want)
        for r in want:
            tp, fp, last = counts.get(r[1], (0, 0, -1))
            counts[r[1]] = (tp + bad, fp + (not bad), max(last, t))
    hits = RU.pattern_hits(df, table, "event_id", "t_us", "bad").withColumnRenamed("bad", "is_true_positive")
    eff = {r["rule_name"]: r for r in RU.effectiveness_in_force(table, hits, cfg).collect()}
    assert {k: (r["true_positives"], r["false_positives"], r["last_us"]) for k, r in eff.items()} == counts
    assert all(r["effectiveness"] == pytest.approx((r["true_positives"] + 1) / (r["true_positives"] + r["false_positives"] + 2)) for r in eff.values())


def test_a_hit_gives_one_row_however_many_rules_share_its_pattern(spark):
    table = spark.createDataFrame([rule(i, f"r{i}", "cat") for i in range(500)], RULES)
    df = spark.createDataFrame([(i, i, "cat") for i in range(100)], "event_id long, t_us long, payload string")
    hits = RU.pattern_hits(df, table, "event_id", "t_us")
    rows = RU.hits_in_force(hits, table, LIVE).collect()
    assert len(rows) == 100 and {r["n_rules"] for r in rows} == {500}


def test_no_rules_and_no_requests(spark):
    df = spark.createDataFrame([(1, 1, "cat")], "event_id long, t_us long, payload string")
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in RU.rules_at_requests(df, none, LIVE).collect()] == [(1, 0, False, [])]
    assert RU.rules_at_requests(df.limit(0), none, LIVE).count() == 0 and RU.rule_sets(none).count() == 0


def test_healing_log_keeps_the_whole_pattern(spark):
    rows = spark.createDataFrame([("XSS", "k", 1, 5, "n", "PAYLOAD", "p" * 200)], "kind string, key string, event_id long, t_us long, rule_name string, rule_type string, pattern string")
    assert RU.healing_log(rows).first()["pattern_detected"] == "p" * 200


def test_corrections_equal_a_recomputation(spark):
    rng = random.Random(9)
    rules = spark.createDataFrame(in_force_rules(rng, 15), RULES)
    rows = [(i, rng.randint(0, 80), rng.choice(["cat", "dog", "c", ""]), rng.random() < 0.4) for i in range(400)]
    flips = {i: rng.random() < 0.5 for i in rng.sample(range(400), 120)}
    outcomes = spark.createDataFrame(rows, "event_id long, t_us long, payload string, is_attack boolean")
    feedback = spark.createDataFrame([*flips.items(), (9999, True)], "event_id long, was_attack boolean")
    fixed = spark.createDataFrame([(e, t, p, flips.get(e, a)) for e, t, p, a in rows], outcomes.schema)
    changes = FB.retractions(outcomes, feedback)
    hits = RU.pattern_hits(outcomes, rules, "event_id", "t_us")

    def judged(table):
        return hits.join(table.select("event_id", F.col("is_attack").alias("is_true_positive")), "event_id")

    def as_dict(df, *cols):
        return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}

    assert as_dict(FB.corrected_labels(FB.label_counts(outcomes), changes), "is_attack", "n") == as_dict(FB.label_counts(fixed), "is_attack", "n")
    counts = RU.counts_in_force(rules, judged(outcomes).withColumn("step", F.lit(1)), LIVE)
    cols = ("rule_name", "true_positives", "false_positives", "last_us", "effectiveness")
    assert as_dict(FB.corrected_effectiveness(counts, hits, changes, rules, LIVE), *cols) == as_dict(RU.effectiveness_in_force(rules, judged(fixed), LIVE), *cols)
    entries = outcomes.filter("is_attack").select(F.col("event_id").alias("entry_id"))
    assert {r[0] for r in FB.corrected_memory(entries, changes).collect()} == {r[0] for r in fixed.filter("is_attack").select("event_id").collect()}
    got = FB.corrected_prior(FB.prior_state(outcomes, 150), changes).first()
    last = sorted(((t, e, flips.get(e, a)) for e, t, p, a in rows))[-150:]
    assert (got["n"], got["attacks"]) == (150, sum(a for _, _, a in last)) and got["prior"] == pytest.approx((got["attacks"] + 1) / 200)
