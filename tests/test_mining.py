import math
import re
from collections import Counter

import pytest

from reqguard.operators import feedback as FB
from reqguard.operators import mining as MI
from reqguard.operators import rules as RU
from reqguard.config import LIVE
from pyspark.sql import functions as F


def shape(p):
    return re.sub("[a-zA-Z]+", "A", re.sub("[0-9]+", "D", p))[:512]


def vector(s):
    n = Counter(s[i:i + 3] for i in range(len(s) - 2))
    size = math.sqrt(sum(v * v for v in n.values()))
    return {g: v / size for g, v in n.items()}


def clusters(payloads, eps=0.35, need=4):
    """Density clusters by definition: sets of payload shapes; a border shape goes to the smallest core label."""
    weight = Counter(map(shape, payloads))
    shapes = sorted(s for s in weight if len(s) >= 3)
    vec = {s: vector(s) for s in shapes}
    near = {a: [b for b in shapes if sum(w * vec[b].get(g, 0) for g, w in vec[a].items()) >= 1 - eps - 1e-9] for a in shapes}
    core = {s for s in shapes if sum(weight[b] for b in near[s]) >= need}
    import hashlib
    fid = {s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16) for s in shapes}
    label = {s: fid[s] for s in core}
    changed = True
    while changed:
        changed = False
        for s in core:
            low = min(label[b] for b in near[s] if b in core)
            if low < label[s]:
                label[s], changed = low, True
    for s in shapes:
        if s not in core and any(b in core for b in near[s]):
            label[s] = min(label[b] for b in near[s] if b in core)
    return label, core, weight


@pytest.fixture(scope="module")
def pool(spark):
    import random
    rng = random.Random(11)
    marks = ["<", ">", "/", "'", "=", ";", "(", ")", "-", "?", "&", " "]
    families = ["".join(rng.choice(["a", "b1", *marks]) for _ in range(14)) for _ in range(9)]
    out = []
    for _ in range(160):
        base = list(rng.choice(families))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(marks)
        out.append("".join(base))
    return out + ["ab", "--", "unique!!"]


@pytest.mark.parametrize("tile_rows", [3, 512])
def test_clusters_equal_definition(spark, pool, tile_rows):
    label, core, weight = clusters(pool)
    df = spark.createDataFrame([(p,) for p in pool], "payload string")
    got = MI.cluster_shapes(MI.shapes(df), tile_rows=tile_rows).collect()
    assert {r["shape"]: r["cluster"] for r in got} == label
    assert {r["shape"] for r in got if r["core"]} == core
    assert all(r["weight"] == weight[r["shape"]] for r in got)
    assert len(set(label.values())) > 1 and len(core) < len(label)


def test_similar_payloads_give_one_rule(spark):
    rows = [(f"<?php echo 'attack_{c * 3}_{i:03d}'; ?>",) for i, c in enumerate("ABCDEFGHIJKLMNOP")] + [("noise words",)]
    df = spark.createDataFrame(rows, "payload string")
    mined = MI.mine_rules(df).collect()
    assert len(mined) == 1 and mined[0]["core"] == "<?php echo 'attack_" and mined[0]["cluster_size"] == 16
    made = RU.evolved_rules(MI.mine_rules(df), F.lit(0)).first()
    assert made["severity"] == "MEDIUM" and made["confidence"] == 0.7 and "payloads 16" in made["description"]
    assert all(re.search(made["pattern"], r[0]) for r in rows[:16]) and not re.search(made["pattern"], "noise words")
    assert MI.mine_rules(df.limit(5)).count() == 0


def test_cluster_core_is_the_longest_shared_text(spark):
    members = [(1, "xx shared-core yy"), (1, "a shared-core b"), (1, "1 shared-core"), (2, "abcdefgh"), (2, "zzabcdef"), (3, "long enough")]
    df = spark.createDataFrame(members, "cluster long, payload string")
    got = {r["cluster"]: r["core"] for r in MI.cluster_cores(df).collect()}
    assert got == {1: " shared-core", 3: "long enough"}
    assert MI.shared_lengths("abcab", "xabyca") == [2, 1, 2, 2, 1]


@pytest.mark.parametrize("segment", [3, 1000])
def test_dynamic_prior_equals_sliding_window(spark, segment):
    from dataclasses import replace
    hits = [i % 3 == 0 or i > 20 for i in range(40)]
    df = spark.createDataFrame([(i, i * 1_000_000, h) for i, h in enumerate(hits)], "event_id long, t_us long, is_attack boolean")
    got = {r["event_id"]: r for r in FB.dynamic_prior(df, replace(LIVE, segment_s=segment), window=5).collect()}
    for i in range(40):
        last = hits[max(0, i - 5):i]
        assert (got[i]["n"], got[i]["attacks"]) == (len(last), sum(last))
        assert got[i]["prior"] == pytest.approx((sum(last) + 1) / (len(last) + 50) if last else 0.02)


def test_threshold_tuning(spark):
    def rows(n_attack, n_normal):
        return spark.createDataFrame([(i, i, i < n_attack) for i in range(n_attack + n_normal)],
                                     "event_id long, t_us long, is_attack boolean")
    none = rows(1, 0).limit(0)
    assert FB.threshold_tuning(rows(10, 9), none).first()["block_threshold"] == 0.98
    assert FB.threshold_tuning(rows(17, 3), none).first()["block_threshold"] == pytest.approx(0.985)
    assert FB.threshold_tuning(rows(30, 0), rows(4, 0)).first()["block_threshold"] == pytest.approx(0.975)
    assert FB.threshold_tuning(rows(30, 0), rows(3, 0)).first()["block_threshold"] == 0.98


def test_evolution_gate(spark):
    rows = [(0, i, f"payload number {i % 4}") for i in range(8)] + [(700_000_000, i, "same payload over and over") for i in range(9)]
    rows += [(1_300_000_000, i, "short") for i in range(20)]
    df = spark.createDataFrame(rows, "t_us long, event_id long, payload string")
    assert [r["period_us"] for r in FB.evolution_gate(df).collect()] == [0]


def test_cores_equal_a_search_of_all_substrings(spark):
    import random
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = "".join(rng.choice("abc=%") for _ in range(rng.randint(3, 12)))
        rows += [(k, "".join(rng.choice("ab=") for _ in range(rng.randint(0, 9))) + base + "".join(rng.choice("bc%") for _ in range(rng.randint(0, 30))))
                 for _ in range(rng.randint(1, 9))]
    rows = sorted(set(rows))
    got = {r["cluster"]: r["core"] for r in MI.cluster_cores(spark.createDataFrame(rows, "cluster long, payload string"), 4).collect()}
    want = {}
    for k in range(12):
        mine = sorted((p for c, p in rows if c == k), key=len)
        found = {mine[0][i:j] for i in range(len(mine[0])) for j in range(i + 4, len(mine[0]) + 1)}
        found = {x for x in found if all(x in p for p in mine)}
        if found:
            want[k] = min(found, key=lambda x: (-len(x), x))
    assert got == want and len(want) > 5


def test_long_payloads_take_linear_time():
    import time
    text = "ab" * 20_000 + "c"
    start = time.process_time()
    assert max(MI.Substrings(text).matched("xx" + text[::-1])) == 39_999
    assert sum(MI.shared_lengths(text, text[1:])) > 0
    assert time.process_time() - start < 10
