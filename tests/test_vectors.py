import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqguard.config import LIVE
from reqguard.operators import forest as IF
from reqguard.operators import graph
from reqguard.operators import vectors as V


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    x = np.vstack([b + rng.normal(scale=0.15, size=(12, 8)) for b in base] + [np.tile(base[0], (20, 1))])
    rows = [(f"ip{i:03d}", i, i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "ip string, t_us long, event_id long, vec array<double>"), x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("tile_rows", [4, 1000])
def test_correlate_equals_all_pairs(cloud, tile_rows):
    df, x = cloud
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = {r["ip"]: r for r in V.correlate(V.latest_vectors(df), 0.95, tile_rows).collect()}
    assert len(got) == len(x)
    for i in range(len(x)):
        assert got[f"ip{i:03d}"]["max_similarity"] == pytest.approx(max(s[i].max(), 0))
        assert got[f"ip{i:03d}"]["peers"] == (s[i] > 0.95).sum()


@pytest.mark.parametrize("tile_rows", [3, 1000])
def test_campaigns_are_the_connected_groups(cloud, tile_rows):
    df, x = cloud
    near = x @ x.T > 0.97
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    sizes = np.bincount(label)
    got = {r["ip"]: r["campaign"] for r in V.campaigns(V.latest_vectors(df), 0.97, tile_rows).collect()}
    assert got == {f"ip{i:03d}": f"ip{label[i]:03d}" for i in range(len(x)) if sizes[label[i]] > 1}


def test_latest_vector_and_window(spark):
    df = spark.createDataFrame([("a", 1, 1, [1.0, 0.0]), ("a", 5, 2, [0.0, 2.0]), ("b", 3, 3, [3.0, 0.0])],
                               "ip string, t_us long, event_id long, vec array<double>")
    got = {r["ip"]: r["vec"] for r in V.latest_vectors(df, 6, 2).collect()}
    assert got == {"a": pytest.approx([0.0, 1.0])}


def test_memory_cap_query_and_removal(spark):
    new = spark.createDataFrame([(i, [float(i == j) for j in range(6)], i) for i in range(6)],
                                "entry_id long, vec array<double>, stored_us long")
    memory = V.memorize(new.limit(0), new, cap=4).cache()
    assert sorted(r["entry_id"] for r in memory.collect()) == [2, 3, 4, 5]
    q = spark.createDataFrame([(10, [0.0, 0.0, 9.0, 1.0, 0.0, 0.0]), (11, [0.0, 0.0, 0.0, 0.0, 0.01, 5.0])], "event_id long, vec array<double>")
    got = {r["event_id"]: (r["entry_id"], r["similarity"]) for r in V.top1(q, memory).collect()}
    assert got[10] == (2, pytest.approx(9 / 82 ** 0.5)) and got[11][0] == 5
    assert sorted(r["entry_id"] for r in V.remove(memory, q).collect()) == [3, 4]
    assert [r["similarity"] for r in V.top1(q, memory.limit(0)).collect()] == [0.0, 0.0]


def test_embedding_is_a_unit_vector_with_lexical_part(spark):
    from reqguard.operators.vectors import lexical
    df = spark.createDataFrame([("abab",), ("",), ("A",)], "payload string")
    got = [r[0] for r in df.select(lexical(F.col("payload"))).collect()]
    assert max(got[0]) == 1.0 and sorted(set(got[0])) == [0.0, 0.5, 1.0]
    assert got[1] == [0.0] * 52 and got[2] == [0.0] * 52


def test_components_of_chains_and_rings(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 100: 100, 101: 100, 102: 100}


def test_forest_finds_outliers_whatever_the_partitioning(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(600, 4)), rng.normal(size=(6, 4)) + 9])
    df = spark.createDataFrame([(i, i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, t_us long, x array<double>")
    a, b = (IF.fit(d, trees=60, contamination=0.02) for d in (df.repartition(1), df.repartition(16)))
    assert a.offset == b.offset and (a.threshold == b.threshold).all()
    rows = IF.telemetry_anomaly(IF.decision(df, a)).orderBy(F.desc("anomaly")).collect()
    assert {r["id"] for r in rows[:6]} == set(range(600, 606))
    assert all(r["is_anomaly"] and r["label"] == "ANOMALY" and r["anomaly"] > 0.5 for r in rows[:6])
    assert 8 <= sum(r["is_anomaly"] for r in rows) <= 16
    assert IF.fit_telemetry(df.limit(99)) is None


def timed_vectors(rng, n):
    """Few directions, so that vectors repeat and similarities tie; equal times; one actor with a third of the rows."""
    base = [[float(rng.randint(0, 3)) for _ in range(4)] for _ in range(25)]
    return [(i, f"a{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}", rng.randint(0, 60), rng.choice(base)) for i in range(n)]


def cosine(a, b):
    unit = [[x / (math.sqrt(sum(y * y for y in v)) + 1e-12) for x in v] for v in (a, b)]
    return sum(x * y for x, y in zip(*unit))


@pytest.mark.parametrize("tile", [3, 4096])
def test_memory_holds_only_what_was_stored_before(spark, tile):
    rows = timed_vectors(random.Random(2), 150)
    df = spark.createDataFrame(rows, "event_id long, ip string, t_us long, vec array<double>")
    stored = [r for r in rows if r[0] % 3 == 0]
    memory = V.memorize(df.limit(0).selectExpr("event_id AS entry_id", "vec", "t_us AS stored_us"),
                        df.filter("event_id % 3 = 0").selectExpr("event_id AS entry_id", "vec", "t_us AS stored_us"))
    got = {r["event_id"]: r for r in V.top1_before(df, memory, LIVE, tile=tile).collect()}
    assert len(got) == len(rows)
    for e, _, t, v in rows:
        earlier = [cosine(v, m[3]) for m in stored if (m[2], m[0]) < (t, e)]
        assert got[e]["similarity"] == pytest.approx(max(earlier, default=0.0))
        assert (got[e]["entry_id"] is None) == (not earlier)
        if earlier:
            entry = next(m for m in stored if m[0] == got[e]["entry_id"])
            assert (entry[2], entry[0]) < (t, e) and cosine(v, entry[3]) == pytest.approx(max(earlier))
    assert {r["similarity"] for r in V.top1_before(df, memory.limit(0), LIVE).collect()} == {0.0}


@pytest.mark.parametrize("tile", [3, 2048])
@pytest.mark.parametrize("window", [5, 1000])
def test_correlation_sees_only_what_stood_before(spark, tile, window):
    rows = timed_vectors(random.Random(3), 150)
    df = spark.createDataFrame(rows, "event_id long, ip string, t_us long, vec array<double>")
    got = {r["event_id"]: r["max_similarity"] for r in V.correlate_before(df, window, LIVE, tile).collect()}
    assert len(got) == len(rows)
    for e, ip, t, v in rows:
        last = {}
        for m in sorted(rows, key=lambda m: (m[2], m[0])):
            if (m[2], m[0]) < (t, e) and m[1] != ip:
                last[m[1]] = m
        want = max([cosine(v, m[3]) for m in last.values() if m[2] >= t - window], default=0.0)
        assert got[e] == pytest.approx(want)


def test_far_cells_do_not_meet(spark):
    """Tight groups in many directions: most pairs of cells are ruled out, and the results are those of all pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 6))
    x = np.vstack([b / np.linalg.norm(b) + rng.normal(scale=0.02, size=(20, 6)) for b in base] + [rng.normal(size=(5, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"ip{i:03d}", i, i, [float(v) for v in r]) for i, r in enumerate(x)], "ip string, t_us long, event_id long, vec array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = {r["ip"]: r for r in V.correlate(V.latest_vectors(df), 0.95, 10).collect()}
    for i in range(len(x)):
        assert got[f"ip{i:03d}"]["max_similarity"] == pytest.approx(max(s[i].max(), 0))
        assert got[f"ip{i:03d}"]["peers"] == (s[i] > 0.95).sum()
    rows = V.latest_vectors(df).select(F.xxhash64("ip").alias("vid"), "vec", F.lit(1).alias("n"), F.lit(0).alias("g"))
    placed, between, radius, first = V.in_cells(rows, 10)
    wanted = V.least_angles(between, radius) <= np.arccos(0.95)
    assert first[-1] >= len(x) // 10 and wanted.mean() < 0.5
    met = V.meetings(placed, first, wanted).count()
    assert met < 0.5 * len(x) * first[-1]
    cell = {r["vid"]: r["cell"] for r in placed.collect()}
    ids = [r["vid"] for r in rows.orderBy("vid").collect()]
    at = {r["vid"]: np.array(r["vec"]) for r in placed.collect()}
    bound = V.least_angles(between, radius)
    for a in ids[::7]:
        for b in ids[::5]:
            assert np.arccos(np.clip(at[a] @ at[b], -1, 1)) >= bound[cell[a], cell[b]] - 1e-6


def test_vectors_go_to_a_bounded_number_of_bins(spark):
    """All cells are near each other: each vector meets all others, but is sent to few bins, not to each of many tiles."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 5)) + 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"ip{i:03d}", i, i, [float(v) for v in r]) for i, r in enumerate(x)], "ip string, t_us long, event_id long, vec array<double>")
    rows = V.latest_vectors(df).select(F.xxhash64("ip").alias("vid"), "vec", F.lit(1).alias("n"), F.lit(0).alias("g"))
    placed, between, radius, first = V.in_cells(rows, 5)
    bins = V.in_bins(placed, int(first[-1]), 5)
    assert first[-1] >= 120 and len(set(bins)) <= V.BINS + 1 and (np.diff(bins) >= 0).all()
    assert V.meetings(placed, first, np.ones_like(between, dtype=bool), bins).count() <= len(x) * (V.BINS + 1)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = {r["ip"]: r for r in V.correlate(V.latest_vectors(df), 0.5, 5).collect()}
    for i in range(len(x)):
        assert got[f"ip{i:03d}"]["max_similarity"] == pytest.approx(s[i].max()) and got[f"ip{i:03d}"]["peers"] == (s[i] > 0.5).sum()


def test_timelines_are_cut_into_a_bounded_number_of_blocks(spark, monkeypatch):
    """Rows that are compared in time go to few blocks and tiles, however small the least size of one is."""
    assert [V.bin_rows(n, 4) for n in (0, 96, 240, 10 ** 9)] == [4, 4, 10, V.BIN_ROWS]
    rows = timed_vectors(random.Random(5), 400)
    df = spark.createDataFrame(rows, "event_id long, ip string, t_us long, vec array<double>")
    sent_rows, group = [], type(df).groupBy

    def counted(self, *names):
        if names == ("_block", "_tile"):
            sent_rows.append(self.count())
        return group(self, *names)

    monkeypatch.setattr(type(df), "groupBy", counted)
    V.correlate_before(df, 1000, LIVE, 2)
    memory = df.selectExpr("event_id AS entry_id", "vec", "t_us AS stored_us")
    V.top1_before(df, V.memorize(memory.limit(0), memory), LIVE, tile=2)
    assert len(sent_rows) == 4 and max(sent_rows) <= len(rows) * (V.BLOCKS + 1)
    assert sent_rows[1] <= len(rows) + 7 * (V.BLOCKS + 1)  # a vector of each actor stands where a block begins


def brute_similar(q, v, place, start, until, mine, theirs):
    s = q @ v.T
    out = (start[None] >= place[:, None]) | (place[:, None] > until[None])
    s[out if mine is None else out | (mine[:, None] == theirs[None])] = -np.inf
    return s


@pytest.mark.parametrize("actors", [None, 40])
@pytest.mark.parametrize("spread", [0.02, 5.0])
def test_a_block_meets_few_vectors_of_a_tile(monkeypatch, actors, spread):
    """The results are those of all pairs: with zeros, copies, vectors alone, places at which nothing stands; where vectors
    lie in groups, most pairs are ruled out."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 9))
    x = base[rng.integers(0, 60, 6000)] + rng.normal(scale=spread, size=(6000, 9))
    x[::50], x[1::40] = 0.0, x[0::40][:len(x[1::40])]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    q, v = x[:2500], x[2500:]
    place, start = rng.integers(0, 400, len(q)), rng.integers(5, 380, len(v))
    until = start + rng.integers(0, 300, len(v))
    mine, theirs = (None, None) if actors is None else (rng.integers(0, actors, len(q)), rng.integers(0, actors, len(v)))
    met, plain = [], V.similarities
    monkeypatch.setattr(V, "similarities", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    best, found = V.most_similar(q, v, place, start, until, mine, theirs)
    want = brute_similar(q, v, place, start, until, mine, theirs)
    none = ~np.isfinite(want.max(axis=1))
    assert 0 < none.sum() < 200 and (found[none] == -1).all() and np.isneginf(best[none]).all()
    assert np.allclose(best[~none], want.max(axis=1)[~none], rtol=0, atol=1e-12)
    assert np.allclose(want[~none, found[~none]], best[~none], rtol=0, atol=1e-12)
    if spread < 1:
        assert sum(met) < 0.3 * want.size


def test_of_equal_similarities_the_first_row_counts():
    v = np.tile(np.eye(4), (100, 1))
    best, found = V.most_similar(np.eye(4), v, np.full(4, 9), np.where(np.arange(400) < 40, 9, 0), np.full(400, 9))
    assert best.tolist() == [1.0] * 4 and found.tolist() == [40, 41, 42, 43]


def test_evidence_computes_the_features_once(traffic, monkeypatch):
    from reqguard.plans import queries as Q
    calls, whole = [], Q.FT.features
    monkeypatch.setattr(Q.FT, "features", lambda *a, **k: calls.append(1) or whole(*a, **k))
    df, rows = traffic
    got = Q.bayes_fusion(df).collect()
    assert len(calls) == 1
    assert sorted(r["event_id"] for r in got) == [r["event_id"] for r in rows]
    assert {r["memory_sim"] for r in got if r["event_id"] == rows[0]["event_id"]} == {0.0}
    assert max(r["correlation"] for r in got) > 0.9 and max(r["memory_sim"] for r in got) > 0.9
