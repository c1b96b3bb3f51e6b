"""Operator 12: against its SQL, against plain Python integers, and on odd rows."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reqguard.llm import negatives
from reqguard.llm.queries import op12_of

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows):
    """Row by row, with Python's integers."""
    kept = []
    for vec_id, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256 * x) for x in v]))
    bound = 2**63 - 1
    out = []
    for i, (a_id, a_label, a) in enumerate(kept):
        if a_id is None or a_id % 50:
            continue
        scored = sorted(((-max(-bound, min(bound, sum(x * y for x, y in zip(a, v)))), n is None, n or 0, j, lab) for j, (n, lab, v) in enumerate(kept) if j != i))
        for s, none, n, _, _ in [x for x in scored if x[4] == a_label][:5]:
            fits = [x for x in scored if x[4] != a_label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a_id, None if none else n, k, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(df):
    return sorted((tuple(r) for r in op12_of(df).select(COLUMNS).collect()), key=repr)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({entry.oracle_sql()['op12_hard_negatives']})").fetchall(), key=repr)
    assert mined(spark.read.parquet(f"{folder}/embeddings.parquet")) == want and want


@pytest.mark.parametrize("spread", [1.0, 1e5, 1e13])
def test_products_are_exact(spread):
    rng = np.random.default_rng(3)
    a, c = ((rng.normal(size=(n, 9)) * spread).round().astype(np.int64) for n in (7, 21))
    got = np.concatenate([s for _, s in negatives.tiles(a, c)])
    want = [[max(-2**63 + 1, min(2**63 - 1, sum(x * y for x, y in zip(p, q)))) for q in c.tolist()] for p in a.tolist()]
    assert got.tolist() == want


def test_one_multiplication_serves_several_candidates():
    v = np.arange(-256, 256).reshape(8, 64)
    packed = negatives.Packed.of(v, v)
    assert packed.fields == 2 and packed.packed.shape == (64, 4)
    wide = negatives.Packed.of(v.astype(object) * 10**9, v)
    assert wide.wide and wide.fields == negatives.WIDE_FIELDS and wide.packed.shape == (64, 1)


def test_integers_round_down():
    got = negatives.integers(pa.array([[0.5, -0.001], [1 / 256]], pa.list_(pa.float64())))
    assert got.tolist() == [[128, -1], [1, 0]]
    assert negatives.integers(pa.array([[1e300, -0.001]], pa.list_(pa.float64()))).tolist() == [[int(1e300) * 256, -1]]


def odd(seed, n=400):
    """Small integers in three dimensions: many ties, one vector a third of all; nulls everywhere; repeated ids and rows."""
    rng = random.Random(seed)
    rows = [(rng.choice([0, 50, 100, 150, *range(1, 300)]), rng.randint(0, 3),
             [1.0, 0.5, 0.25] if rng.random() < 0.34 else [rng.randint(-9, 9) / 16 for _ in range(3)]) for _ in range(n)]
    rows += [(50, 1, [1.0, 0.5, 0.25])] * 3
    rows += [(None, 1, [0.9, 0.4, 0.2]), (None, 2, [0.7, 0.4, 0.2]), (7, None, [1.0, 1.0, 1.0]), (8, 1, None), (9, 1, [None, 1.0, 1.0]),
             (10, 1, [float("nan"), 0.0, 0.0]), (11, 2, [float("inf"), 0.0, 0.0]), (12, 2, [1e200, 1.0, 1.0]), (13, 2, []), (200, 2, [0.5])]
    return rows


@pytest.mark.parametrize("block", [40, 32_768])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "LEAST_ROWS", block)
    monkeypatch.setattr(negatives, "MOST_ROWS", block)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", block // 4)
    monkeypatch.setattr(negatives, "TILE", 256)
    rows = odd(5)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for name in ("uid", "row", "place", "rank", "_b", "_g", "positives", "anchor_id"):
        df = df.withColumn(name, F.lit("x"))
    assert mined(df) == plain(rows)


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame(odd(1, 20), "vec_id long, label int, embedding array<double>")
    assert op12_of(df.limit(0)).count() == 0
    assert op12_of(df.filter("vec_id % 50 <> 0")).count() == 0


def test_a_third_of_the_rows_is_one_label_and_no_task_takes_it_whole(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 64)
    monkeypatch.setattr(negatives, "MOST_ROWS", 64)
    rows = spark.createDataFrame(odd(2, 1200), "vec_id long, label int, embedding array<double>")
    staged = negatives.stage(negatives.usable(rows), "t")
    counted = negatives.in_blocks(staged, staged.filter("vec_id % 50 = 0"), staged.count(), 30,
                                  lambda r, a: pa.table({"n": [r.num_rows]}), "n long").collect()
    assert max(r.n for r in counted) < 130 and sum(r.n for r in counted) == staged.count()
