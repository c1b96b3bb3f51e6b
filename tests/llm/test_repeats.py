import hashlib
import random

import numpy as np
from brute import repeats

from reqguard.llm import suffixes


def digest(rows):
    out = []
    for i, b, gone in repeats(rows):
        kept = bytes(c for p, c in enumerate(b) if p not in gone)
        spans = sum(1 for p in gone if p - 1 not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in suffixes.removed_repeats(df).collect())


def test_documents_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got(documents) == digest(rows)


def test_short_alphabets_copies_and_periodic_texts(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab \x00é") for _ in range(400))
    rows = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 30))) + base[rng.randint(0, 200):][:rng.randint(40, 200)]) for i in range(60)]
    rows += [(100 + i, "ab" * rng.randint(10, 120)) for i in range(12)] + [(200 + i, base) for i in range(30)]
    rows += [(300, "x" * 49), (301, "x" * 49), (302, "x" * 50), (303, "x" * 51), (304, None)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == digest(rows)


def test_groups_go_on_across_batches(spark):
    """One passage in thousands of documents, with small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        passage = "this passage of many words stands in every one of these documents and is cut out of all but one"
        rows = [(i, f"{i} {i * 7919} begins {passage} ends {i * 31}") for i in range(3000)]
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == digest(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_go_on_across_partitions(spark, monkeypatch):
    """Passages in many documents with different bytes around them, in partitions of a few KB."""
    monkeypatch.setattr(suffixes, "PART_BYTES", 2048)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [word(90), word(60), word(51)]
    rows = [(i, word(rng.randint(0, 40)) + rng.choice(passages) + word(rng.randint(0, 40))) for i in range(900)]
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == digest(rows)


def test_odd_rows(odd_rows, no_rows):
    rows = [(2**63 - 1 if r.doc_id is None else r.doc_id, r.text) for r in odd_rows.collect()]
    want = [(None if i == 2**63 - 1 else i, *rest) for i, *rest in digest(rows)]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in suffixes.removed_repeats(odd_rows).collect()), key=key) == sorted(want, key=key)
    assert suffixes.removed_repeats(no_rows).count() == 0
    left = suffixes.without_repeats(odd_rows)
    assert left.columns == odd_rows.columns and left.filter("text IS NULL").count() == 0


def test_a_frequent_gram_is_two_rows_per_chunk():
    key, ids, suffix = np.array([7, 7, 7, 9, 5, 5]), np.array([3, 1, 3, 1, 2, 2]), np.arange(6)
    k, i, s = suffixes.spread_known(key, ids, suffix)
    assert sorted(zip(k[s == -1], i[s == -1])) == [(7, 1), (7, 3)]
    assert (k[:3] >= suffixes.KNOWN).all() and k[3:6].tolist() == [9, 5, 5] and s[:6].tolist() == list(range(6))
