"""Operator 13: the perfect hash, keyed access, and whole results against the library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reqguard.llm import token_store as ts
from reqguard.llm.queries import op13_token_store

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def plain(rows, library):
    """(doc_id, text) -> the results, with each text encoded whole. Texts of one id must be alike, as their order is not
    told here."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = encoded(library, text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def stored(docs):
    rows = ts.stored_documents(docs, WORDS).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


def keys(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64)


@settings(deadline=None)
@given(st.integers(1, 3000), st.integers(0, 9))
def test_the_hash_is_perfect_and_minimal(n, seed):
    k1, k2 = keys(n, seed)
    h = ts.PerfectHash.of(k1, k2)
    assert sorted(h(k1, k2)) == list(range(n))
    assert sum(h.sizes) < 8 * n + 200


def test_keys_that_share_a_half():
    k1, k2 = np.repeat(keys(1)[0], 500), keys(500)[1]
    assert sorted(ts.PerfectHash.of(k1, k2)(k1, k2)) == list(range(500))
    with pytest.raises(ValueError):
        ts.PerfectHash.of(np.repeat(k1, 2), np.repeat(k2, 2))


ODD = ["It's WE'LL 'Tis é É É H̱ ẖ ẗ T̈", "x\x1cy \x1d z\x85w\xa0v", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "ΑΣ ΣΑΣ. İstanbul", "日本語テキスト \U0001f642 12345",
       "A\x00B \x00 c", "", " ", "\n\t", "Word " * 4000, "X" * 5000, "naïve Café ÑANDÚ", "ＦＵＬＬ ｗｉｄｔｈ ﬁ Å K"]


def test_words_alone_give_the_ids_of_the_whole_text(library):
    e, rng = ts.WordEncoder(WORDS), random.Random(3)
    mixed = ["".join(rng.choice("aA bḆ́̈ hHtT<|>ΣÉé's9\x1c\x85-") for _ in range(60)) for _ in range(300)]
    for text, raw in zip(ODD + mixed, e.encode(ODD + mixed)):
        assert np.frombuffer(raw, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], library)
    assert sorted((tuple(r) for r in op13_token_store(spark, "/root/testdata/sf0.001").collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("shard", [3000, ts.SHARD])
def test_odd_rows(spark, library, odd_rows, monkeypatch, shard):
    monkeypatch.setattr(ts, "SHARD", shard)
    monkeypatch.setattr(ts, "PART_KEYS", 7)
    rows = [(i - 3, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (2**40, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("shard", "begin", "n", "copy", "file", "start", "ids", "here", "_k1", "_part"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert stored(docs) == plain(rows, library)
    assert stored(odd_rows) == plain([(r.doc_id, r.text) for r in odd_rows.collect()], library)


def test_no_rows(spark, no_rows):
    assert stored(no_rows) == []


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_that_a_third_of_the_rows_share_fills_many_shards(spark, library, monkeypatch, hot):
    monkeypatch.setattr(ts, "SHARD", 4000)
    monkeypatch.setattr(ts, "PART_KEYS", 50)
    rows = [(hot, f"the same id {i % 90}") for i in range(400)] + [(i + 1000 * (i % 2), f"text {i}") for i in range(8, 700)]
    store = ts.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORDS)
    assert store.files.count() > 10 and store.files.agg(F.max("n_rows")).first()[0] < 300
    found = ts.lookup(store, store.directory.select("doc_id", "copy")).collect()
    assert len(found) == len(rows)
    mine = [r for r in found if r.doc_id == hot]
    assert sorted(r.copy for r in mine) == list(range(400))
    assert [r.start for r in sorted(mine, key=lambda r: r.copy)] == sorted(r.start for r in mine)
    got = sorted(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert got == sorted(tuple(encoded(library, t)) for _, t in rows)
    last = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == last and len(r.ids) == 4 * r.n
        last += r.n


def test_keys_that_are_not_there(spark, documents):
    store = ts.write_store(documents, WORDS)
    asked = spark.createDataFrame([(i, c, "mine") for i in (0, 1, 5, -4, 10**9, None) for c in (0, 1)], "doc_id long, copy long, shard string")
    rows = ts.locate(store, asked).collect()
    assert len(rows) == 12 and {(r.doc_id, r.copy) for r in rows if r.shard is not None} == {(0, 0), (1, 0), (5, 0)}
    assert {r.doc_id for r in ts.lookup(store, asked).collect()} == {0, 1, 5}
    assert store.width == 2


def test_plain_words_from_the_model_equal_the_library(library):
    e = ts.WordEncoder(WORDS)
    assert e.direct
    letters = [chr(i) for i in range(0x250) if chr(i).isalpha()]
    words = [c for c in letters] + [f"a{c}B{d}" for c, d in zip(letters, letters[7:] + letters[:7])]
    plain = [w for w in words if e.is_plain(w)]
    assert len(plain) > 0.99 * len(words)
    assert [e.directly(w) for w in plain] == [x.ids for x in library.encode_batch(plain, add_special_tokens=False)]
