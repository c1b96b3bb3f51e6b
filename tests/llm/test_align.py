"""Operator 11: the galloping intersection, and whole results against the libraries on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reqguard.llm import align
from reqguard.llm.queries import op11_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def pair():
    return align.Tokenizers(A, B)


def plain(rows):
    """(doc_id, text) -> the results, each text encoded whole and the ends compared as sets."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {v: k for k, v in align.byte_alphabet().items()}
    assert sorted(letters) == list(range(256))
    of_byte = align.byte_alphabet()
    aligned, counts = [], Counter()
    for doc_id, text in rows:
        groups, links, n = [], [], (0, 0)
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            in_a = [bytes(of_byte[c] for c in t) for t in x.tokens]
            in_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            raw = (" " + text).encode()
            if b"".join(in_a) == raw and b"".join(in_b) == raw:
                n = len(x.ids), len(y)
                ends = [{}, {}]
                for k, parts in enumerate((in_a, in_b)):
                    at = 0
                    for i, p in enumerate(parts):
                        at += len(p)
                        ends[k][at] = i
                i0 = j0 = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    i, j = ends[0][e], ends[1][e]
                    groups.append(",".join(map(str, x.ids[i0:i + 1])) + "|" + ",".join(map(str, y[j0:j + 1])))
                    links.append((x.ids[i], y[j]))
                    i0, j0 = i + 1, j + 1
        counts.update(links)
        aligned.append((doc_id, n, groups, links))
    highest = Counter()
    for (_, y), k in counts.items():
        highest[y] = max(highest[y], k)
    return sorted(((d, *n, len(g), len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if n[0] else "") for d, n, g, ls in aligned), key=repr)


def digests(docs, pair):
    return sorted((tuple(r) for r in align.alignment_digests(docs, pair).select("doc_id", *NAMES).collect()), key=repr)


@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True))
def test_galloping_finds_what_both_have(a, b):
    a, b = sorted(a), sorted(b)
    assert align.common_ends(a, b) == [(a.index(x), b.index(x)) for x in a if x in set(b)]


def test_galloping_skips_in_few_steps():
    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    long = Counted(range(100_000))
    assert align.galloping([5, 70_000, 99_999], long) == [(0, 5), (1, 70_000), (2, 99_999)]
    assert Counted.reads < 120


def test_pairs_that_can_end_together(pair):
    n = len(pair.b_bytes)
    pairs = pair.pairs()
    assert len(pairs) == len(set(pairs.tolist())) <= sum(map(len, pair.a_bytes)) + 2 * sum(map(len, pair.b_bytes))
    for x in random.Random(1).sample(pairs.tolist(), 500):
        a, b = pair.a_bytes[x // n], pair.b_bytes[x % n]
        assert a.endswith(b) or b.endswith(a)


def test_a_table_equals_plain_python(spark, pair):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert digests(docs, pair) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert op11_alignment(spark, "/root/testdata/sf0.001").count() == docs.count()


ODD = ["a  b   c \n\n d", " leading and trailing ", "\t\ttabs\x1cand\x1d \x1e marks\x85 \xa0x", "it's we'll 'tis  'll", "▁ piece ▁ signs", "x▁",
       "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語 テキスト \U0001f642 é ́ x", "a\x00b \x00 c", " ", "   ", "\n", "word " * 3000, "x" * 5000,
       "123 45 6.7", "᠎ ᠎ a ​ b"]


def test_odd_rows(spark, pair, odd_rows, no_rows):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "the cat"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_a", "groups", "a_ids", "pair", "n"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = digests(docs, pair)
    assert got == plain(rows)
    assert sum(r[1] == 0 for r in got) == 4  # two with the piece sign, one null, one empty
    assert digests(odd_rows, pair) == plain([(r.doc_id, r.text) for r in odd_rows.collect()])
    assert digests(no_rows, pair) == []


def test_a_small_memory_gives_the_same(spark, pair, monkeypatch):
    docs = spark.createDataFrame([(i, f"{t} {i}") for i in range(40) for t in ODD[:5]], "doc_id long, text string").repartition(2)
    want = digests(docs, pair)
    monkeypatch.setattr(align, "REMEMBERED", 2000)
    monkeypatch.setattr(align, "CHUNK", 200)
    assert digests(docs, pair) == want


def test_groups_slice_both_token_lists(spark, pair, odd_rows):
    docs = odd_rows.withColumn("groups", F.lit("mine"))
    rows = align.alignments(docs, pair).collect()
    assert len(rows) == docs.count() and {r.node for r in rows} == {1} and {r.kept for r in rows} == {"x", "y", "z", None}
    for r in rows:
        assert [(g.a_first, g.b_first) for g in r.groups] == [(0, 0), *((g.a_last + 1, g.b_last + 1) for g in r.groups[:-1])][:len(r.groups)]
        for g in r.groups:
            a = b"".join(pair.a_bytes[i] for i in r.a_ids[g.a_first:g.a_last + 1])
            assert a == b"".join(pair.b_bytes[i] for i in r.b_ids[g.b_first:g.b_last + 1]) and a


def test_link_counts_add_up(spark, pair, documents):
    counts = align.link_counts(documents, pair)
    n, links = counts.agg(F.count("*"), F.sum("n")).first()
    assert n == counts.select("a_id", "b_id").distinct().count() <= len(pair.pairs())
    assert links == align.alignment_digests(documents, pair).agg(F.sum("n_links")).first()[0]
