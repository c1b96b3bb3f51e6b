import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from reqguard.llm import bpe


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_equal_to_the_library(library, vocabulary, documents):
    rng = random.Random(3)
    texts = [r.text for r in documents.select("text").collect()]
    texts += ["", " ", "  \n\n x", "a" * 3000, "0123456789" * 100, "日本語 " * 50, "x\x85y \x1c z", "<|endoftext|>",
              "\U0001f642" * 300, "he's they'LL 's", " " * 1000 + "x", "aaaa bbbb" * 400]
    texts += ["".join(rng.choice(" abé\n'st1") for _ in range(200)) for _ in range(50)]
    e = bpe.Encoder(vocabulary)
    ids = e.encode(texts[:100]) + e.encode(texts[100:])
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [e.decode(x).decode() for x in ids] == texts


def test_forgotten_pieces_come_again(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    e = bpe.Encoder(vocabulary)
    texts = [f"the word{i} and the the number{i % 7} once more the" for i in range(60)]
    got = [np.frombuffer(e.encode([t])[0], "<u4").tolist() for t in texts]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_odd_rows(odd_rows, no_rows, library):
    path = P.path("byte_bpe_50k.tiktoken")
    want = []
    for r in odd_rows.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.token_digests(odd_rows, path, P.PATTERN).collect())
    assert bpe.token_digests(no_rows, path, P.PATTERN).count() == 0
    v = bpe.Vocabulary.read(path, P.PATTERN)
    back = bpe.decode(bpe.encode(odd_rows, v), v)
    assert all((r.text or "").encode() == bytes(r.decoded) for r in back.collect())
