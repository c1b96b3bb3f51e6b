"""Operator 10 in the dealt form gives the tokens of the fast form."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from reqguard.llm import bpe, bpe_fold


def test_folded_merges_equal_the_library(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    v = bpe.Vocabulary.read(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})
    odd = [(10**6 + i, t) for i, t in enumerate(["it's  a\n\n test\x85 of\xa0 spaces \x1c.", "日本語 \U0001f642 é ́", "x" * 60, "", None, "a\x00b 123 ½ ٣", "  "])]
    docs = documents.select("doc_id", "text").limit(40).unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    rows = bpe_fold.fold_decode(bpe_fold.fold_encode(docs, v), v).withColumn("decoded", F.col("decoded").cast("string")).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: t for i, t in want.items() if t}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in rows)
