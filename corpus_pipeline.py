"""From raw documents to tokens: five stages, each on all that the one before it kept.

language        documents in no learned language go (letters lacking, or no language parses the text in few phrases)
near_duplicates of each group of documents linked by the Jaccard similarity of five-word shingles, one stays
repeats         strings of 50 bytes that also start in a document of smaller id are cut out; what is left empty goes
mixture         sources at their target weights: documents as often as the mix takes them, the one on a cut in part
tokens          byte-level BPE: token counts and digests of each row of the mixture

All stages but the last return the columns of their input, whatever these are called. Null and empty texts go in the
first stage; null ids stay, as the largest; rows that repeat are near duplicates of each other, of which one stays; long
texts are worked on whole; an empty table gives an empty result.
"""

import public_tokenizers

from reqguard.llm import bpe, jaccard, langid, mixing, suffixes
from reqguard.llm.stage import discard, stage


def language(spark, docs, sf_dir):
    return langid.in_known_language(docs)


def near_duplicates(spark, docs, sf_dir):
    return jaccard.one_of_each_group(docs)


def repeats(spark, docs, sf_dir):
    return suffixes.without_repeats(docs)


def mixture(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def tokens(spark, docs, sf_dir):
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("tokens", tokens)]

#: Language identification and the joins by iterated components are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents of the folder; every stage's result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
