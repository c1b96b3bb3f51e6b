"""Registered queries: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqguard.llm.align import Tokenizers, alignment_digests
from reqguard.llm.bpe import token_digests
from reqguard.llm.imatch import fingerprints
from reqguard.llm.jaccard import near_duplicates
from reqguard.llm.langid import languages
from reqguard.llm.license import license_scan
from reqguard.llm.mixing import mixed_sizes
from reqguard.llm.negatives import hard_negatives
from reqguard.llm.pitman_yor import scored_documents
from reqguard.llm.preference import preferences, swapped_pairs
from reqguard.llm.quality import quality
from reqguard.llm.suffixes import removed_repeats
from reqguard.llm.token_store import stored_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pitman_yor(spark, sf_dir):
    return scored_documents(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op3_suffix_array(spark, sf_dir):
    return removed_repeats(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_of(turns):
    """Masks as text, start:end of each span."""
    def shown(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), " ")

    made = preferences(swapped_pairs(turns))
    return made.withColumn("chosen_mask", shown("chosen_mask")).withColumn("rejected_mask", shown("rejected_mask"))


def op5_preferences(spark, sf_dir):
    return op5_of(table(spark, sf_dir, "conversations"))


def op6_mixing(spark, sf_dir):
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op9_imatch(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_alignment(spark, sf_dir):
    pair = Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment_digests(table(spark, sf_dir, "documents"), pair)


def op12_of(embeddings):
    """Rows whose id is divisible by 7 get the next of ten labels; those divisible by 50 are the anchors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


def op12_hard_negatives(spark, sf_dir):
    return op12_of(table(spark, sf_dir, "embeddings"))


def op13_token_store(spark, sf_dir):
    return stored_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries():
    found = (op1_pitman_yor, op2_license_scan, op3_suffix_array, op4_jaccard_join, op5_preferences, op6_mixing, op7_quality, op8_language, op9_imatch,
             op10_byte_bpe, op11_alignment, op12_hard_negatives, op13_token_store)
    return {q.__name__: q for q in found}
