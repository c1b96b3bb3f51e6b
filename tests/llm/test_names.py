"""Columns of the caller that are called like those of an operator keep their values; labelled samples; many ranges."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from reqguard.llm import imatch, langid, mixing, neighbours, preference
from reqguard.llm.queries import op5_of

#: Names that operators use for results or on the way.
TAKEN = ["size", "source_size", "target", "taken", "_key", "_part", "_source", "_of", "_start", "_sum", "_words", "lang_pred", "score", "phrase_rate",
         "_letters", "n_bytes", "n_removed", "spans", "kept", "block", "_sa_id", "_sa_block", "ids", "_jid", "_jmark", "group", "id", "n", "mark", "prompt",
         "chosen_mask", "_doc", "_range", "_halo", "place", "key"]


@pytest.fixture(scope="module")
def named(spark, documents):
    docs = documents.limit(60)
    for name in TAKEN:
        docs = docs.withColumn(name, F.concat(F.lit(name + " of "), F.col("doc_id").cast("string")))
    return docs.cache()


@pytest.mark.parametrize("name, function", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_values_of_all_columns(spark, named, name, function):
    out = function(spark, named, "")
    assert out.columns == named.columns and out.dtypes == named.dtypes
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{c} of {r.doc_id}" for c in TAKEN)


def test_the_mix_keeps_other_columns(named):
    rows = mixing.mix(named.withColumn("size", F.lit(3))).collect()
    for r in rows:
        assert all(r[c] == f"{c} of {r.doc_id}" for c in TAKEN if c not in ("size", "source_size", "target", "taken"))
        assert r.size == 3 and isinstance(r.taken, int)


def test_a_column_called_like_a_result_is_replaced_once(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "q")], [("user", "z")], "mine", "mine")]
    got = preference.preferences(spark.createDataFrame(rows, f"pair long, chosen {turn}, rejected {turn}, prompt string, chosen_mask string"))
    assert len(set(got.columns)) == len(got.columns) and got.first()["prompt"] == ""


def test_a_long_conversation_is_rendered_whole(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for c, n in ((1, 1500), (2, 2)) for t in range(n)]
    got = {r.conv_id: r for r in op5_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].prompt_turns == 1499 and got[1].prompt.count("<|im_start|>") == 1499


def test_few_labelled_texts_fill_the_sample(spark):
    rows = [(i, ("abc " * 4000)[: rng], "rare") for i, rng in enumerate([9000, 12_000, 40, 10_000, 11_000, 1, 7000, 9500, 16_000, 3])]
    rows += [(100 + i, "xyz " * 50, "common") for i in range(900)] + [(2000, None, "rare"), (2001, "", "rare"), (2002, "a", None), (0, rows[0][1], "rare")]
    got = langid.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200, 24_576)
    assert {k: len(v) for k, v in got.items()} == {"rare": 24_576, "common": 24_576}
    few = langid.labelled_sample(spark.createDataFrame([(1, "one text", "x")], "doc_id long, text string, lang string"))
    assert few == {"x": b"one text"}


def test_level():
    rng = random.Random(1)
    for _ in range(200):
        sizes, total = [rng.randint(1, 50) for _ in range(rng.randint(1, 9))], rng.randint(1, 300)
        most = langid.level(sizes, total)
        assert sum(min(x, most) for x in sizes) >= min(total, sum(sizes))
        assert most == 1 or sum(min(x, most - 1) for x in sizes) < min(total, sum(sizes))


@pytest.mark.parametrize("least, most", [(1, 3), (500, 20_000)])
def test_followers_over_many_ranges(spark, least, most):
    rng = random.Random(6)
    rows = [(rng.choice([None, 7, *range(-400, 400)]), f"t{rng.randint(0, 50)}") for _ in range(2000)]
    rows += [(7, f"text {i}") for i in range(700)] + [(None, f"text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    both, order = neighbours.with_ranges(df, "id", ["text"], least, most)
    if most < 10:
        own = both.filter("NOT _halo")
        assert both.select("_range").distinct().count() > 512
        assert own.groupBy("_range").count().agg(F.max("count")).first()[0] < 200  # frequent ids lie in many ranges
    got = sorted((tuple(r) for r in neighbours.without_ranges(both.withColumn("after", F.lead(F.struct("id", "text")).over(order)).withColumn(
        "after", F.col("after.text"))).select("id", "text", "after").collect()), key=repr)
    whole = Window.orderBy(F.desc_nulls_last("id"), F.xxhash64("text"), "text")
    first = df.orderBy(F.desc_nulls_last("id"), F.xxhash64("text"), "text").first()
    want = df.withColumn("after", F.coalesce(F.lead("text").over(whole), F.lit(first.text))).collect()
    assert got == sorted((tuple(r) for r in want), key=repr)


def test_texts_without_terms_of_the_band_differ(spark):
    rows = [(i, f"common words in all texts here {i % 7}") for i in range(60)] + [(100, "alpha beta"), (101, "alpha beta"), (102, "gamma delta"), (103, "beta alpha beta")]
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].fingerprint == got[101].fingerprint == got[103].fingerprint != got[102].fingerprint
    assert got[101].near_next == 1.0 and got[103].near_next == 0.0 and got[102].near_next == 0.0
