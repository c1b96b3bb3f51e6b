"""Every stage of the pipeline against brute force, each on what the one before it kept."""

import hashlib

import pytest
from brute import WORD, components, repeats

import __spark_entry__ as entry
import corpus_pipeline
from reqguard.llm import langid, mixing
from reqguard.llm.stage import stage
from reqguard.llm.text import word_count

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, documents):
    out, docs = [("documents", documents)], documents
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, FOLDER), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay_until_the_last_stage(stages):
    names = list(stages)
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])
    assert names == ["documents", "language", "near_duplicates", "repeats", "mixture", "tokens"]


def test_language_keeps_what_it_knows(stages):
    docs = stages["documents"]
    marked = langid.identify(docs.select("doc_id", "text"), langid.labelled_sample(docs.filter(~langid.held_out(docs["doc_id"])))).collect()
    want = {r.doc_id for r in marked if r.lang_pred != "und" and r.phrase_rate <= langid.FOREIGN}
    assert set(texts(stages["language"])) == want and len(want) >= 0.99 * docs.count()


def test_one_of_each_group_stays(stages):
    before = texts(stages["language"])
    group = components(before.items())
    assert texts(stages["near_duplicates"]) == {i: t for i, t in before.items() if group[i][1] == i}


def test_repeats_are_cut(stages):
    want = {}
    for i, b, gone in repeats(list(texts(stages["near_duplicates"]).items())):
        # a character of which a part is cut goes whole
        kept = bytes(c for p, c in enumerate(b) if p not in gone).decode(errors="replace").replace("\ufffd", "") if gone else b.decode()
        if WORD.search(kept):
            want[i] = kept
    assert texts(stages["repeats"]) == want
    assert stages["repeats"].filter("n_chars <> length(text)").count() == 0


def test_mixture_takes_its_words(stages):
    before = stages["repeats"]
    taken = {r.doc_id: r.taken for r in mixing.mixed_sizes(before).collect()}
    rows = stages["mixture"].withColumn("n", word_count(stages["mixture"]["text"])).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n
    assert got == {i: n for i, n in taken.items() if n}
    whole = texts(before)
    assert all(whole[r.doc_id].startswith(r.text) for r in rows)


def test_tokens_decode_to_the_texts(stages):
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in stages["mixture"].collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in stages["tokens"].collect()) == want


def test_run_gives_the_last_stage(spark, stages):
    got = sorted(map(tuple, entry.queries()["pipeline"](spark, FOLDER).collect()))
    assert got == sorted(map(tuple, stages["tokens"].collect()))
