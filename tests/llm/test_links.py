import random

import pytest
from brute import components

from reqguard.llm import jaccard


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}


def test_documents_equal_brute_force(documents):
    assert got(documents) == components([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies_and_shared_passages(spark, seed):
    """Edits around the threshold, chains that link only step by step, and a passage in many documents."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        text = [word() for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.5:
            text += passage
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = word()
    rows += [(1000 + i, " ".join(passage[:4])) for i in range(3)] + [(2000, "A b  C"), (2001, "a B\tc"), (2002, "a b")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == components(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_appended_truncated_and_contained_texts(spark, seed):
    """Pairs of sets of different size, alone with their shingles: those of the smaller lie behind the prefix of the larger."""
    rng = random.Random(seed)
    rows = [(0, " ".join(f"only{i}" for i in range(84))), (1, " ".join(f"only{i}" for i in range(104)))]
    for g in range(60):
        n = rng.randint(40, 160)
        text = [f"g{g}w{i}" for i in range(n)]
        keep = int(n * rng.choice([0.73, 0.76, 0.78, 0.8, 0.85, 0.9]))
        begin = rng.choice([0, n - keep, rng.randint(0, n - keep)])  # y appends to x, or x is its end, or lies within
        rows += [(10 * g + 10, " ".join(text)), (10 * g + 11, " ".join(text[begin:begin + keep]))]
        if g % 3 == 0:
            rows.append((10 * g + 12, " ".join(text[:n // 2] + [f"g{g}own{i}" for i in range(n // 20)] + text[n // 2:])))
    want = components(rows)
    assert want[1] == (100, 0) and 20 < sum(i != c for i, (_, c) in want.items()) < len(rows) - 60
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_links_of_repeated_and_null_ids(spark):
    """Texts that only share an id are linked each by its own words, and do not join the groups of one another."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(100))
    rows = [(7, text(0)), (7, text(1)), (None, text(2)), (None, text(3)), (1, text(0) + " end"), (2, text(1) + " end"), (3, text(2) + " end"), (4, text(3) + " end")]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == [
        (1, 97, 1), (2, 97, 2), (3, 97, 3), (4, 97, 4), (7, 96, 1), (7, 96, 2), (None, 96, 3), (None, 96, 4)]


def test_rows_that_share_an_id_stay_apart(spark):
    """Null and repeated ids of unlinked texts, a null id that is a near copy of a smaller id, copies, and wordless rows."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(100))
    gone = [(None, text(0) + " end"), (None, text(1) + " end"), (8, text(2) + " end")]
    stay = [(1, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (None, text(4)), (None, text(5)), (None, None), (None, " "), (9, ""), (9, "\t")]
    rows = spark.createDataFrame([*gone, *stay, (None, text(4)), (7, text(3))], "doc_id long, text string").repartition(3)
    key = lambda x: (str(x[0]), str(x[1]))
    found = sorted((tuple(r) for r in jaccard.one_of_each_group(rows).collect()), key=key)
    # of the two null ids of one group, either may stay
    assert [(i, t and t.removesuffix(" end")) for i, t in found] == sorted(stay, key=key)


def test_bounds_of_filters():
    assert [jaccard.prefix_size(n) for n in (1, 2, 4, 5, 100)] == [1, 1, 2, 2, 26]


def test_odd_rows(odd_rows, no_rows):
    rows = jaccard.near_duplicates(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[5] == {(2, 5)} and by[None] == {(2, 5)}
    assert by[0] == by[2**40] == {(by[0].copy().pop()[0], 0)}
    assert by[4] == {(1, 4)}
    assert jaccard.near_duplicates(no_rows).count() == 0
    kept = jaccard.one_of_each_group(odd_rows)
    assert kept.columns == odd_rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [-9, 0, 1, 2, 3, 4, 5, 6, 7]
