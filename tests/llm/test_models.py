"""Operators 1 and 8: held-out quality, base counts by brute force, and the parts of the models."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from brute import lower_words

from reqguard.llm import langid, packed, pitman_yor


def longest_match(text, i, sample):
    n = 1
    while i + n < len(text) and text[i:i + n + 1] in sample:
        n += 1
    return n


def test_phrases_are_greedy_longest_matches():
    rng = random.Random(2)
    samples = {x: bytes(rng.choice(b"abc") for _ in range(300)) for x in ("p", "q")}
    p = langid.Parser(samples)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    got = p.scores(texts)
    for t, row in zip(texts, got):
        for j, lang in enumerate(p.langs):
            phrases = 0
            for b in range(0, len(t), langid.BLOCK):
                block, i = t[b:b + langid.BLOCK], 0
                while i < len(block):
                    i += longest_match(block, i, samples[lang])
                    phrases += 1
            assert row[j] == phrases / len(t)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd_rows, no_rows):
    rows = langid.languages(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 6}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert langid.languages(no_rows).count() == 0
    assert langid.in_known_language(odd_rows).columns == odd_rows.columns


def test_stirling_numbers_and_draws():
    s = pitman_yor.log_stirling(0.5)
    # three customers: one table (1 - d)(2 - d), two tables 3 (1 - d), three tables 1
    assert np.allclose(np.exp(s[3, 1:4]), [0.75, 1.5, 1.0])
    n = 40_000
    t = pitman_yor.tables(np.full(n, 3), np.full(n, 0.4), 0.5, np.arange(n), 1)
    w = np.array([0.75 * 0.4, 1.5 * 0.16, 0.064])
    assert np.allclose(np.bincount(t, minlength=4)[1:] / n, w / w.sum(), atol=0.01)
    big = pitman_yor.tables(np.full(2000, 5000), np.full(2000, 2.0), 0.3, np.arange(2000), 1)
    assert 1 <= big.min() and big.max() < 500


def test_letters_add_up_to_one():
    words = [b"then", b"the", b"thin", b""]
    grams, _, _ = pitman_yor.spelled(words, np.minimum(np.arange(256), 63))
    keys, n = np.unique(grams, return_counts=True)
    before, levels = None, []
    for sweep in range(3):
        before, levels = pitman_yor.spelling(keys, n * 5, before, levels, sweep)
    for context in (0, *(keys[:4] // 64)):
        assert math.isclose(before.letter(context * 64 + np.arange(64)).sum(), 1, rel_tol=1e-9)


def test_base_score_and_held_out_gain(documents):
    rows = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    tokens = {i: [*lower_words(t), ""] for i, t in rows.items()}
    c = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(t)
    total = sum(c.values())
    got = {r.doc_id: r for r in pitman_yor.scored_documents(documents).collect()}
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in pitman_yor.scored_documents(documents).collect()}
    assert all(math.isclose(again[i], r.score, rel_tol=1e-9) for i, r in got.items())


def test_scores_of_odd_rows(odd_rows, no_rows):
    rows = pitman_yor.scored_documents(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    assert all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert pitman_yor.scored_documents(no_rows).count() == 0


def words_in_context(texts, tokens_of):
    """Restaurants of pairs that each occur at most once, hence with one table each: counts, discount, and the words'
    customers and tables by sweeps one word at a time."""
    pairs, c = Counter(), Counter()
    for t in texts:
        tokens = tokens_of(t)
        pairs.update(zip(["", *tokens], tokens))
        c.update(tokens)
    assert set(pairs.values()) == {1}
    return pairs, c, Counter(w for _, w in pairs), Counter(u for u, _ in pairs)


def test_scores_by_plain_sweeps(spark):
    """Whole scores against restaurants in dictionaries; repeated starts and ends cannot be, so one text is learned from."""
    rng = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "omega", "pi", "rho", "sigma"]
    learned, pairs = [], set()
    while len(learned) < 40:
        w = rng.choice(names)
        if not learned or (learned[-1], w) not in pairs:
            pairs.add((learned[-1] if learned else "", w))
            learned.append(w)
        elif all((learned[-1], x) in pairs for x in names):
            break
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    free = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 10)
    rows = {free: " ".join(learned), ids[0]: " ".join(sorted(learned)), ids[1]: "alpha " + "z" * 900 + " beta", ids[2]: None, ids[3]: "Pi\npi"}
    got = {r.doc_id: r for r in pitman_yor.scored_documents(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}

    tokens_of = lambda t: [*lower_words(t), ""]
    pairs, c, m, u = words_in_context([rows[free]], tokens_of)
    d2 = min(0.95, max(0.05, 1.0))
    words = sorted(m)
    raw, customers = [w.encode() for w in words], np.array([m[w] for w in words])
    one, two = sum(x == 1 for x in m.values()), sum(x == 2 for x in m.values())
    d1 = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    seen = Counter(b for w in raw for b in w)
    code = np.full(256, 63)
    for k, b in enumerate(sorted(range(256), key=lambda b: (-seen[b], b))[:62]):
        code[b] = k + 1
    letters, levels, samples = None, [], []
    for sweep in range(pitman_yor.SWEEPS + 1):
        t = np.ones(len(words), int) if not sweep else pitman_yor.tables(
            customers, (1 + d1 * sum(t)) * h, d1, pitman_yor.word_keys(raw), 1_000_003 * sweep)
        grams = Counter()
        for w, n in zip(raw, t):
            for g in pitman_yor.spelled([w], code)[0]:
                grams[int(g)] += int(n)
        keys = np.array(sorted(grams))
        letters, levels = pitman_yor.spelling(keys, np.array([grams[g] for g in keys]), letters, levels, 31 * sweep)

        def spelled(w, letters=letters):
            g, _, others = pitman_yor.spelled([w], code)
            return math.exp(max(-690, np.log(letters.letter(g)).sum() - others[0] * math.log(194)))

        h = np.array([spelled(w) for w in raw])
        if sweep > pitman_yor.BURN:
            new = (1 + d1 * sum(t)) / (1 + sum(customers))
            p = {w: (n - d1 * x) / (1 + sum(customers)) + new * y for w, n, x, y in zip(words, customers, t, h)}
            samples.append((p, max(1e-12, new * (1 - sum(h))), lambda w, new=new, f=spelled: new * f(w.encode())))
    for i, text in rows.items():
        tokens, known, other = tokens_of(text), 0.0, 0.0
        for v, w in zip(["", *tokens], tokens):
            own, back = pairs[v, w] * (1 - d2) / (1 + c[v]), (1 + d2 * u[v]) / (1 + c[v])
            known += math.log10(own + back * sum(p.get(w, unseen) for p, unseen, _ in samples) / len(samples))
            other += math.log10(own + back * sum(p[w] if w in p else f(w) for p, _, f in samples) / len(samples))
        assert math.isclose(got[i].score, known, rel_tol=1e-6)
        assert math.isclose(got[i].spelled_score, other, rel_tol=1e-6)


def test_words_have_contexts(spark):
    """Failed while words had no contexts: any order of a text's words scored the same."""
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0)
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10][:30]
    text = "the quick brown fox jumps over the lazy dog"
    rows = [*((i, text) for i in free), (held, text), (held, " ".join(reversed(text.split())))]
    got = [r.score for r in pitman_yor.scored_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()]
    assert max(got) > min(got) + 5


def test_contexts_tell_training_texts(spark):
    """Perplexity, by blocks, buckets and parts of any size the same but for the order in which words are numbered."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = pitman_yor.scored_documents(docs).selectExpr("held_out", "score", "base_score", "n_tokens").collect()
    for held in (True, False):
        n = sum(x.n_tokens for x in r if x.held_out == held)
        score, base = (10 ** (-sum(x[k] for x in r if x.held_out == held) / n) for k in ("score", "base_score"))
        assert score < base / 3


def test_packed_numbers_and_pairs():
    rng = np.random.default_rng(3)
    for top in (1, 255, 256, 2**40, 2**63):
        v = rng.integers(0, top, 50, dtype=np.uint64, endpoint=True)
        assert (packed.unpacked(packed.packed(v), 50) == v).all()
        assert (packed.unpacked_steps(packed.packed_steps(np.sort(v)), 50) == np.sort(v)).all()
    assert len(packed.unpacked(packed.packed(np.empty(0)), 0)) == 0 and packed.packed(np.zeros(9)) == b""
    for bits, parts in ((1, 1), (3, 5), (22, 7), (32, 3)):
        s = packed.Scramble(bits, parts)
        x = np.unique(rng.integers(0, 1 << 2 * bits, 1000, dtype=np.uint64) if bits < 32 else rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
        there = s.there(x)
        assert len(np.unique(there)) == len(x) and (there <= s.mask).all() and (s.back(there) == x).all()
        cut = s.bounds(np.sort(there))
        assert cut[0] == 0 and cut[-1] == len(x) and (np.diff(cut) >= 0).all() and len(cut) == parts + 1
