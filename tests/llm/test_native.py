"""Operators 2, 5, 6, 7 and 9: against their SQL on odd tables, and on cases of their own."""

import duckdb
import pytest

import __spark_entry__ as entry
from reqguard.llm import imatch, license, mixing, preference, quality


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    norm = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert norm(got.select(cols).collect()) == norm(want.select(*cols).fetchall())


def against_sql(name, df, table, query):
    con = duckdb.connect()
    frame = df.toPandas().astype(object).where(lambda x: x.notna(), None)
    con.register("_frame", frame)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR"}
    con.execute(f"CREATE TABLE {table} AS SELECT " + ", ".join(f"CAST({c} AS {kinds[t]}) AS {c}" for c, t in df.dtypes) + " FROM _frame")
    same(query(df), con.sql(entry.oracle_sql()[name]))


@pytest.mark.parametrize("name, query", [
    ("op2_license_scan", license.license_scan), ("op6_mixing", mixing.mixed_sizes),
    ("op7_quality", lambda d: quality.quality(d).drop("n_lines", "n_stop_words"))])
def test_odd_rows_equal_sql(odd_rows, name, query):
    against_sql(name, odd_rows.select("doc_id", "text", "source"), "documents", query)


def test_fingerprints_of_odd_rows(odd_rows, no_rows):
    against_sql("op9_imatch", odd_rows.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text"), "documents", imatch.fingerprints)
    rows = imatch.fingerprints(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (5, None)}) == 1
    assert imatch.fingerprints(no_rows).count() == 0


def test_every_operator_takes_an_empty_table(no_rows, spark):
    for query in (license.license_scan, mixing.mixed_sizes, mixing.mixed_documents, quality.quality):
        assert query(no_rows).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.preferences(preference.swapped_pairs(turns)).count() == 0


def test_license_windows_find_shifted_templates(spark):
    rows = [(i, "word " * i + t.upper() + " tail" * (i % 7)) for i in range(40) for t in license.TEMPLATES.values()]
    got = license.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == len(rows) and got.filter("containment < 1").count() == 0
    assert all(license.missed(n) < 0.005 for n in range(5, 13))


def test_license_below_the_threshold(spark):
    t = license.TEMPLATES["BSD-clause"].split()
    rows = [(1, " ".join(t)), (2, " ".join(t[:16])), (3, " ".join(t[:7] + ["x"] + t[8:]))]
    got = {r.doc_id: r.n_found for r in license.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(t) - 4
    assert got == {i: k for i, k in ((1, n), (2, 12), (3, n - 5)) if k >= 0.75 * n}


def test_preferences(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b"), ("user", "z")]),
            (2, [("user", "q")], [("user", "q")]), (3, None, [("assistant", "b")]), (4, [], [])]
    got = {r.pair: r for r in preference.preferences(spark.createDataFrame(rows, f"pair long, chosen {turn}, rejected {turn}")).collect()}
    assert got[1].prompt == "<|im_start|>user\nq<|im_end|>\n" and got[1].prompt_turns == 1
    assert got[1].chosen == "<|im_start|>assistant\na<|im_end|>\n"
    for r in got.values():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert all(text[m.start:m.end].endswith("<|im_end|>\n") for m in mask)
    assert got[1].chosen[got[1].chosen_mask[0].start:][:1] == "a" and len(got[1].rejected_mask) == 1
    assert (got[2].chosen, got[2].rejected, got[2].prompt_turns) == ("", "", 1)
    assert (got[3].chosen, got[3].rejected) == ("", "<|im_start|>assistant\nb<|im_end|>\n") and got[4].prompt == ""


def test_preferences_of_odd_turns_equal_sql(spark):
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("user", f"q{c % 3}"), ("assistant", f"a{c}"), (None, None), ("assistant", None)][: c % 5])]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").filter("conv_id IS NOT NULL")
    import reqguard.llm.queries as Q
    con = duckdb.connect()
    con.register("_frame", turns.toPandas())
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM _frame")
    same(Q.op5_of(turns), con.sql(entry.oracle_sql()["op5_preferences"]))
    assert preference.preferences(preference.swapped_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).filter("conv_id IS NULL").count() == 1


def test_mixture_meets_its_budgets(documents):
    rows = mixing.mixed_sizes(documents).collect()
    sums, goal = {}, {}
    by = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sums[by[r.doc_id]] = sums.get(by[r.doc_id], 0) + r.taken
        goal[by[r.doc_id]] = r.target
    assert all(sums[s] == int(goal[s]) for s in goal)
    total = sum(r.size for r in rows)
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 * total
    from reqguard.llm.text import word_count
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert mixed.select(word_count(mixed["text"]).alias("n")).groupBy().sum("n").first()[0] == sum(sums.values())


def test_targets_share_the_excess(spark):
    import random
    rng = random.Random(4)
    for _ in range(5):
        sizes = {f"s{i:02}": rng.choice([0, 3, 50, 1000, 20_000]) for i in range(rng.randint(1, 9))}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        left, capped = 1.5 * sum(sizes.values()), {}
        while True:
            free = [s for s in sizes if s not in capped]
            level = (left - sum(capped.values())) / sum(weights[s] for s in free) if free else 0
            over = [s for s in free if weights[s] * level > 2 * sizes[s]]
            if not over:
                break
            capped |= {s: 2.0 * sizes[s] for s in over}
        want = {s: capped.get(s, weights[s] * level) for s in sizes}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
