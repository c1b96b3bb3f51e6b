import re

import pytest
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.functions import scoring, text
from reqguard.sources.requests import PAYLOADS

TEXTS = PAYLOADS + [
    "1' AND 1=1 UNION SELECT NULL,NULL--", "<svg onload=alert(1)>", '<iframe src="javascript:alert(1)">', "plain words",
    "select\nfrom", "union\rselect x", "a;  drop it", "x or 1 = 1", "ls | cat", "a&&whoami", "rm -rf", "the farm", "%2e%2e/x",
    "eval(1)", "..\\win", "sqlmap", "root then 12345", "$(id)", "don't", "ONERROR=1", "", "日本語 select 1 from t",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "event_id long, payload string")


def test_signatures_equal_python(texts):
    df = texts.withColumns({"user_agent": F.lit("curl/8.0"), "endpoint": F.lit("/x")})
    got = {r["event_id"]: r for r in text.signature_match(df).collect()}
    for i, t in enumerate(TEXTS):
        target = f"{t} curl/8.0 /x"
        names = [n for n, (_, ps) in C.SIGNATURES.items() if any(re.search(p, target) for p in ps)]
        assert got[i]["matched"] == names, t
        assert got[i]["signature_score"] == min(100.0, sum(C.SIGNATURES[n][0] for n in names))


def test_flags_equal_python(texts):
    got = {r["event_id"]: r["f"] for r in texts.select("event_id", text.payload_flags(F.col("payload")).alias("f")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == sorted(f for f, ps in C.PAYLOAD_FLAGS.items() if any(re.search(p, t.lower()) for p in ps)), t


def test_structural_fingerprint(spark):
    rows = [("abc123def", "A"), ("12-34", "A-A"), ("a1 b2!", "A A!"), ("", ""), ("é1", "éA"), ("x" * 3 + "." * 600, "A" + "." * 600)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, e string").select(text.structural_fingerprint(F.col("p"))).collect()]
    assert got == [e for _, e in rows]


def test_trigrams_are_unit_vectors(spark):
    df = spark.createDataFrame([(1, "aaaab"), (2, "ab"), (3, "abc")], "id long, t string")
    got = {(r["id"], r["gram"]): (r["n"], r["weight"]) for r in text.trigram_counts(df, "id", "t").collect()}
    assert set(got) == {(1, "aaa"), (1, "aab"), (3, "abc")}
    assert got[1, "aaa"][0] == 2 and got[1, "aaa"][1] == pytest.approx(2 / 5 ** 0.5) and got[3, "abc"][1] == 1.0


def test_path_numbers_and_escaping(spark):
    df = spark.createDataFrame([("/api/12/x/007/9a", "a.b*[c]\\d")], "p string, q string")
    r = df.select(text.path_numbers(F.col("p")).alias("n"), text.escape_regex(F.col("q")).alias("q")).first()
    assert [int(x) for x in r["n"]] == [12, 7, 9]
    assert re.fullmatch(r["q"], "a.b*[c]\\d")


DECISIONS = [  # deviation, anomaly, repeat, signature, deception -> action
    ((0, 0, 0, 90.0, 0), "allow"), ((0, 0, 0, 90.1, 0), "block"), ((0, 0, 0, 0, 80.0), "allow"),
    ((0, 0, 0, 0, 80.1), "deception_flag"), ((100, 1.0, 100, 90, 80.0), "block"), ((100, 0.8, 100, 90, 20), "quarantine"),
    ((100, 0.0, 100, 90, 5), "throttle"), ((70, 0.75, 0, 0, 0), "allow"), ((70.1, 0, 0, 0, 0), "shadow_monitor"),
    ((0, 0.76, 0, 0, 0), "shadow_monitor"), ((100, 0, 100, 90, 95.0), "deception_flag"),
]


def test_decision_table(spark):
    from reqguard.operators.decisions import decide
    rows = [tuple(float(x) for x in s) for s, _ in DECISIONS]
    df = spark.createDataFrame(rows, "deviation double, anomaly double, repeat double, signature_score double, deception double")
    got = decide(df).collect()
    assert [r["action"] for r in got] == [a for _, a in DECISIONS]
    assert got[5]["reason"] == f"total over 70: {got[5]['total_risk']:.1f}"


def test_fusion(spark):
    rows = [(0.55, 0.3, 0.4, 65.0, False), (0.55, 0.3, 0.4, 65.0, True), (0.9, 0.99, 0.99, 90.0, True), (0.9, 0.0, 0.0, 89.9, True),
            (1.0, 1.0, 1.0, 100.0, False)]
    df = spark.createDataFrame(rows, "ml double, memory_sim double, correlation double, risk double, trusted boolean")
    got = scoring.bayes_fusion(df, F.lit(0.02)).collect()
    assert got[0]["posterior"] == pytest.approx(0.02) and got[0]["fused_action"] == "PASS"
    assert got[1]["posterior"] == 0.01 and got[1]["confidence"] == 1.0
    assert got[2]["fused_action"] == "BLOCK" and got[3]["fused_action"] == "PASS" and got[3]["posterior"] == 0.01
    assert got[4]["posterior"] == pytest.approx(1.0)


def test_cold_anomaly(spark):
    df = spark.createDataFrame([(0.5, 0.5, 10.0), (0.51, 0.0, 0.0), (0.6, 0.6, 0.0), (0.6, 0.6, 11.0)], "a double, b double, d double")
    got = [r[0] for r in df.select(scoring.cold_anomaly(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert got == pytest.approx([0.0, 0.4, 0.8, 1.0])


def test_numbers_of_any_length_have_neighbours(spark):
    big = 10 ** 45
    rows = [(i, str(n)) for i, n in enumerate([1, 10, 100, 101, 7, big, big + 1, 9 * big, 10 ** 38, 123456789012345678901234567890123456789000])]
    df = spark.createDataFrame(rows, "id long, digits string")
    got = {r["digits"]: r["before"] for r in df.withColumn("before", text.predecessor(F.col("digits"))).collect()}
    assert got == {d: str(int(d) - 1) for _, d in rows}
    path = spark.createDataFrame([(f"/a/007/{big}/x/0/000/b12",)], "path string")
    assert path.select(text.path_numbers(F.col("path"))).first()[0] == ["7", str(big), "0", "0"]
    assert df.limit(1).select(text.predecessor(F.lit("0"))).first()[0] == "none"


def test_ngrams_of_a_long_text_take_linear_time(spark):
    """A text of 400,000 characters, of which none is one byte: looking for each gram from the start takes minutes."""
    import time

    df = spark.range(1).select(F.repeat(F.lit("é中\U0001F600"), 133_334).alias("t"))
    began = time.time()
    got = {r["gram"]: r["n"] for r in df.select(F.explode(text.ngrams(F.col("t"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    assert got == {"é中\U0001F600": 133_334, "中\U0001F600é": 133_333, "\U0001F600é中": 133_333}
    assert time.time() - began < 15
