import json

from pyspark.sql import functions as F

from reqguard.config import LIVE
from reqguard.operators import features as FT
from reqguard.sources import logs, tables
from reqguard.sources import requests as RQ


def test_ingest_fills_defaults_and_rejects_bad_rows(spark, tmp_path):
    lines = [json.dumps({"ip": "1.1.1.1", "path": "/LOGIN", "method": "POST", "payload": "Failed", "timestamp": "2026-01-02 03:04:05"}),
             json.dumps({"ip": "2.2.2.2"}), "{}", "{broken"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    good, bad = RQ.ingest(spark.read, str(tmp_path))
    rows = {r["ip"]: r for r in good.collect()}
    assert set(rows) == {"1.1.1.1", "2.2.2.2"} and bad.count() == 2
    assert rows["1.1.1.1"]["is_failed_login"] and str(rows["1.1.1.1"]["ts"]) == "2026-01-02 03:04:05"
    r = rows["2.2.2.2"]
    assert (r["path"], r["method"], r["payload"], r["user_agent"], r["payload_size"]) == ("/", "GET", "", "", 0) and r["ts"]


def test_epoch_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00.123456' AS ts")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert df.select(RQ.epoch_us(F.col("ts"))).first()[0] == 1711852200123456
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scan_of_both_log_formats(spark):
    lines = ["2025-01-02 03:04:05,678 | SOURCE: 10.1.2.3 | ENDPOINT: /x | RISK: LOW | DECISION: ALLOW",
             "2025-01-02 03:04:06,000 | PROXY_CRASH | 'gone'", "Traceback (most recent call last):", "ValueError: bad", "",
             "2025-01-02 03:04:07,001 | IP: 10.1.2.4 | PATH: / | SCORE: 2.8 | DECISION: block | FORWARD: http://10.9.9.9:80/"]
    known, other = logs.scan_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((r["decision"], r["path"], r["risk"], r["score"], r["forward"]) for r in known.collect())
    assert got == [("ALLOW", "/x", "LOW", None, None), ("BLOCK", "/", None, 2.8, "http://10.9.9.9:80/")]
    assert other.count() == 4


def test_upsert_keeps_first_creation(spark):
    def df(*rows):
        return spark.createDataFrame(list(rows), "ip string, t_us long, event_id long, v long, created_us long")
    out = tables.upsert(df(("a", 1, 1, 10, 1), ("b", 1, 2, 11, 1)), df(("a", 5, 3, 20, 5), ("a", 4, 4, 30, 4), ("c", 6, 5, 40, 6)), ["ip"])
    assert {r["ip"]: (r["v"], r["created_us"]) for r in out.collect()} == {"a": (20, 1), "b": (11, 1), "c": (40, 6)}


def test_snapshots_are_versioned(spark, tmp_path):
    path = str(tmp_path / "state")
    assert tables.load_snapshot(spark, path) is None
    for n in (1, 2, 3):
        tables.save_snapshot(spark.range(n), path)
    (tmp_path / "state" / "v=9").mkdir()  # a write that did not finish
    assert tables.load_snapshot(spark, path).count() == 3
    assert tables.load_snapshot(spark, path, before=3).count() == 2


def test_append_is_partitioned_by_day(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 86_400_000_000)], "event_id long, t_us long")
    logs.append(df, str(tmp_path / "log"))
    logs.append(df, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == 4 and sorted(str(r[0]) for r in got.select("dt").distinct().collect()) == ["1970-01-01", "1970-01-02"]


def test_decoy_types_and_payload(spark):
    rows = [("/admin", "POST", "LOGIN_ATTEMPT"), ("/admin", "GET", "PAGE_VIEW"), ("/api/users/7", "GET", "DATA_ACCESS"),
            ("/.env", "GET", "ENV_ACCESS"), ("/wp-login.php", "POST", "SCANNER_ACCESS"), ("/backup", "GET", "ACCESS")]
    df = spark.createDataFrame(rows, "endpoint string, method string, want string")
    assert df.filter(logs.interaction_type(F.col("endpoint"), F.col("method")) != F.col("want")).count() == 0
    body = spark.createDataFrame([(bytearray(b"ok\xff"),), (None,), (bytearray(b"x" * 3000),)], "b binary")
    got = [r[0] for r in body.select(logs.decode_payload(F.col("b"))).collect()]
    assert got[0] == "ok�" and got[1] == "" and len(got[2]) == 3000


def test_ingested_requests_have_ids_that_last(spark, tmp_path):
    lines = [{"ip": f"10.0.0.{i % 3}", "path": f"/p{i % 4}", "timestamp": f"2026-01-01 00:00:{i % 60:02d}.{i % 5:06d}", "status_code": 401} for i in range(300)]
    lines += [{"ip": "same", "path": "/x", "timestamp": "2026-01-01 00:00:00"}] * 200 + [{"ip": "other", "timestamp": "2026-01-01 00:00:00", "session_id": "s"}]
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    first = RQ.ingest_requests(spark.read, str(tmp_path))
    rows = first.collect()
    assert len(rows) == 2 * len(lines) == len({r["event_id"] for r in rows})
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # the files fall into many splits
        again = RQ.ingest_requests(spark.read, str(tmp_path))
        assert again.rdd.getNumPartitions() > 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {(r["status_code"], r["session_id"], r["method"]) for r in rows if r["ip"] == "other"} == {(200, "s", "GET")}
    assert {r["t_us"] % 1_000_000 for r in rows if r["ip"] == "10.0.0.0"} == {0, 1, 2, 3, 4}
    seen = FT.features(first, LIVE).agg(F.max("requests_in_window"), F.sum("failure_count")).first()
    assert seen[0] == 400 and seen[1] > 0
