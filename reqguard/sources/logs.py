"""Log tables written from requests, and scans of decision logs kept as text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.functions import text


def log_requests(requests: DataFrame) -> DataFrame:
    """Request-log rows: payload hash and payload flags instead of the payload."""
    return requests.select(
        F.col("event_id"), F.col("ip").alias("ip_address"), "user_agent", "endpoint", "method", "status_code",
        F.substring(F.md5("payload"), 1, 16).alias("payload_hash"),
        text.payload_flags(F.col("payload")).alias("payload_flags"),
        "t_us", "session_id", "response_time_ms")


def append(log: DataFrame, path: str) -> None:
    """Append log rows to parquet, one folder per day, so that time filters prune folders."""
    day = F.date_from_unix_date((F.expr("t_us div 86400000000")).cast("int"))
    log.withColumn("dt", day).write.mode("append").partitionBy("dt").parquet(path)


def interaction_type(endpoint: Column, method: Column) -> Column:
    """Kind of decoy interaction by route and method; ``ACCESS`` for other routes."""
    kind = F.when(endpoint == "/admin", F.when(method == "POST", "LOGIN_ATTEMPT").otherwise("PAGE_VIEW"))
    for route, name in C.DECOY_TYPES:
        kind = kind.when(endpoint == route, name)
    return kind.when(endpoint.rlike(r"^/api/users/\d+$"), "DATA_ACCESS").otherwise("ACCESS")


def honeypot_log(requests: DataFrame) -> DataFrame:
    """Decoy-log rows: requests to a deceptive route, with their headers as JSON where the requests have them (a map)."""
    hits = requests.filter(text.deceptive_route(F.col("endpoint")))
    headers = F.to_json("headers") if "headers" in requests.columns else F.lit(None).cast("string")
    return hits.select(
        "event_id", F.col("ip").alias("ip_address"), "endpoint", "method", headers.alias("headers"),
        "payload", "user_agent", "t_us", "session_id",
        interaction_type(F.col("endpoint"), F.col("method")).alias("interaction_type"))


def decode_payload(body: Column) -> Column:
    """Decoy payload text from raw request bytes: invalid bytes become the replacement character."""
    decoded = F.make_valid_utf8(body.cast("string"))
    return F.when(body.isNull(), "").otherwise(F.coalesce(decoded, F.lit("<unparseable>")))


def _event(df: DataFrame, kind: str, severity: Column, source: Column, description: Column, meta: Column) -> DataFrame:
    return df.select("event_id", F.lit(kind).alias("event_type"), severity.alias("severity"),
                     source.alias("source_ip"), description.alias("description"), meta.alias("metadata"), "t_us")


def payload_alerts(requests: DataFrame) -> DataFrame:
    flags = text.payload_flags(F.col("payload"))
    found = requests.withColumn("flags", flags).filter(F.size("flags") > 0)
    high = F.arrays_overlap("flags", F.array(F.lit("SQL_INJECTION"), F.lit("COMMAND_INJECTION")))
    return _event(found, "PAYLOAD_ALERT", F.when(high, "HIGH").otherwise("MEDIUM"), F.lit(None).cast("string"),
                  F.concat(F.lit("flags in payload: "), F.array_join("flags", ",")), F.lit("{}"))


def honeypot_events(log: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct("user_agent", F.col("interaction_type").alias("type")))
    return _event(log, "HONEYPOT_INTERACTION", F.lit("HIGH"), F.col("ip_address"),
                  F.concat_ws(" ", F.lit("decoy hit"), F.col("method"), F.col("endpoint")), meta)


def risk_escalations(scores: DataFrame) -> DataFrame:
    """Events for scores (ip, t_us, event_id, score, risk_level and component scores) in the two upper levels."""
    up = scores.filter(F.col("risk_level").isin("SUSPICIOUS", "MALICIOUS"))
    meta = F.to_json(F.struct(F.struct(
        F.col("freq_score").alias("frequency"), F.col("failure_score").alias("failure"),
        F.col("pattern_score").alias("pattern"), F.col("payload_score").alias("payload")).alias("score_breakdown")))
    return _event(up, "RISK_ESCALATION", F.when(F.col("risk_level") == "MALICIOUS", "HIGH").otherwise("WARNING"),
                  F.col("ip"), F.concat(F.col("risk_level"), F.lit(" at score "), F.format_string("%.1f", F.col("score"))), meta)


def healing_events(rules: DataFrame) -> DataFrame:
    """One event per (ip, time) at which rules were generated; rules has ip, t_us, event_id, kind."""
    made = rules.groupBy("event_id", "ip", "t_us").agg(F.count("*").alias("n"))
    return _event(made, "SELF_HEALING", F.lit("HIGH"), F.col("ip"),
                  F.concat(F.lit("rules made: "), F.col("n").cast("string")), F.lit("{}"))


def injected_rule_events(rules: DataFrame) -> DataFrame:
    """Events for mined rules that were injected; rules has rule_name, severity, pattern, description, created_us."""
    rows = rules.withColumns({"event_id": F.lit(None).cast("long"), "t_us": F.col("created_us")})
    return _event(rows, "GEN_RULE_INJECTED", F.col("severity"), F.lit(None).cast("string"),
                  F.concat(F.lit("mined rule added: "), F.col("rule_name")),
                  F.to_json(F.struct("pattern", F.col("description").alias("desc"))))


SECURITY_LINE = (r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \| SOURCE: (.*?) \| ENDPOINT: (.*?) \| RISK: (.*?)"
                 r" \| DECISION: (.*)$")
PROXY_LINE = (r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) \| IP: (.*?) \| PATH: (.*?) \| SCORE: (.*?)"
              r" \| DECISION: (.*?) \| FORWARD: (.*)$")


def scan_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split text lines (column ``value``) into decision records of either log format and all other lines."""
    line = F.col("value")

    def part(i):
        return (F.when(line.rlike(SECURITY_LINE), F.regexp_extract(line, SECURITY_LINE, i))
                .when(line.rlike(PROXY_LINE), F.regexp_extract(line, PROXY_LINE, i)))

    known = line.rlike(SECURITY_LINE) | line.rlike(PROXY_LINE)
    records = lines.filter(known).select(
        F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"), part(2).alias("ip"),
        part(3).alias("path"), F.when(line.rlike(SECURITY_LINE), part(4)).alias("risk"),
        F.when(line.rlike(PROXY_LINE), part(4)).try_cast("double").alias("score"),
        F.upper(part(5)).alias("decision"),
        F.when(line.rlike(PROXY_LINE), F.regexp_extract(line, PROXY_LINE, 6)).alias("forward"))
    return records, lines.filter(~known)
