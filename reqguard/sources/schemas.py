"""Explicit schemas of the input and state tables."""

from pyspark.sql import types as T

INGEST = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("status_code", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("response_time_ms", T.DoubleType()),
    T.StructField("_corrupt_record", T.StringType()),
])

REQUEST_LOG = T.StructType([
    T.StructField("ip_address", T.StringType(), False),
    T.StructField("user_agent", T.StringType()),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("status_code", T.LongType()),
    T.StructField("payload_hash", T.StringType()),
    T.StructField("payload_flags", T.ArrayType(T.StringType())),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("session_id", T.StringType()),
    T.StructField("response_time_ms", T.DoubleType()),
])

HONEYPOT_LOG = T.StructType([
    T.StructField("ip_address", T.StringType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("session_id", T.StringType()),
    T.StructField("interaction_type", T.StringType()),
])

RULES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("rule_type", T.StringType(), False),
    T.StructField("pattern", T.StringType()),
    T.StructField("action", T.StringType(), False),
    T.StructField("severity", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("triggered_count", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_us", T.LongType()),
    T.StructField("expires_us", T.LongType()),
    T.StructField("auto_generated", T.BooleanType()),
    T.StructField("description", T.StringType()),
])

BLOCK_OPS = T.StructType([
    T.StructField("ip", T.StringType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("reason", T.StringType()),
    T.StructField("t_us", T.LongType(), False),
    T.StructField("event_id", T.LongType(), False),
    T.StructField("expires_us", T.LongType()),
    T.StructField("is_permanent", T.BooleanType()),
    T.StructField("risk_score", T.DoubleType()),
])

SYSTEM_EVENTS = T.StructType([
    T.StructField("event_type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("source_ip", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("t_us", T.LongType(), False),
])
