"""Request sources: JSON ingest and the request view over the sample events."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqguard.functions import text
from reqguard.sources.schemas import INGEST

# ---- fixed values of the request view: agents, payloads and paths picked by the sample's k
CHROME = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0"
AGENTS = [CHROME, "Mozilla/5.0", "Nikto/2.1.6", "python-flood/1.0", "", "curl/8.0"]
PAYLOADS = [
    "' OR 1=1 --",
    "'; DROP TABLE users; --",
    "' UNION SELECT username, password FROM users --",
    "admin'--",
    "1; DELETE FROM sessions WHERE 1=1",
    "' OR ''='",
    '<script>alert("xss")</script>',
    "<img src=x onerror=alert(1)>",
    "javascript:alert(document.cookie)",
    "../../etc/passwd",
    "; cat /etc/shadow",
    "username=admin&password=12345 failed",
]
CLICK_PATHS = ["/", "/api/status", "/api/health", "/api/data", "/search", "/cart", "/backup", "/config"]
ERROR_PATHS = ["/login", "/admin", "/.env", "/debug"]
ERROR_CODES = [401, 403, 422, 500]
ERROR_METHODS = ["DELETE", "POST", "GET"]


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC whatever the session's zone is."""
    seconds = F.unix_date(ts.cast("date")) * F.lit(86400) + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def requests(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Requests derived from the events table: one row per event. With spread, rows are dealt by id first, for an input
    of few splits."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.repartition("event_id") if spread else events
    k, kind = F.col("k"), F.col("event_type")
    view = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    method = (F.when(kind.isin("purchase", "signup"), "POST")
              .when(kind == "error", _pick(ERROR_METHODS, k % 3)).otherwise("GET"))
    endpoint = (F.when(kind == "view", F.concat(F.lit("/api/users/"), k.cast("string")))
                .when(kind == "click", _pick(CLICK_PATHS, k % 8))
                .when(kind == "signup", "/login").when(kind == "purchase", "/api/data")
                .otherwise(_pick(ERROR_PATHS, k % 4)))
    return view.select(
        "event_id", "user_id", epoch_us(F.col("ts")).alias("t_us"),
        F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256).alias("ip"),
        method.alias("method"), endpoint.alias("endpoint"),
        F.when(kind == "error", _pick(ERROR_CODES, k % 4)).otherwise(200).cast("long").alias("status_code"),
        _pick(AGENTS, F.when(k < 70, k % 2).otherwise(k % 6)).alias("user_agent"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 5).cast("string")).alias("session_id"),
        F.when((kind == "error") | (k >= 90), _pick(PAYLOADS, k % 12)).otherwise("").alias("payload"),
        F.col("value").alias("response_time_ms"), k.cast("long").alias("k"), kind.alias("event_type"))


def with_defaults(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Fill missing request fields and flag failed logins; ``now`` stands in for a missing timestamp. Timestamps have
    seconds, or also six digits of them."""
    now = F.current_timestamp() if now is None else now
    given = [c for c in ("_file",) if c in raw.columns]
    out = raw.select(
        *given, F.coalesce("status_code", F.lit(200).cast("long")).alias("status_code"), F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("response_time_ms", F.lit(0.0)).alias("response_time_ms"),
        F.coalesce("ip", F.lit("")).alias("ip"), F.coalesce("path", F.lit("/")).alias("path"),
        F.coalesce("method", F.lit("GET")).alias("method"), F.coalesce("user_agent", F.lit("")).alias("user_agent"),
        F.coalesce("payload", F.lit("")).alias("payload"),
        F.coalesce(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")), now).alias("ts"))
    return out.withColumns({
        "payload_size": F.length("payload").cast("long"),
        "is_failed_login": text.failed_login(F.col("method"), F.col("path"), F.col("payload"))})


def ingest(reader, path: str) -> tuple[DataFrame, DataFrame]:
    """Read request JSON lines with ``spark.read`` or ``spark.readStream``; returns (requests, rejected rows)."""
    raw = reader.schema(INGEST).option("mode", "PERMISSIVE").json(path)
    fields = ["ip", "path", "method", "user_agent", "payload", "timestamp"]
    empty = F.coalesce(*[F.col(c) for c in fields]).isNull()
    bad = F.col("_corrupt_record").isNotNull() | empty
    return with_defaults(raw.filter(~bad)), raw.filter(bad).select(*fields, "_corrupt_record")


def ingest_requests(reader, path: str, now: Column | None = None) -> DataFrame:
    """The requests of JSON lines as the operators take them, with ids of their own (`with_event_ids`)."""
    raw = reader.schema(INGEST).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_path").alias("_file"))
    fields = ["ip", "path", "method", "user_agent", "payload", "timestamp"]
    good = raw.filter(F.col("_corrupt_record").isNull() & F.coalesce(*[F.col(c) for c in fields]).isNotNull())
    return with_event_ids(with_defaults(good, now))


def with_event_ids(rows: DataFrame) -> DataFrame:
    """Ingested rows with their _file -> event_id, t_us, ip, method, endpoint, status_code, user_agent, session_id, payload
    and response_time_ms.

    An id is a hash of the file, the row's fields and its number among the equal rows of the file, so it is the same
    however often the file is read, in whatever splits, by a batch or (in foreachBatch) by a stream. A missing timestamp
    that is filled with the time of reading makes another id each time.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    fields = ["ip", "path", "method", "user_agent", "payload", "status_code", "session_id", "response_time_ms"]
    marked = rows.withColumn("t_us", micros).withColumn("_mark", F.xxhash64(*fields, "t_us"))
    equal = Window.partitionBy("_file", "_mark").orderBy(*fields)  # equal rows of one file
    return marked.withColumn("event_id", F.xxhash64("_file", "_mark", F.row_number().over(equal))).select(
        "event_id", "t_us", "ip", "method", F.col("path").alias("endpoint"), "status_code", "user_agent", "session_id", "payload", "response_time_ms")
