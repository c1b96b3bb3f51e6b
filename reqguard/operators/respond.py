"""Automatic responses, their state over time, and which state was in force at each request."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import SECOND, Config
from reqguard.operators.running import running


def response_actions(decisions: DataFrame) -> DataFrame:
    """Add ``responses`` (array) and expiry times to decisions (anomaly, repeat, endpoint, matched, action)."""
    c = F.col
    path, action, repeat, anomaly = c("endpoint"), c("action"), c("repeat"), c("anomaly")
    lock = path.isin(C.LOCKABLE_ROUTES) & ((anomaly > 0.8) | (repeat > 5) | (action == "block"))
    throttle = F.lower(path).contains("login") & action.isin("throttle", "block") & (repeat > 3)
    sanitize = F.array_contains("matched", "XSS") | (anomaly > 0.9)
    rotate = path.contains("/config") | path.contains("/backup") | (action == "deception_flag")
    named = [
        (lock, F.concat(F.lit("temporary_route_lock("), path, F.lit(")"))),
        (lock & (path != "/login"), F.lit("emergency_maintenance_banner")),
        (throttle, F.lit("login_throttle")),
        (sanitize, F.lit("payload_sanitize_mode")),
        ((repeat > 8) | (action == "quarantine"), F.lit("fingerprint_quarantine")),
        (rotate, F.lit("secret_rotation")),
        (rotate, F.lit("deception_intensify")),
    ]
    duration = F.floor((F.lit(1.0) + repeat / 10.0) * 300.0)
    out = decisions.withColumn("responses", F.filter(F.array(*[F.when(cond, name) for cond, name in named]),
                                                     lambda x: x.isNotNull()))
    return out.withColumns({
        "until_us": c("t_us") + duration * SECOND,
        "throttle_until_us": c("t_us") + (F.lit(300) + F.floor(repeat * 30)) * SECOND})


def healing_state(responses: DataFrame, now_us: Column) -> DataFrame:
    """Rows (what, item, until_us, n) of everything in force at ``now_us``.

    Locked routes and throttled or quarantined fingerprints are one row each; the sanitize and decoy modes are rows
    while they last; ``secret_version`` counts rotations from 1.
    """
    c = F.col
    taken = (responses.filter(c("t_us") <= now_us).withColumn("response", F.explode("responses")))
    kind = F.regexp_extract("response", r"^([a-z_]+)", 1)
    names = {"temporary_route_lock": "locked_route", "login_throttle": "throttled", "payload_sanitize_mode":
             "sanitize_mode", "fingerprint_quarantine": "quarantined", "secret_rotation": "secret_version",
             "deception_intensify": "deception_mode"}
    what = F.lit(None).cast("string")
    for response, name in names.items():
        what = F.when(kind == response, name).otherwise(what)
    item = (F.when(c("what") == "locked_route", c("endpoint"))
            .when(c("what").isin("throttled", "quarantined"), c("fingerprint")).otherwise(""))
    until = F.when(c("what") == "throttled", c("throttle_until_us")).when(
        c("what").isin("quarantined", "secret_version"), F.lit(None).cast("long")).otherwise(c("until_us"))
    state = (taken.withColumn("what", what).filter(c("what").isNotNull())
             .withColumns({"item": item, "until": until}).groupBy("what", "item")
             .agg(F.max_by("until", F.struct("t_us", "event_id")).alias("until_us"), F.count("*").alias("n")))
    # a mode stays on at its very end, a lock or throttle does not
    mode = c("what").isin("sanitize_mode", "deception_mode")
    live = state.filter(c("until_us").isNull() | (c("until_us") > now_us) | (mode & (c("until_us") == now_us)))
    return live.withColumn("n", F.when(c("what") == "secret_version", c("n") + 1).otherwise(c("n")))


def block_ops(requests: DataFrame, duration_s: int = 86_400) -> DataFrame:
    """Block operations of the sample view: some errors block the ip for a day, some signups unblock it."""
    c = F.col
    ops = requests.filter((c("k") % 10 == 0) & c("event_type").isin("error", "signup"))
    block = c("event_type") == "error"
    return ops.select(
        "ip", F.when(block, "block").otherwise("unblock").alias("op"), F.lit("risk").alias("reason"), "t_us",
        "event_id", F.when(block, c("t_us") + duration_s * SECOND).alias("expires_us"),
        F.lit(False).alias("is_permanent"), F.lit(0.0).alias("risk_score"))


def state_in_force(requests: DataFrame, ops: DataFrame, cfg: Config) -> DataFrame:
    """Per request (ip, t_us, event_id): the last block operation before it and whether it still holds.

    Requests and operations are put on one timeline per ip, and the latest operation is carried along it.
    """
    c = F.col
    op = F.struct("t_us", F.col("event_id").alias("id"), (c("op") == "block").alias("block"), "expires_us",
                  "is_permanent")
    timeline = (requests.select("ip", "t_us", "event_id").withColumn("is_request", F.lit(True))
                .unionByName(ops.select("ip", "t_us", "event_id", op.alias("state"))
                             .withColumn("is_request", F.lit(False)), allowMissingColumns=True)
                .withColumn("turn", F.when(c("is_request"), 0).otherwise(1)))
    seen = running(timeline, ["ip"], {"last": ("max", c("state"))}, cfg.segment_us, ("t_us", "event_id", "turn"))
    s = c("last")
    expired = F.coalesce(c("t_us") > s["expires_us"], F.lit(False))
    blocked = F.coalesce(s["block"] & (s["is_permanent"] | ~expired), F.lit(False))
    return seen.filter("is_request").select(
        "event_id", "ip", "t_us", F.when(s["block"], s["t_us"]).alias("blocked_us"),
        F.when(s["block"], s["expires_us"]).alias("expires_us"), blocked.alias("is_blocked"))


def active_blocks(blocks: DataFrame, now_us: Column) -> DataFrame:
    """Blocks in force at ``now_us``, newest first."""
    live = F.col("is_permanent") | F.coalesce(F.col("expires_us") > now_us, F.lit(False))
    return blocks.filter(live).orderBy(F.desc("t_us"), F.desc("event_id"))


def is_blocked(keys: DataFrame, blocks: DataFrame, now_us: Column) -> DataFrame:
    """Whether each listed ip is blocked at ``now_us``: a block still holds at the moment it expires, or without one."""
    b = blocks.select("ip", "expires_us", "is_permanent", F.lit(True).alias("_known"))
    c = F.col
    holds = c("_known") & (c("is_permanent") | ~F.coalesce(now_us > c("expires_us"), F.lit(False)))
    return keys.join(b, "ip", "left").withColumn("is_blocked", F.coalesce(holds, F.lit(False))).drop("_known")


def defense_state(changes: DataFrame, key: str = "id") -> DataFrame:
    """Last defense level per id from the log of changes (level, rate_limit, reason, t_us, event_id)."""
    return changes.groupBy(key).agg(F.max_by(F.struct("level", "rate_limit", "reason", "t_us"),
                                             F.struct("t_us", "event_id")).alias("s")).select(key, "s.*")
