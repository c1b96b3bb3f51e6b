"""Per-identity memory: cumulative counts, last-50 frames, deviation, decoy intent, fingerprints and telemetry."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqguard.config import Config
from reqguard.functions import scoring, text
from reqguard.operators.running import block_window, rank_blocks, running
from reqguard.session import stage

LAST_ROWS = 50
DWELL_US = 60_000_000


def identified(requests: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Requests with ``fingerprint``, ``identity`` (fingerprint or ip), ``deceptive`` and ``failed_login``."""
    c = F.col
    out = requests.withColumns({
        "fingerprint": text.fingerprint(c("user_agent"), c("endpoint"), c("method"), c("payload")),
        "deceptive": text.deceptive_route(c("endpoint")),
        "failed_login": text.failed_login(c("method"), c("endpoint"), c("payload"))})
    return out.withColumn("identity", c(key))


def first_seen_steps(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """One row per (keys, value) at its first occurrence, to be counted by a running sum of ``name``."""
    first = (rows.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value)
             .agg(F.min(F.struct("t_us", "event_id")).alias("f")))
    return first.select(*keys, "f.*", F.lit(0).alias("sub"), F.lit(1).cast("long").alias(name))


COUNTS = ["total_requests", "sensitive_hits", "failed_logins", "unique_agents", "repeats", "fake_posts", "dwells",
          "dwell_us"]


def identity_rows(requests: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The narrow columns of each request that identity memory is built from."""
    c = F.col
    return identified(requests, key).select(
        "event_id", "t_us", "identity", "user_agent", "endpoint",
        c("deceptive").cast("long").alias("hit"), c("failed_login").cast("long").alias("failed"),
        (c("deceptive") & (c("method") == "POST")).cast("long").alias("fake_post"),
        F.length("payload").cast("long").alias("payload_size"))


def behavior_memory(requests: DataFrame, cfg: Config, key: str = "fingerprint") -> DataFrame:
    """What is known of each request's identity at that request, itself included.

    Cumulative counts and decoy counts are running sums over the identity's time segments; the last 50 rows are a row
    frame over blocks of numbered rows.
    """
    return remember(identity_rows(requests, key), cfg)


def remember(rows: DataFrame, cfg: Config, known_agents: DataFrame | None = None) -> DataFrame:
    """Memory over ``identity_rows``; agents in ``known_agents`` (identity, user_agent) are not counted as new."""
    c = F.col
    last_hit = F.when(c("hit") == 1, F.struct("t_us", "event_id", "endpoint"))
    known = stage(running(rows, ["identity"], {
        "total_requests": ("sum", F.lit(1).cast("long")), "sensitive_hits": ("sum", c("hit")),
        "failed_logins": ("sum", c("failed")), "first_us": ("min", c("t_us")),
        "last_hit": ("max", last_hit, "before")}, cfg.segment_us), "identity-counts")

    blocks = rank_blocks(known, "total_requests", cfg.block_rows, LAST_ROWS)
    order = block_window(["identity"], "total_requests")
    last50 = order.rowsBetween(-(LAST_ROWS - 1), 0)
    gaps = order.rowsBetween(-(LAST_ROWS - 2), 0)
    gap = c("t_us") - c("t1")
    framed = (blocks.withColumn("t1", F.lag("t_us").over(order)).withColumn("gap_us", gap)
              .withColumns({
                  "times": F.collect_list("t_us").over(last50), "paths": F.collect_set("endpoint").over(last50),
                  "n_gaps": F.count("gap_us").over(gaps), "gap_sum_us": F.sum("gap_us").over(gaps),
                  "gap_var": F.var_pop(c("gap_us") / 1e6).over(gaps)})
              .filter(~c("_ghost"))
              .withColumns({
                  "burst_density": F.size(F.filter("times", lambda t: t > c("t_us") - cfg.burst_us)).cast("long"),
                  "endpoint_diversity": F.size("paths").cast("long"),
                  "n_recent": F.least(c("total_requests"), F.lit(LAST_ROWS))})
              .drop("times", "paths", "_blk", "_ghost", "t1", "gap_us"))

    dwell = c("t_us") - c("last_hit.t_us")
    quick = (c("hit") == 1) & (dwell < DWELL_US)
    steps = framed.withColumns({
        "sub": F.lit(1), "agent_step": F.lit(0).cast("long"),
        "repeat": F.when((c("hit") == 1) & (c("last_hit.endpoint") == c("endpoint")), 1).otherwise(0).cast("long"),
        "dwell_step": F.when(quick, 1).otherwise(0).cast("long"),
        "dwell_us_step": F.when(quick, dwell).otherwise(0)}).drop("last_hit")
    agents = known.select("identity", "user_agent", "t_us", "event_id")
    if known_agents is not None:
        agents = agents.join(known_agents, ["identity", "user_agent"], "left_anti")
    steps = steps.unionByName(first_seen_steps(agents, ["identity"], "user_agent", "agent_step"),
                              allowMissingColumns=True)
    out = running(steps, ["identity"], {
        "unique_agents": ("sum", c("agent_step")), "repeats": ("sum", c("repeat")), "fake_posts": ("sum", c("fake_post")),
        "dwells": ("sum", c("dwell_step")), "dwell_us": ("sum", c("dwell_us_step"))},
        cfg.segment_us, ("t_us", "event_id", "sub"))
    return out.filter(c("sub") == 1).select(
        "event_id", "t_us", "identity", "hit", "payload_size", "total_requests", "sensitive_hits", "failed_logins",
        "first_us", "unique_agents", "n_recent", "endpoint_diversity", "burst_density", "n_gaps", "gap_sum_us",
        "gap_var", "repeats", "fake_posts", "dwells", "dwell_us")


def remember_more(new: DataFrame, kept: DataFrame | None, agents: DataFrame | None, cfg: Config) -> DataFrame:
    """Memory of new ``identity_rows`` after earlier ones.

    ``kept`` holds, per identity, its last 50 earlier rows and its last decoy hit, with the memory at each of them. New
    rows see these rows in their frames; cumulative counts continue from the newest kept row.
    """
    c = F.col
    if kept is None:
        return remember(new, cfg)
    rows = new.withColumn("old", F.lit(False)).unionByName(
        kept.select(*new.columns).join(new.select("identity").distinct(), "identity", "left_semi")
        .withColumn("old", F.lit(True)))
    both = stage(remember(rows.drop("old"), cfg, agents), "memory")
    newest = F.max_by(F.struct(*COUNTS, "first_us"), F.struct("t_us", "event_id"))
    base = kept.groupBy("identity").agg(newest.alias("base"))
    again = both.join(kept.select("event_id"), "event_id", "left_semi").groupBy("identity").agg(newest.alias("again"))
    offset = base.join(again, "identity")
    out = both.join(new.select("event_id"), "event_id", "left_semi").join(offset, "identity", "left")
    moved = {n: c(n) + F.coalesce(c(f"base.{n}") - c(f"again.{n}"), F.lit(0)) for n in COUNTS}
    return out.withColumns({**moved, "first_us": F.least("first_us", "base.first_us")}).drop("base", "again").withColumn(
        "n_recent", F.least(c("total_requests"), F.lit(LAST_ROWS)))


def rows_to_keep(kept: DataFrame | None, new: DataFrame, memory: DataFrame) -> DataFrame:
    """The rows ``remember_more`` needs next time: last 50 and last decoy hit per identity, with their memory."""
    rows = new.join(memory.select("event_id", *COUNTS, "first_us"), "event_id")
    both = rows if kept is None else kept.unionByName(rows.select(*kept.columns))
    last = newest_per_key(both, ["identity"], LAST_ROWS)
    hit = newest_per_key(both.filter("hit = 1"), ["identity"], 1)
    return last.unionByName(hit).distinct()


def behavior_deviation(memory: DataFrame) -> DataFrame:
    """Add ``deviation`` (0-100): agents, bursts, decoy share, failed logins and regular timing."""
    c = F.col
    ratio = c("sensitive_hits") / c("total_requests")
    regular = (c("n_gaps") > 5) & (c("gap_var") < 0.05) & (c("gap_sum_us") / c("n_gaps") / 1e6 < 2.0)
    score = (F.when(c("unique_agents") > 2, c("unique_agents") * 15.0).otherwise(0.0)
             + F.when(c("burst_density") > 10, F.least((c("burst_density") - 10) * 2.0, F.lit(40.0))).otherwise(0.0)
             + F.when((c("total_requests") > 5) & (ratio > 0.2), ratio * 50.0).otherwise(0.0)
             + c("failed_logins") * 10.0 + F.when(regular, 30.0).otherwise(0.0))
    return memory.withColumn("deviation", F.least(score, F.lit(100.0)))


def deception_intent(memory: DataFrame) -> DataFrame:
    """Add ``deception`` (0-100) from the identity's decoy hits so far; other requests carry the last score."""
    c = F.col
    fast = (c("dwells") > 0) & (c("dwell_us") / c("dwells") / 1e6 < 5.0)
    score = (c("sensitive_hits") * 15.0 + c("repeats") * 20.0 + c("fake_posts") * 40.0
             + F.when(fast, 30.0).otherwise(0.0))
    return memory.withColumn("deception", F.least(score, F.lit(100.0)))


def telemetry(memory: DataFrame) -> DataFrame:
    """Add the eight telemetry features used by the anomaly model (two of them are constant zero)."""
    c = F.col
    minutes = F.greatest((c("t_us") - c("first_us")) / 1e6 / 60, F.lit(1.0))
    return memory.withColumns({
        "requests_per_minute": c("n_recent") / minutes,
        "sensitive_route_ratio": c("sensitive_hits") / c("total_requests"),
        "avg_interval": c("gap_sum_us").cast("double") / 1e6 / F.greatest(c("n_gaps"), F.lit(1)),
        "payload_entropy": F.lit(0.0), "failed_auth_ratio": c("failed_logins") / c("total_requests"),
        "probe_density": c("burst_density").cast("double"), "header_rarity": F.lit(0.0),
    }).withColumn("avg_interval", F.coalesce("avg_interval", F.lit(0.0)))


TELEMETRY = ["requests_per_minute", "endpoint_diversity", "sensitive_route_ratio", "avg_interval", "payload_entropy",
             "failed_auth_ratio", "probe_density", "header_rarity"]


def fingerprints(requests: DataFrame, cfg: Config) -> DataFrame:
    """Per request: its fingerprint, the number of ips that used it so far, and the confidence in it."""
    rows = identified(requests).select("event_id", "t_us", "fingerprint", "ip")
    steps = rows.withColumn("sub", F.lit(1)).unionByName(
        first_seen_steps(rows, ["fingerprint"], "ip", "ip_step"), allowMissingColumns=True)
    seen = running(steps, ["fingerprint"], {"ips_seen": ("sum", F.col("ip_step"))}, cfg.segment_us,
                   ("t_us", "event_id", "sub")).filter(F.col("sub") == 1)
    many = F.least(F.lit(1.0), F.lit(0.5) + F.col("ips_seen") * 0.1)
    return seen.select("event_id", "t_us", "fingerprint", "ips_seen",
                       F.when(F.col("ips_seen") > 1, many).otherwise(0.5).alias("confidence"))


MINUTE_US = 60_000_000


def newest(df: DataFrame, n: int, order=("t_us", "event_id")) -> DataFrame:
    """The newest n rows, newest first.

    Rows are first counted per minute, and only the minutes that can hold the newest n are sorted. Otherwise every input
    split would send n rows to the one task that ends a top-n; as a filter on time the bound also prunes files.
    """
    c = F.col
    minute = F.expr(f"{order[0]} div {MINUTE_US}")
    per_minute = df.groupBy(minute.alias("minute")).agg(F.count("*").alias("n"))
    after = Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, 0)  # one row per minute
    enough = per_minute.withColumn("seen", F.sum("n").over(after)).filter(c("seen") >= n).agg(F.max("minute")).first()[0]
    recent = df if enough is None else df.filter(c(order[0]) >= enough * MINUTE_US)
    return recent.orderBy(*[F.desc(x) for x in order]).limit(n)


def newest_per_key(df: DataFrame, keys: list[str], n: int, order=("t_us", "event_id")) -> DataFrame:
    """The newest n rows per key; Spark keeps n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
