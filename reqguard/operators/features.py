"""Trailing-window behaviour features per request.

The features of a request look at its actor's rows in ``(t - window, t]``. Every count is kept as a running sum of
signed changes: a row adds its values when it arrives and takes them away when the window has passed it. Distinct
counts work the same way on the intervals during which a value is present. One ordered running sum per actor then gives
all features at once, in linear work, and ``running`` spreads a busy actor over its time segments.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import Config
from reqguard.functions import text
from reqguard.functions.rounding import round_half_up
from reqguard.operators.running import block_window, rank_blocks, running
from reqguard.session import stage

FLAGS = ["SQL_INJECTION", "XSS", "PATH_TRAVERSAL", "COMMAND_INJECTION"]
OLDEST_ROWS = 20
# row values that leave the short window together with their row
CARRIED = ["fail", "login_fail", "sensitive", "unusual"]
FLAG_COLS = [f"flag_{i}" for i in range(len(FLAGS))]


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def row_values(requests: DataFrame, key: str) -> DataFrame:
    """The narrow per-request numbers the features are built from."""
    ua = F.coalesce("user_agent", F.lit(""))
    fail = F.col("status_code").isin(C.FAILURE_CODES)
    flags = {c: _flag(text.flag_hit(F.col("low"), f)) for c, f in zip(FLAG_COLS, FLAGS)}
    out = requests.withColumn("low", F.lower(F.coalesce("payload", F.lit("")))).select(
        "event_id", "t_us", F.col(key).alias("key"),
        _flag(fail).alias("fail"), _flag(fail & text.contains_any(F.col("endpoint"), C.LOGIN_MARKERS)).alias("login_fail"),
        _flag(F.col("endpoint").isin(C.SENSITIVE_ENDPOINTS)).alias("sensitive"),
        _flag(F.col("method").isin(C.UNUSUAL_METHODS)).alias("unusual"),
        (ua == "").alias("no_agent"), text.bot_agent(ua).alias("bot_indicators"),
        *[c.alias(n) for n, c in flags.items()])
    return out.withColumn("n_flags", sum(F.col(c) for c in FLAG_COLS))


def numbered(rows: DataFrame, cfg: Config) -> DataFrame:
    """Add ``rn``, the row's number within its key in time order."""
    return running(rows, ["key"], {"rn": ("sum", F.lit(1).cast("long"))}, cfg.segment_us)


def presence_changes(requests: DataFrame, key: str, window_us: int) -> DataFrame:
    """Changes of the number of distinct endpoints, sessions, agents and number pairs present in the trailing window.

    Occurrences of a value within one window-long time cell overlap in presence, so they are first reduced to the
    first and last one per cell; what is left per value is at most one row per cell. A value is present from the first
    row of a run of cells until one window after the last. Requests without an endpoint show no values.
    """
    c = F.col
    values = F.array(*[F.struct(F.lit(what).alias("what"), c(column).alias("value")) for what, column in
                       (("endpoint", "endpoint"), ("session", "session_id"), ("agent", "user_agent"))])
    numbers = F.transform(text.path_numbers(c("endpoint")),
                          lambda n: F.struct(F.lit("number").alias("what"), n.alias("value")))

    def bounds(items):
        seen = (requests.filter(c("endpoint").isNotNull()).select(c(key).alias("key"), "t_us", "event_id", F.explode(items).alias("v"))
                .filter(F.col("v.value").isNotNull() & ((c("v.value") != "") | (c("v.what") == "endpoint")))
                .select("key", "t_us", "event_id", "v.what", "v.value"))
        seen = seen.withColumns({"hash": F.xxhash64("key", "what", "value"), "cell": F.expr(f"t_us div {window_us}")})
        cells = (seen.groupBy("hash", "key", "what", "value", "cell")
                 .agg(F.min(F.struct("t_us", "event_id")).alias("first"), F.max("t_us").alias("last")))
        w = Window.partitionBy("hash", "key", "what", "value").orderBy("cell")
        near = cells.withColumns({"prev_last": F.lag("last").over(w), "next_first": F.lead("first.t_us").over(w)})
        starts = F.when(c("prev_last").isNull() | (c("first.t_us") - c("prev_last") >= window_us),
                        F.struct(c("first.t_us").alias("at"), F.lit(1).alias("phase"),
                                 c("first.event_id").alias("event_id"), F.lit(1).alias("step")))
        ends = F.when(c("next_first").isNull() | (c("next_first") - c("last") >= window_us),
                      F.struct((c("last") + window_us).alias("at"), F.lit(0).alias("phase"),
                               F.lit(-1).cast("long").alias("event_id"), F.lit(-1).alias("step")))
        return (near.select("key", "what", "value", F.explode(F.array(starts, ends)).alias("b"))
                .filter(c("b").isNotNull()).select("key", "what", "value", "b.*"))

    plain = bounds(values)
    # neighbouring numbers n and n + 1 are both present while the two have arrived and neither has left
    pairs = bounds(numbers).withColumn("low", F.explode(F.array(c("value"), text.predecessor(c("value")))))
    wp = (Window.partitionBy(F.xxhash64("key", "low"), "key", "low").orderBy("at", "phase", "event_id")
          .rowsBetween(Window.unboundedPreceding, 0))
    both = pairs.withColumn("present", F.sum("step").over(wp)).filter(
        ((c("step") == 1) & (c("present") == 2)) | ((c("step") == -1) & (c("present") == 1)))
    return (plain.select("key", "what", "at", "phase", "event_id", "step")
            .unionByName(both.select("key", F.lit("pair").alias("what"), "at", "phase", "event_id", "step")))


def features(requests: DataFrame, cfg: Config, key: str = "ip") -> DataFrame:
    """All trailing-window features, one row per request: event_id, key, t_us and the feature columns."""
    c = F.col
    order = block_window(["key"], "rn")
    ranked = rank_blocks(numbered(row_values(requests, key), cfg), "rn", cfg.block_rows, OLDEST_ROWS)
    lagged = ranked.withColumns({
        "t1": F.lag("t_us", 1).over(order), "t3": F.lag("t_us", 3).over(order),
        "t20": F.lag("t_us", OLDEST_ROWS).over(order),
        **{f"p_{x}": F.lag(x, 1).over(order) for x in CARRIED}})
    base = stage(lagged.filter(~c("_ghost")).drop("_blk", "_ghost"), "features-rows")

    changes = ["n_short", "n_long", "n_burst", *CARRIED, *[f"old_{x}" for x in FLAG_COLS],
               "endpoint", "session", "agent", "pair"]

    def change(at: str, phase: int, sub: int, event: str = "-1L", first_left: str = "null", when: str = "true",
               **given) -> str:
        """SQL of one change on the timeline: when it happens, its place among equal times, and what it adds."""
        fields = {"at": at, "phase": phase, "event_id": event, "sub": sub, "next_first": f"cast({first_left} as bigint)",
                  **{n: f"cast({given.get(n, 0)} as bigint)" for n in changes}}
        return f"if({when}, named_struct({', '.join(f'{n!r}, {x}' for n, x in fields.items())}), null)"

    flags_in = {f"old_{x}": x for x in FLAG_COLS}
    flags_out = {f"old_{x}": f"-{x}" for x in FLAG_COLS}
    # a row is among the oldest 20 of a window once at most 19 older rows are left in it
    enter = f"greatest(t_us, coalesce(t20 + {cfg.short_us}, t_us))"
    rows = F.expr("array(" + ", ".join([
        change("t_us", 1, 1, "event_id", n_short=1, n_long=1, n_burst=1, **{x: x for x in CARRIED}),
        change(f"t1 + {cfg.short_us}", 0, 0, first_left="t_us", when="t1 is not null", n_short=-1,
               **{x: f"-p_{x}" for x in CARRIED}),
        change(f"t1 + {cfg.long_us}", 0, 0, when="t1 is not null", n_long=-1),
        change(f"t1 + {cfg.burst_us}", 0, 0, when="t1 is not null", n_burst=-1),
        change("t_us", 1, 0, "event_id", when=f"n_flags > 0 and {enter} = t_us", **flags_in),
        change(enter, 0, 0, when=f"n_flags > 0 and {enter} > t_us", **flags_in),
        change(f"t_us + {cfg.short_us}", 0, 0, when="n_flags > 0", **flags_out)]) + ")")
    own = ["rn", "t1", "t3", "n_flags", "no_agent", "bot_indicators", *FLAG_COLS]
    event_row = c("r.sub") == 1
    timeline = (base.select("key", "t_us", "fail", *own, F.explode(rows).alias("r")).filter(c("r").isNotNull())
                .select("key", "r.*", F.when(event_row, c("t_us")).alias("t_us"),
                        F.when(event_row & (c("fail") == 0), c("rn")).alias("ok_rn"),
                        *[F.when(event_row, c(x)).alias(x) for x in own]))
    # the totals and the rows of `running` each read them
    present = stage(presence_changes(requests, key, cfg.short_us), "presence").select(
        "key", "at", "phase", "event_id", F.lit(0).alias("sub"),
        *[F.when(c("what") == n, c("step")).otherwise(0).cast("long").alias(n)
          for n in ["endpoint", "session", "agent", "pair"]])
    timeline = timeline.unionByName(present, allowMissingColumns=True)

    sums = {f"w_{n}": ("sum", c(n)) for n in changes}
    marks = {"oldest": ("max", c("next_first")), "first_ever": ("min", c("t_us")), "last_ok": ("max", c("ok_rn"))}
    seen = running(timeline, ["key"], {**sums, **marks}, cfg.segment_us, ("at", "phase", "event_id", "sub"))
    return _shape(seen.filter(c("sub") == 1), cfg)


def _shape(seen: DataFrame, cfg: Config) -> DataFrame:
    """Feature values and scores from the window counts of each request."""
    c = F.col
    n = c("w_n_short")
    span = (c("t_us") - F.coalesce("oldest", "first_ever")) / 1e6
    few = n < 2
    recent = 3.0 / ((c("t_us") - c("t3")) / 1e6 + 0.001)
    overall = n / (span + 0.001)
    accel = F.when(few, 0.0).when(n > 4, recent / (overall + 0.001)).otherwise(1.0)
    volume = n / F.lit(11.0)
    freq = F.when(~few & (volume > 2), F.least(F.lit(100.0), volume * 20.0)).otherwise(0.0)
    streak = F.least(c("rn") - F.coalesce("last_ok", F.lit(0)), n)
    fail_rate = c("w_fail") / n

    def points(*rules):
        return F.least(sum(F.when(cond, float(p)).otherwise(0.0) for p, cond in rules), F.lit(100.0))

    old = [c(f"w_old_{x}") for x in FLAG_COLS]
    per_flag = [c(x) + o for x, o in zip(FLAG_COLS, old)]
    total_flags = sum(per_flag)
    rate = (n / F.lit(cfg.short_s / 60)) / (c("w_n_long") / F.lit(cfg.long_s / 60) + 0.001)
    has_base = c("w_n_long") >= 10
    scan = (c("w_endpoint") > 10) & (n > 15)
    enum = c("w_pair") >= 3
    return seen.select(
        "event_id", "key", "t_us", "rn", "t1",
        n.alias("requests_in_window"),
        F.when(few, 0.0).otherwise(round_half_up(span / (n - 1), 3)).alias("avg_interval"),
        (~few & (c("w_n_burst") > cfg.burst_rows)).alias("burst_detected"),
        round_half_up(accel, 2).alias("acceleration"),
        round_half_up(freq, 1).alias("freq_score"),
        c("w_fail").alias("failure_count"), round_half_up(fail_rate, 3).alias("failure_rate"),
        streak.alias("consecutive_failures"), c("w_login_fail").alias("login_failures"),
        points((30, c("w_fail") > 5), (25, streak > 3), (30, c("w_login_fail") > 3),
               (15, fail_rate > 0.7)).alias("failure_score"),
        c("w_endpoint").alias("unique_endpoints"), c("w_sensitive").alias("sensitive_hits"),
        scan.alias("scan_pattern"), enum.alias("enumeration_detected"), c("w_unusual").alias("unusual_methods"),
        points((25, c("w_sensitive") > 3), (35, scan), (20, enum), (15, c("w_unusual") > 5),
               (5, c("w_endpoint") > 8)).alias("pattern_score"),
        c("n_flags").cast("long").alias("current_flags"), total_flags.cast("long").alias("total_flags_recent"),
        *[x.cast("long").alias(f"flags_{f.lower()}") for x, f in zip(per_flag, FLAGS)],
        points(*[(C.FLAG_SCORES[f], x > 0) for x, f in zip(per_flag, FLAGS)],
               (15, total_flags > 5)).alias("payload_score"),
        c("w_session").alias("unique_sessions"), c("w_agent").alias("unique_user_agents"), "bot_indicators",
        points((25, c("w_session") > 3), (30, c("w_agent") > 3), (15, c("no_agent")),
               (20, c("bot_indicators"))).alias("session_score"),
        c("w_n_long").alias("requests_long"), has_base.alias("has_baseline"),
        F.when(has_base, round_half_up(rate, 2)).otherwise(0.0).alias("rate_deviation"),
        F.when(has_base & (rate > 3), 40.0).otherwise(0.0).alias("baseline_score"))


def min_interval(requests: DataFrame, cfg: Config, key: str = "ip") -> DataFrame:
    """Smallest gap between consecutive requests inside each request's short window, in seconds (null for one request).

    A window of length w covers the end of one w-long cell and the start of the next. The smallest gap is therefore the
    smaller of a running minimum forward in the request's own cell and one backward in the cell before it.
    """
    c = F.col
    w = cfg.short_us
    rows = requests.select("event_id", "t_us", c(key).alias("key"))
    ranked = rank_blocks(numbered(rows, cfg), "rn", cfg.block_rows, 1)
    gaps = stage(ranked.withColumn("t1", F.lag("t_us").over(block_window(["key"], "rn"))).filter(~c("_ghost"))
                 .select("event_id", "key", "t_us", "t1"), "gaps")
    # a gap sits at its start t1; a request asks for gaps that start in (t - w, t)
    gap = gaps.filter(c("t1").isNotNull()).select("key", c("t1").alias("pos"), (c("t_us") - c("t1")).alias("gap"),
                                                  F.lit(None).cast("long").alias("event_id"))
    ask = gaps.select("key", c("t_us").alias("pos"), F.lit(None).cast("long").alias("gap"), "event_id")
    ask_back = ask.withColumn("pos", c("pos") - w)
    forward = gap.unionByName(ask).withColumns({
        "cell": F.expr(f"pos div {w}"), "rank": F.when(c("event_id").isNull(), 1).otherwise(0)})
    backward = gap.unionByName(ask_back).withColumns({
        "cell": F.expr(f"pos div {w}"), "rank": F.when(c("event_id").isNull(), 1).otherwise(0), "pos": -c("pos")})
    found = [running(x, ["key", "cell"], {"least": ("min", c("gap"))}, cfg.segment_us, ("pos", "rank", "event_id"))
             .filter(c("event_id").isNotNull()).select("event_id", "least") for x in (forward, backward)]
    return (found[0].unionByName(found[1]).groupBy("event_id")
            .agg(round_half_up(F.min("least") / 1e6, 3).alias("min_interval")))


def feature_rollup(requests: DataFrame, window_us: int, key: str = "ip") -> DataFrame:
    """Features per actor and tumbling window: partial aggregation before the shuffle, no per-request state."""
    fail = F.col("status_code").isin(C.FAILURE_CODES)
    flagged = F.size(text.payload_flags(F.col("payload")))
    return (requests.withColumn("window_us", F.expr(f"(t_us div {window_us}) * {window_us}")).groupBy(key, "window_us")
            .agg(F.count("*").alias("requests"),
                 F.count_if(fail).alias("failures"),
                 F.count_if(fail & text.contains_any(F.col("endpoint"), C.LOGIN_MARKERS)).alias("login_failures"),
                 F.count_if(F.col("endpoint").isin(C.SENSITIVE_ENDPOINTS)).alias("sensitive_hits"),
                 F.count_if(F.col("method").isin(C.UNUSUAL_METHODS)).alias("unusual_methods"),
                 F.sum(flagged.cast("long")).alias("payload_flags"),
                 F.count_distinct("endpoint").alias("unique_endpoints"),
                 F.count_distinct(F.when(F.col("session_id") != "", F.col("session_id"))).alias("unique_sessions"),
                 F.count_distinct(F.when(F.col("user_agent") != "", F.col("user_agent"))).alias("unique_user_agents"),
                 F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")))
