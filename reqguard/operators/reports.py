"""Roll-ups: dashboards, decoy profiles, forensic reports and behaviour profiles.

Member lists that can grow with the data (ips of a fingerprint, endpoints of an actor) are rows, not arrays.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import SECOND
from reqguard.operators.memory import newest, newest_per_key

HOUR_US = 3600 * SECOND
ACTIONS = ["allow", "block", "throttle", "quarantine", "shadow_monitor", "deception_flag"]


def recent_requests(log: DataFrame, ip: str, now_us: Column, window_us: int, key: str = "ip") -> DataFrame:
    """One ip's requests after ``now - window``, newest first."""
    return (log.filter((F.col(key) == ip) & (F.col("t_us") > now_us - window_us) & (F.col("t_us") <= now_us))
            .orderBy(F.desc("t_us"), F.desc("event_id")))


def events_by_type(events: DataFrame, event_type: str | None, n: int = 200) -> DataFrame:
    """Newest system events, optionally of one type."""
    chosen = events.filter(F.col("event_type") == event_type) if event_type else events
    return newest(chosen, n)


def top_k(df: DataFrame, what: Column, k: int = 5) -> DataFrame:
    """Most frequent values; ties by value."""
    return (df.groupBy(what.alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k))


def dashboard_stats(requests: DataFrame, blocks: DataFrame, rules: DataFrame, decoys: DataFrame, scores: DataFrame,
                    state: DataFrame, now_us: int) -> DataFrame:
    """One row of headline numbers at ``now_us``; each input is reduced to one row, and the rows are merged."""
    c = F.col
    hour_ago = now_us - HOUR_US
    last_hour = (c("t_us") > hour_ago) & (c("t_us") <= now_us)
    live = c("is_permanent") | F.coalesce(c("expires_us") > now_us, F.lit(False))
    parts = [
        requests.filter(last_hour).agg(F.count("*").alias("total_requests_1h"),
                                       F.count_distinct("ip").alias("unique_ips_1h")),
        blocks.agg(F.count_if(live).alias("blocked_ips")),
        rules.agg(F.count_if("is_active").alias("active_rules"),
                  F.count_if(c("is_active") & c("auto_generated")).alias("auto_rules")),
        decoys.filter(last_hour).agg(F.count("*").alias("decoy_hits_1h")),
        scores.agg(F.count_if(c("score") > 60).alias("high_risk_ips")),
        state.agg(F.max("level").alias("defense_level"), F.max("rate_limit").alias("rate_limit")),
    ]
    return merged(parts)


def merged(parts: list[DataFrame]) -> DataFrame:
    """One row out of one-row inputs with different columns."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(x).alias(x) for x in rows.columns])


def attacker_profiles(decoys: DataFrame) -> DataFrame:
    """Every ip in the decoy log: counts and times. What it touched, ``attacker_members`` has as rows."""
    return decoys.groupBy("ip_address").agg(
        F.count("*").alias("interactions"), F.count_distinct("endpoint").alias("endpoints"),
        F.count_distinct("method").alias("methods"), F.count_distinct("interaction_type").alias("types"),
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count_if(F.col("payload") != "").alias("payloads"))


def attacker_members(decoys: DataFrame) -> DataFrame:
    """(ip_address, kind, member): the endpoints, methods and interaction types of each ip in the decoy log."""
    items = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(col).alias("member")) for kind, col in (
        ("endpoint", "endpoint"), ("method", "method"), ("type", "interaction_type"))])
    return decoys.select("ip_address", F.explode(items).alias("m")).select("ip_address", "m.kind", "m.member").distinct()


def honeypot_summary(decoys: DataFrame, k: int = 5, recent: int = 10) -> DataFrame:
    """Rows (section, rank, item, n): totals, top endpoints, top ips and recent activity of the whole decoy log."""
    rows = decoys

    def ranked(df, section, *order):
        w = Window.orderBy(*order)  # at most k or ``recent`` rows
        return df.select(F.lit(section).alias("section"), F.row_number().over(w).cast("long").alias("rank"), "item", "n")

    total = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(1).cast("long").alias(
        "rank"), F.lit("interactions").alias("item"), "n")
    ips = rows.agg(F.count_distinct("ip_address").alias("n")).select(
        F.lit("total").alias("section"), F.lit(2).cast("long").alias("rank"), F.lit("attackers").alias("item"), "n")
    last = newest(rows, recent).select(F.concat_ws(" ", "method", "endpoint", "ip_address").alias("item"),
                                       F.col("event_id").alias("n"), "t_us")
    parts = [total, ips,
             ranked(top_k(rows, F.col("endpoint"), k), "endpoint", F.desc("n"), "item"),
             ranked(top_k(rows, F.col("ip_address"), k), "ip", F.desc("n"), "item"),
             ranked(last, "recent", F.desc("t_us"), F.desc("n"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def incidents(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Decisions worth a report (risk above 50 or any action), with the payload."""
    worth = decisions.filter((F.col("total_risk") > 50) | (F.col("action") != "allow"))
    return worth.join(requests.select("event_id", "payload"), "event_id")


def forensic_reports(incident_rows: DataFrame) -> DataFrame:
    """One report per fingerprint: times, counts, action counts, last ten anomaly values, classification."""
    c = F.col
    hit = c("deception") > 0
    head = incident_rows.groupBy("fingerprint").agg(
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("incidents"),
        F.count_distinct("ip").alias("n_ips"), F.count_distinct("endpoint").alias("n_endpoints"),
        F.count_distinct(F.when(kept_payload(), F.sha2("payload", 256))).alias("n_payloads"),
        F.count_if(hit).alias("deception_hits"),
        *[F.count_if(c("action") == a).alias(f"n_{a}") for a in ACTIONS])
    trend = (newest_per_key(incident_rows.select("fingerprint", "t_us", "event_id", "anomaly"), ["fingerprint"], 10)
             .groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("t_us", "event_id", "anomaly"))).alias("_t"))
             .select("fingerprint", F.col("_t.anomaly").alias("anomaly_trend")))
    counts = F.array(*[F.when(c(f"n_{a}") > 0, F.struct(F.lit(a).alias("key"), c(f"n_{a}").alias("value")))
                       for a in ACTIONS])
    label = (F.when((c("n_block") > 0) | (c("n_quarantine") > 0), "MALICIOUS")
             .when(c("deception_hits") > 2, "PROBING_ATTACKER").otherwise("SUSPICIOUS"))
    return (head.join(trend, "fingerprint")
            .withColumns({"report_id": F.sha2("fingerprint", 256), "classification": label,
                          "response_actions": F.map_from_entries(F.filter(counts, lambda x: x.isNotNull()))})
            .drop(*[f"n_{a}" for a in ACTIONS]))


def kept_payload() -> Column:
    return F.col("payload").isNotNull() & ~F.col("payload").isin("", "{}")


def forensic_members(incident_rows: DataFrame) -> DataFrame:
    """The ips, endpoints and payloads of each report, one row each."""
    def item(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("member"))

    items = F.array(item("ip", F.col("ip")), item("endpoint", F.col("endpoint")),
                    F.when(kept_payload(), item("payload", F.col("payload"))))
    rows = incident_rows.select("fingerprint", F.explode(items).alias("m")).filter(F.col("m").isNotNull())
    return rows.select("fingerprint", "m.kind", "m.member").distinct()


def live_dashboard(decisions: DataFrame, members: DataFrame, n_fingerprints: DataFrame, k: int = 5) -> DataFrame:
    """Rows (section, rank, item, value) of the live view: action counts, status, threat level, top lists."""
    c = F.col

    def row(df, section, item, value):
        return df.select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("rank"), item.alias("item"),
                         value.cast("double").alias("value"))

    def ranked(df, section):
        w = Window.orderBy(F.desc("n"), "item")  # at most k rows
        return df.select(F.lit(section).alias("section"), F.row_number().over(w).cast("long").alias("rank"), "item",
                         c("n").cast("double").alias("value"))

    counts = decisions.groupBy("action").agg(F.count("*").alias("n"))
    total = decisions.agg(F.count("*").alias("n"))
    mean = newest(decisions, 5).agg(F.avg("total_risk").alias("m"))
    level = F.when(c("m") > 60, "HIGH").when(c("m") > 30, "ELEVATED").otherwise("NORMAL")
    suspicious = top_k(decisions.filter(c("total_risk") > 50), c("endpoint"), k)
    payloads = top_k(members.filter(c("kind") == "payload"), c("member"), k)
    parts = [
        row(counts, "action", c("action"), c("n")), row(total, "total", F.lit("requests"), c("n")),
        row(total, "status", F.when(c("n") > 0, "ONLINE").otherwise("IDLE"), c("n")),
        row(mean, "threat", level, c("m")), row(n_fingerprints, "fingerprints", F.lit("known"), c("n")),
        ranked(suspicious, "endpoint"), ranked(payloads, "payload")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def blocked_sets(decisions: DataFrame) -> DataFrame:
    """Ips blocked and fingerprints quarantined by any decision so far."""
    c = F.col
    item = F.when(c("action") == "block", F.struct(F.lit("blocked_ip").alias("kind"), c("ip").alias("member"))).when(
        c("action") == "quarantine", F.struct(F.lit("quarantined").alias("kind"), c("fingerprint").alias("member")))
    return decisions.select(item.alias("m")).filter(c("m").isNotNull()).select("m.*").distinct()


def in_window(log: DataFrame, now_us: int, window_us: int) -> DataFrame:
    return log.filter((F.col("t_us") > now_us - window_us) & (F.col("t_us") <= now_us))


def behavior_endpoints(requests: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """(ip, endpoint): what each actor called within the window."""
    return in_window(requests, now_us, window_us).select("ip", "endpoint").distinct()


def behavior_profile(requests: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """Per actor over the window: totals and requests per hour of day; ``behavior_endpoints`` lists what it called."""
    c = F.col
    rows = in_window(requests, now_us, window_us)
    head = rows.groupBy("ip").agg(
        F.count("*").alias("total_requests"), F.count_if(c("status_code").isin(C.FAILURE_CODES)).alias("failed_logins"),
        F.count_distinct("endpoint").alias("unique_endpoints"),
        F.count_distinct(F.when(c("session_id") != "", c("session_id"))).alias("session_count"),
        ((F.max("t_us") - F.min("t_us")) / 1e6).alias("_span"), F.max("t_us").alias("last_us"))
    head = head.withColumn("avg_request_interval", F.when(
        c("total_requests") > 1, c("_span") / (c("total_requests") - 1)).otherwise(0.0)).drop("_span")
    hours = (rows.groupBy("ip", F.expr("(t_us div 3600000000) % 24").alias("hour"))
             .agg(F.count("*").alias("n")).groupBy("ip")
             .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
                 F.lpad(c("hour").cast("string"), 2, "0"), "n")))).alias("hourly_distribution")))
    return head.join(hours, "ip")


def profile_summary(requests: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """Per actor over the window: requests, distinct endpoints and agents, failure rate over 401 and 403."""
    c = F.col
    failed = F.count_if(c("status_code").isin(C.PROFILE_FAILURE_CODES))
    return in_window(requests, now_us, window_us).groupBy("ip").agg(
        F.count("*").alias("requests"), F.count_distinct("endpoint").alias("unique_endpoints"),
        (failed / F.count("*")).alias("failure_rate"), F.count_distinct("user_agent").alias("n_user_agents"))


def profile_agents(requests: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """The user agents behind ``profile_summary``, one row each."""
    return in_window(requests, now_us, window_us).select("ip", "user_agent").distinct()


def healing_status(rules: DataFrame, log: DataFrame, n: int = 10) -> DataFrame:
    """Rows (section, item, n): number of active automatic rules by type and the newest n log entries."""
    auto = rules.filter(F.col("is_active") & F.col("auto_generated"))
    total = auto.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("auto_rules").alias("item"), "n")
    listed = auto.select(F.lit("rule").alias("section"), F.col("rule_name").alias("item"), F.lit(1).cast("long").alias("n"))
    recent = newest(log, n, ("applied_us", "event_id", "rule_generated")).select(
        F.lit("recent").alias("section"), F.col("rule_generated").alias("item"), F.col("event_id").alias("n"))
    return total.unionByName(listed).unionByName(recent)


def component_stats(outcomes: DataFrame, memory: DataFrame, vectors: DataFrame, now_us: int, window_us: int) -> DataFrame:
    """Rows (component, n): labelled samples, memory entries and actors active in the window."""
    c = F.col
    parts = [outcomes.agg(F.count_if("is_attack").alias("attack_samples"),
                          F.count_if(~c("is_attack") & c("trusted")).alias("normal_samples")),
             memory.agg(F.count("*").alias("memory_entries")),
             in_window(vectors, now_us, window_us).agg(F.count_distinct("ip").alias("active_actors"))]
    rows = [p.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in p.columns]),
                                                 F.array(*[c(x) for x in p.columns]))).alias("component", "n"))
            for p in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)
