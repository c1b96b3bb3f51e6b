"""The registered queries: each operator over the given tables, shaped to flat columns.

Arrays are joined to text and doubles rounded to six digits, so that results compare across engines.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import DAY, SAMPLE, SECOND
from reqguard.functions import scoring, text
from reqguard.functions.rounding import round_half_up
from reqguard.operators import decisions as D
from reqguard.operators import feedback as FB
from reqguard.operators import features as FT
from reqguard.operators import forest as IF
from reqguard.operators import memory as M
from reqguard.operators import mining as MI
from reqguard.operators import reports as RP
from reqguard.operators import respond as RS
from reqguard.operators import risk as RK
from reqguard.operators import rules as RU
from reqguard.operators import vectors as V
from reqguard.session import shared_dir, stage
from reqguard.sources import logs, requests as RQ, tables

CFG = SAMPLE
SPREAD = True  # the sample tables are one file each
c = F.col


def r6(x) -> Column:
    return round_half_up(c(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, arrays to text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "double":
            out.append(r6(f.name).alias(f.name))
        elif kind == "array<string>":
            out.append(F.array_join(f.name, ",").alias(f.name))
        elif kind == "int":
            out.append(c(f.name).cast("long").alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


def latest_us(df: DataFrame) -> int:
    return df.agg(F.max("t_us")).first()[0]


def named(fn):
    """Register a function of the request view."""
    return lambda spark, sf: rounded(fn(RQ.requests(spark, sf, SPREAD)))


# ---------------------------------------------------------------- shared inputs derived from the tables
def observed_rules(r: DataFrame) -> DataFrame:
    """Default rules and, for each payload flag and day seen, the rule generated for it."""
    made = RU.payload_rules(r.withColumns({"score": F.lit(100.0), "key": c("ip")}), DAY * SECOND)
    first = RU.default_rules(r.sparkSession, 0)
    auto = made.select("rule_name", "rule_type", "pattern", "action", "severity", "confidence", "created_us",
                       "expires_us", "auto_generated", F.lit(True).alias("is_active"))
    return first.unionByName(auto, allowMissingColumns=True).withColumn(
        "id", F.xxhash64("rule_name"))


def feature_table(r: DataFrame) -> DataFrame:
    return FT.features(r, CFG)


def risk_table(r: DataFrame, features: DataFrame | None = None) -> DataFrame:
    return stage(RK.decayed_risk(RK.raw_risk(feature_table(r) if features is None else features), CFG), "risk")


def decision_table(r: DataFrame) -> DataFrame:
    return stage(D.decisions(r, CFG), "decisions")


def decoys(r: DataFrame) -> DataFrame:
    return logs.honeypot_log(r.withColumn("headers", F.create_map(F.lit("User-Agent"), "user_agent")))


def system_events(r: DataFrame) -> DataFrame:
    return logs.payload_alerts(r).unionByName(logs.honeypot_events(logs.honeypot_log(r)))


def pattern_hits(r: DataFrame, rules: DataFrame) -> DataFrame:
    """Patterns matched by the requests' payloads, true positive when the request did not succeed."""
    hits = RU.pattern_hits(r.filter("payload <> ''"), rules, "event_id", "t_us", "status_code")
    return hits.withColumn("is_true_positive", c("status_code") != 200)


def outcomes(r: DataFrame) -> DataFrame:
    """Confirmed outcomes: a decoy hit is an attack, anything else is a trusted normal."""
    hit = text.deceptive_route(c("endpoint"))
    return r.select("event_id", "t_us", "ip", "payload", hit.alias("is_attack"), (~hit).alias("trusted"))


def embedded(r: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Behaviour vector of every request."""
    rows = (feature_table(r) if features is None else features).join(r.select("event_id", "ip", "payload", "endpoint"), "event_id")
    return V.behavior_embedding(rows).select("event_id", "ip", "t_us", "vec", "endpoint")


def sample_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        c("vec_id").alias("event_id"), V.unit(c("embedding").cast("array<double>")).alias("vec"), "label")


def attack_memory(vectors: DataFrame) -> DataFrame:
    """Memory of the vectors labelled 0 to 4; the others play the part of new requests."""
    known = vectors.filter("label < 5").select(c("event_id").alias("entry_id"), "vec", c("event_id").alias("stored_us"))
    return V.memorize(known.limit(0), known)


# ---------------------------------------------------------------- sources and logs
def src_requests(spark, sf):
    """Write the requests as JSON lines without default values, and ingest them again."""
    r = RQ.requests(spark, sf, SPREAD)
    lean = r.select("ip", F.nullif("endpoint", F.lit("/")).alias("path"), F.nullif("method", F.lit("GET")).alias("method"),
                    F.nullif("user_agent", F.lit("")).alias("user_agent"), F.nullif("payload", F.lit("")).alias("payload"),
                    F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    path = f"{shared_dir(spark)}/ingest-{spark.sparkContext.applicationId}-{id(lean)}"
    lean.write.mode("overwrite").json(path)
    good, _ = RQ.ingest(spark.read, path)
    return rounded(good.groupBy("ip", "path", "method", "user_agent", "payload", "payload_size", "is_failed_login")
                   .agg(F.count("*").alias("n"), F.min(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("first_ts")))


def ingest_features(spark, sf):
    """Write the requests as JSON lines, ingest them, and compute the behaviour features of what was ingested."""
    r = RQ.requests(spark, sf, SPREAD)
    lines = r.select("ip", c("endpoint").alias("path"), "method", "user_agent", "payload", "status_code", "session_id",
                     F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))
    path = f"{shared_dir(spark)}/ingest-features-{id(lines)}"
    lines.write.mode("overwrite").json(path)
    return rounded(feature_table(RQ.ingest_requests(spark.read, path)).select(
        "key", "t_us", "requests_in_window", "failure_count", "unique_endpoints", "unique_sessions", "total_flags_recent", "failure_score"))


def log_scan(spark, sf):
    """Decision log lines in both formats, with crash lines between them, scanned and counted by decision."""
    r = RQ.requests(spark, sf, SPREAD)
    when = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss,SSS")
    verdict = F.when(c("status_code") == 200, "ALLOW").otherwise("BLOCK")
    line = (F.when(c("k") % 3 == 0, F.concat_ws(" | ", when, F.concat(F.lit("SOURCE: "), "ip"),
                                                F.concat(F.lit("ENDPOINT: "), "endpoint"), F.lit("RISK: LOW"),
                                                F.concat(F.lit("DECISION: "), verdict)))
            .when(c("k") % 3 == 1, F.concat_ws(" | ", when, F.concat(F.lit("IP: "), "ip"),
                                               F.concat(F.lit("PATH: "), "endpoint"), F.lit("SCORE: 2.8"),
                                               F.concat(F.lit("DECISION: "), verdict), F.lit("FORWARD: http://host/")))
            .otherwise(F.concat_ws(" | ", when, F.lit("PROXY_CRASH"), F.lit("'allow'"))))
    known, other = logs.scan_log(r.select(line.alias("value")))
    counts = known.groupBy("decision", "path").agg(F.count("*").alias("n"), F.count("score").alias("scored"))
    return counts.unionByName(other.agg(F.count("*").alias("n")).select(
        F.lit("OTHER").alias("decision"), F.lit("").alias("path"), "n", F.lit(0).cast("long").alias("scored")))


def upsert_profiles(r):
    """State of the first half of the time range, updated with the second half."""
    mid = r.agg(((F.min("t_us") + F.max("t_us")) / 2).cast("long")).first()[0]
    rows = r.select("ip", "t_us", "event_id", "endpoint", "status_code", c("t_us").alias("created_us"))
    first = tables.upsert(rows.filter(c("t_us") <= mid).limit(0), rows.filter(c("t_us") <= mid), ["ip"])
    return tables.upsert(first, rows.filter(c("t_us") > mid), ["ip"])


def rule_columns(df):
    return df.select("rule_name", "rule_type", "pattern", "action", "severity", "is_active", "auto_generated")


def seed_rules(r):
    """Automatic rules plus one default rule that already exists; seeding adds the other defaults once."""
    table = observed_rules(r).filter(c("auto_generated") | (c("rule_name") == "Path Traversal"))
    return rule_columns(RU.seed_rules(table))


def expired(r):
    now = latest_us(r)
    live, gone = RU.expire_rules(observed_rules(r), F.lit(now))
    return live.select("rule_name", F.lit("live").alias("state")).unionByName(
        gone.select("rule_name", F.lit("expired").alias("state")))


def recent_requests(r):
    busiest = RP.top_k(r, c("ip"), 1).first()["item"]
    return RP.recent_requests(r, busiest, F.lit(latest_us(r)), CFG.short_us).select(
        "event_id", "ip", "t_us", "endpoint", "method", "status_code")


def active_blocks(r):
    now = latest_us(r)
    return RS.active_blocks(tables.block_list(RS.block_ops(r, 5 * DAY)), F.lit(now)).select("ip", "t_us", "expires_us")


def is_blocked(r):
    return RS.is_blocked(r.select("ip").distinct(), tables.block_list(RS.block_ops(r, 5 * DAY)),
                         F.lit(latest_us(r))).select("ip", "is_blocked")


def asof_blocks(r):
    return RS.state_in_force(r, RS.block_ops(r), CFG)


def rule_match(r):
    """Every request with a payload against the rules in force at its time."""
    return RU.rules_at_requests(r.filter("payload <> ''"), stage(observed_rules(r), "rules"), CFG)


def rule_sets(r):
    """The rules of each set that `rule_match` names."""
    return RU.rule_sets(stage(observed_rules(r), "rules")).select("rule_set", "since_us", "rule_name", "action", "severity")


# ---------------------------------------------------------------- features
FREQUENCY = ["event_id", "requests_in_window", "avg_interval", "burst_detected", "acceleration", "freq_score"]


def feat_frequency(r):
    return feature_table(r).select(*FREQUENCY).join(FT.min_interval(r, CFG), "event_id").withColumn(
        "min_interval", F.coalesce("min_interval", F.lit(0.0)))


def feature_columns(*names):
    return lambda r: feature_table(r).select("event_id", *names)


def behavior_profile(r):
    out = RP.behavior_profile(r, latest_us(r), CFG.short_us)
    hours = F.array_join(F.transform(F.map_entries("hourly_distribution"), lambda e: F.concat_ws(
        ":", e["key"], e["value"].cast("string"))), ",")
    return out.withColumn("hourly_distribution", hours)


def json_props(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    parsed = F.from_json("props", "k long, extra string")
    return events.select("event_id", parsed["k"].alias("k"), parsed["extra"].alias("extra"),
                         F.to_json(F.struct(parsed["k"].alias("k"))).alias("again"),
                         F.from_json(F.concat(F.lit("{"), "event_type"), "k long")["k"].isNull().alias("bad_is_null"))


# ---------------------------------------------------------------- memory and decisions
def known(r, key="fingerprint"):
    return M.telemetry(M.deception_intent(M.behavior_deviation(M.behavior_memory(r, CFG, key))))


def behavior_memory(r):
    return known(r).select("event_id", "identity", "total_requests", "sensitive_hits", "failed_logins", "unique_agents",
                           "n_recent", "endpoint_diversity", "burst_density", "n_gaps", "gap_sum_us", "first_us")


def behavior_memory_ip(r):
    return known(r, "ip").select("event_id", "total_requests", "sensitive_hits", "failed_logins", "unique_agents",
                                 "endpoint_diversity", "burst_density", "n_gaps", "deviation", "deception")


def adaptive_decision(key):
    return lambda r: D.first_pass(r, CFG, key).select("event_id", "total_risk", "action")


def repeat_offender(r):
    return D.decisions(r, CFG).select("event_id", "repeat")


def evolution_multipliers(r):
    return D.decisions(r, CFG).select("event_id", "path_mult", "fingerprint_mult", "signature_mult")


def feedback_decision(r):
    return D.decisions(r, CFG).select("event_id", "adj_deviation", "adj_anomaly", "adj_signature", "adj_deception",
                                      "total_risk", "action", "reason")


def entry_summary(r):
    """What would be done with this traffic: requests and mean risk per action."""
    return D.first_pass(r, CFG).groupBy("action").agg(F.count("*").alias("requests"), F.avg("total_risk").alias("mean_risk"))


def response_actions(r):
    return RS.response_actions(decision_table(r)).filter(F.size("responses") > 0).select(
        "event_id", "responses", "until_us", "throttle_until_us")


def healing_state(r):
    now = latest_us(r)
    return RS.healing_state(RS.response_actions(decision_table(r)), F.lit(now)).select("what", "item", "until_us", "n")


def incidents(r):
    return stage(RP.incidents(decision_table(r), r), "incidents")


def forensic_reports(r):
    out = RP.forensic_reports(incidents(r))
    acts = F.array_join(F.transform(F.map_entries("response_actions"), lambda e: F.concat_ws(
        ":", e["key"], e["value"].cast("string"))), ",")
    return out.withColumns({"response_actions": acts, "trend_n": F.size("anomaly_trend").cast("long"),
                            "trend_last": F.element_at("anomaly_trend", -1),
                            "trend_sum": F.aggregate("anomaly_trend", F.lit(0.0), lambda a, x: a + x)}).drop(
        "anomaly_trend")


def live_dashboard(r):
    table = decision_table(r)
    members = RP.forensic_members(RP.incidents(table, r))
    return RP.live_dashboard(table, members, table.agg(F.count_distinct("fingerprint").alias("n")))


def recent_history(r):
    """The four rolling histories: the newest 100 decisions, 50 decoy triggers, 50 risks and 100 healing actions."""
    taken = decision_table(r)

    def rows(df, kind, item, value):
        return df.select(F.lit(kind).alias("kind"), "event_id", "t_us", item.alias("item"), value.alias("value"))

    done = RS.response_actions(taken).select("event_id", "t_us", F.posexplode("responses").alias("place", "response"))
    parts = [rows(M.newest(taken, 100), "event", F.upper("action"), c("total_risk")),
             rows(M.newest(taken.filter("action = 'deception_flag'"), 50), "decoy", c("endpoint"), c("total_risk")),
             rows(M.newest(taken, 50), "risk", F.lit(""), c("total_risk")),
             rows(M.newest(done, 100, ("t_us", "event_id", "place")), "healing", c("response"), F.lit(0.0))]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- risk
def decayed_risk(r):
    return risk_table(r).select("event_id", "raw", "score", "risk_level")


SLOW = 1e-6  # decay per second at which the sparse sample keeps some risk for days


def risk_level(r):
    scores = RK.current_scores(risk_table(r))
    later = F.lit(latest_us(r) + 100 * SECOND)
    return RK.sweep(scores, later, SLOW).select("key", "score", "risk_level", "current_score", "current_level")


def decay_all(r):
    return RK.decay_all(RK.current_scores(risk_table(r)), 0.9, 3).select("key", "score")


def risk_lookup(r):
    scores = RK.current_scores(risk_table(r)).select("key", "score", "risk_level")
    keys = r.select(F.concat("ip", F.when(c("user_id") % 2 == 0, "").otherwise("-unseen")).alias("key")).distinct()
    return RK.risk_lookup(keys, scores)


def risk_ranking(r):
    return RK.current_scores(risk_table(r)).select("key", "score", "risk_level").orderBy(F.desc("score"), "key")


def auto_behavior_rules(r):
    return RU.behavior_rules(risk_table(r)).drop("confidence", "auto_generated")


def auto_payload_rules(r):
    scores = risk_table(r).select("event_id", "key", "score")
    rows = r.select("event_id", "t_us", "payload").join(scores, "event_id")
    return RU.payload_rules(rows).select("kind", "event_id", "t_us", "rule_name", "pattern", "severity", "expires_us")


def system_event_log(spark, sf):
    """All event kinds: payload alerts, decoy hits, risk escalations, rule generation and injected rules."""
    r = RQ.requests(spark, sf, SPREAD)
    risk = risk_table(r).withColumn("ip", c("key")).withColumn("freq_score", c("boosted_freq"))
    made = RU.behavior_rules(risk).withColumn("ip", c("key"))
    injected = logs.injected_rule_events(RU.evolved_rules(MI.mine_rules(url_payloads(spark, sf)), F.lit(latest_us(r))))
    log = system_events(r).unionByName(logs.risk_escalations(risk)).unionByName(logs.healing_events(made)).unionByName(injected)
    scores = {x: F.get_json_object("metadata", f"$.score_breakdown.{x}").cast("double").alias(x) for x in ("frequency", "failure", "pattern", "payload")}
    meta = F.when(c("event_type") != "RISK_ESCALATION", c("metadata")).alias("metadata")
    return rounded(log.select(F.coalesce("event_id", F.lit(-1).cast("long")).alias("event_id"), "event_type", "severity",
                              F.coalesce("source_ip", F.lit("")).alias("source_ip"), "description", meta, *scores.values(), "t_us"))


def dashboard_stats(r):
    now = latest_us(r)
    rules = observed_rules(r)
    changes = level_changes(r)
    return RP.dashboard_stats(r, tables.block_list(RS.block_ops(r, 5 * DAY)), rules, decoys(r),
                              RK.current_scores(risk_table(r)), RS.defense_state(changes), now)


def level_changes(r):
    """Defense-level log: every error sets a level."""
    return r.filter("event_type = 'error'").select(
        F.lit(1).alias("id"), (c("k") % 5).alias("level"), (F.lit(60) - (c("k") % 5) * 10).alias("rate_limit"),
        c("endpoint").alias("reason"), "t_us", "event_id")


# ---------------------------------------------------------------- rules over time
def rule_effectiveness(r):
    rules = stage(observed_rules(r), "rules")
    return RU.effectiveness_in_force(rules, pattern_hits(r, rules), CFG).select(
        "rule_name", "true_positives", "false_positives", "effectiveness", "last_us")


def rule_performance(r):
    rules = stage(observed_rules(r), "rules")
    return RU.rule_performance(rules, RU.effectiveness_in_force(rules, pattern_hits(r, rules), CFG)).select(
        "rule_name", "true_positives", "false_positives", "effectiveness")


def signature_confidence(r):
    changes = r.filter("payload <> ''").select(
        F.md5("payload").alias("signature"), "t_us", "event_id",
        F.when(c("status_code") == 200, -0.07).otherwise(0.05).alias("delta"))
    return RU.signature_confidence(changes, CFG)


def healing_status(r):
    made = observed_rules(r)
    rows = RU.payload_rules(r.withColumns({"score": F.lit(100.0), "key": c("ip")}), DAY * SECOND)
    return RP.healing_status(made, RU.healing_log(rows))


def apply_corrections(r):
    """Feedback on every request with a payload: it was an attack when the request failed."""
    rules, asked = stage(observed_rules(r), "rules"), r.filter("payload <> ''")
    matched = RU.rules_at_requests(asked, rules, CFG).withColumn("action", F.when(c("blocked"), "block").otherwise("allow"))
    feedback = r.select("event_id", (c("status_code") != 200).alias("was_attack"))
    fixed = FB.corrected_outcomes(matched, feedback)
    hits = RU.pattern_hits(asked, rules, "event_id", "t_us")
    sure = FB.apply_corrections(fixed, hits, rules, CFG).select("rule_name", "confidence")
    errors = fixed.groupBy("error").agg(F.count("*").cast("double").alias("confidence"))
    return sure.unionByName(errors.select(F.concat(F.lit("errors:"), "error").alias("rule_name"), "confidence"))


def corrections_full(r):
    """Feedback that flips every outcome with k divisible by 11, as signed changes to the state before it."""
    rules, before = stage(observed_rules(r), "rules"), stage(outcomes(r), "outcomes")
    feedback = r.filter(c("k") % 11 == 0).join(before.select("event_id", "is_attack"), "event_id").select("event_id", (~c("is_attack")).alias("was_attack"))
    hits = stage(RU.pattern_hits(r.filter("payload <> ''"), rules, "event_id", "t_us"), "hits")
    judged = hits.join(before.select("event_id", c("is_attack").alias("is_true_positive")), "event_id").withColumn("step", F.lit(1))
    labels, counts = FB.label_counts(before), RU.counts_in_force(rules, judged, CFG)
    state, memory = FB.prior_state(before), before.filter("is_attack").select(c("event_id").alias("entry_id"))
    changes = stage(FB.retractions(before, feedback), "retractions")

    def rows(df, kind, item, value):
        return df.select(F.lit(kind).alias("kind"), item.alias("item"), value.cast("double").alias("value"))

    prior = FB.corrected_prior(state, changes)
    parts = [rows(FB.corrected_labels(labels, changes), "label", F.when(c("is_attack"), "attack").otherwise("normal"), c("n")),
             rows(FB.corrected_effectiveness(counts, hits, changes, rules, CFG), "rule", c("rule_name"), c("effectiveness")),
             rows(FB.corrected_memory(memory, changes), "memory", c("entry_id").cast("string"), F.lit(1)),
             *[rows(prior, "prior", F.lit(x), c(x)) for x in ("n", "attacks", "prior")]]
    return reduce(lambda a, b: a.unionByName(b), parts)


def evolution_loop(r):
    """Gate, mining, injection and its logs: the payloads of confirmed attacks in periods that pass the gate are mined, the
    rules that are sure enough join the rules table, and each is logged as an event and a healing action."""
    period = DAY // 4 * SECOND
    attacks = outcomes(r).filter("is_attack")
    periods = stage(FB.evolution_gate(attacks, period), "evolution-periods")
    pool = attacks.filter(F.length("payload") > C.EVOLUTION_POOL_CHARS).withColumn("period_us", F.expr(f"t_us div {period} * {period}")).join(
        periods.select("period_us"), "period_us", "left_semi")
    made = stage(RU.evolved_rules(MI.mine_rules(pool.select("payload")), F.lit(latest_us(r))).withColumn("is_active", F.lit(True)), "evolved")
    table = tables.insert_absent(observed_rules(r).select(*[x for x in made.columns if x != "description"]), made.drop("description"), ["rule_name"])
    log = made.select(F.lit(-1).cast("long").alias("event_id"), F.lit("GENERALIZED_EVOLUTION").alias("kind"), "rule_type", "pattern", F.lit("").alias("key"),
                      "rule_name", c("created_us").alias("t_us"))

    def rows(df, section, item, detail):
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))

    parts = [rows(periods, "period", c("period_us"), c("n_distinct")),
             rows(logs.injected_rule_events(made), "event", c("description"), c("severity")),
             rows(RU.healing_log(log), "healing", c("rule_generated"), c("pattern_detected")),
             rows(RU.active_rules(table).filter("auto_generated"), "active", c("rule_name"), c("action"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def evolution_gate(r):
    """Confirmed payloads pooled per six hours, as the sample has few requests per ten minutes."""
    return FB.evolution_gate(outcomes(r).filter("is_attack"), DAY // 4 * SECOND).drop("diverse")


def pool_diversity(r):
    return MI.pool_diversity(r.filter("length(payload) > 10"), ["ip"])


def component_stats(r):
    rows = outcomes(r)
    return RP.component_stats(rows, rows.filter("is_attack"), rows, latest_us(r), CFG.short_us)


def threshold_tuning(r):
    rows = outcomes(r)
    missed = rows.filter(c("is_attack") & (c("payload") == ""))
    return FB.threshold_tuning(rows, missed)


# ---------------------------------------------------------------- text
def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key, for a table of few splits."""
    return df.repartition(key) if SPREAD else df


def documents(spark, sf):
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    return docs.select(c("doc_id").alias("event_id"), c("text").alias("payload"))


def signature_match(spark, sf):
    """Signatures over requests, documents and pages."""
    blank = F.lit("")
    r = RQ.requests(spark, sf, SPREAD).select(F.lit("request").alias("src"), "event_id", "payload", "user_agent", "endpoint")
    pages = spread(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").select(
        F.lit("page").alias("src"), c("page_id").alias("event_id"), c("html").alias("payload"),
        blank.alias("user_agent"), c("url").alias("endpoint"))
    docs = documents(spark, sf).select(F.lit("document").alias("src"), "event_id", "payload", blank.alias("user_agent"),
                                       blank.alias("endpoint"))
    out = text.signature_match(r.unionByName(pages).unionByName(docs))
    return rounded(out.select("src", "event_id", "matched", "signature_score"))


def payload_flags(spark, sf):
    r = RQ.requests(spark, sf, SPREAD).filter("payload <> ''").select(F.lit("request").alias("src"), "event_id", "payload")
    chats = spread(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id").select(
        F.lit("chat").alias("src"), (c("conv_id") * 1000 + c("turn")).alias("event_id"), c("text").alias("payload"))
    docs = documents(spark, sf).select(F.lit("document").alias("src"), "event_id", "payload")
    rows = r.unionByName(chats).unionByName(docs)
    return rounded(rows.select("src", "event_id", text.payload_flags(c("payload")).alias("flags")))


def attacker_members(r):
    return RP.attacker_members(decoys(r))


def behavior_endpoints(r):
    return RP.behavior_endpoints(r, latest_us(r), CFG.short_us)


def struct_fingerprint(spark, sf):
    return documents(spark, sf).select("event_id", text.structural_fingerprint(c("payload")).alias("shape"))


def trigram_tf(spark, sf):
    """Over the shapes of documents and page urls."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.concat(F.lit("page "), c("page_id").cast("string")).alias("id"), text.structural_fingerprint(c("url")).alias("shape"))
    docs = documents(spark, sf).select(
        F.concat(F.lit("document "), c("event_id").cast("string")).alias("id"), text.structural_fingerprint(c("payload")).alias("shape"))
    return rounded(text.trigram_counts(pages.unionByName(docs), "id", "shape"))


def lr_calibration(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    p = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) / 100.0
    return rounded(events.select("event_id", scoring.lr_calibration(p, F.lit(8.0), F.lit(0.5)).alias("ratio")))


# ---------------------------------------------------------------- vectors
def anomaly_features(r):
    return exploded(V.anomaly_features(feature_table(r)).select("event_id", c("x").alias("vec")))


def exploded(df):
    """The values other than 0. The outer form, as the plain one would have each vector made twice: for a test that it is
    not empty, too."""
    return df.select("event_id", F.posexplode_outer("vec").alias("dim", "value")).filter(c("value") != 0).withColumn(
        "dim", c("dim").cast("long"))


def behavior_embedding(r):
    return exploded(embedded(r).select("event_id", "vec"))


def kb_top1(spark, sf):
    vectors = stage(sample_vectors(spark, sf), "vectors")
    found = V.top1(vectors.filter("label >= 5"), attack_memory(vectors))
    return rounded(found)


def kb_remove(spark, sf):
    """The vectors labelled 0 turn out to be normal, so their memory entries are removed."""
    vectors = stage(sample_vectors(spark, sf), "vectors")
    left = V.remove(attack_memory(vectors), vectors.filter("label = 0").select("event_id", "vec"))
    return left.select("entry_id")


def actors(spark, sf):
    return stage(sample_vectors(spark, sf).select(c("event_id").cast("string").alias("ip"), c("event_id").alias("t_us"),
                                                  "event_id", "vec"), "actors")


def actor_correlation(spark, sf):
    """Sample vectors as actors; the threshold is low because the sample has no close pairs."""
    return rounded(V.correlate(V.latest_vectors(actors(spark, sf)), 0.4))


def campaigns(spark, sf):
    return V.campaigns(V.latest_vectors(actors(spark, sf)), 0.4)


def request_vectors(r, features=None):
    return stage(embedded(r, features), "embedded")


def actor_campaigns(r):
    """Actors by their latest behaviour vector in the long window."""
    vecs = V.latest_vectors(request_vectors(r), latest_us(r), CFG.long_us)
    members = V.campaigns(vecs, 0.97)
    return members.groupBy("campaign").agg(F.count("*").alias("n_members"))


def campaign_rows(r):
    """A row per campaign of `actor_campaigns`, with what all its members requested."""
    now = latest_us(r)
    vecs = stage(V.latest_vectors(request_vectors(r), now, CFG.long_us), "latest")
    members = stage(V.campaigns(vecs, 0.97), "members")
    found = V.campaign_rows(members, V.correlate(vecs, 0.97), F.lit(now), r.filter(c("t_us") >= now - CFG.long_us))
    return found.withColumn("similarity_score", F.least("similarity_score", F.lit(1.0)))


def bayes_fusion(r):
    """Evidence per request, as it stood then: cold anomaly, memory of earlier decoy hits, correlation with the other
    actors' latest vectors in the window before, decayed risk, dynamic prior. Vectors and risk read the same features."""
    r = stage(r, "requests")
    features = stage(feature_table(r), "features")
    vecs = request_vectors(r, features)
    hits = vecs.filter(text.deceptive_route(c("endpoint"))).select(
        c("event_id").alias("entry_id"), "vec", c("t_us").alias("stored_us"))
    near = V.top1_before(vecs, V.memorize(hits.limit(0), hits), CFG).select("event_id", c("similarity").alias("memory_sim"))
    twins = V.correlate_before(vecs, CFG.long_us, CFG).select("event_id", c("max_similarity").alias("correlation"))
    risk = risk_table(r, features)
    cold = V.cold_anomaly(V.anomaly_features(risk)).select(
        "event_id", "key", c("anomaly").alias("ml"), c("score").alias("risk"))
    prior = FB.dynamic_prior(outcomes(r), CFG).select("event_id", "prior")
    browsers = r.select("event_id", c("user_agent").startswith("Mozilla/5.0 (").alias("trusted"))
    rows = (cold.join(near, "event_id").join(prior, "event_id").join(browsers, "event_id").join(twins, "event_id")
            .withColumns({"correlation": F.least("correlation", F.lit(1.0)), "memory_sim": F.least("memory_sim", F.lit(1.0))}))
    out = scoring.bayes_fusion(rows, c("prior"))
    return out.select("event_id", "ml", r3("memory_sim"), r3("correlation"), "risk", "prior", "trusted",
                      r3("posterior"), "fused_action")


def r3(name):
    return round_half_up(c(name), 3).alias(name)


# ---------------------------------------------------------------- forest
def telemetry_rows(r):
    return known(r, "ip").select(c("event_id").alias("id"), "t_us", six_digits(IF.vector(M.TELEMETRY)).alias("x"))


def six_digits(x):
    return F.transform(x, r6)


def iforest_score(r):
    rows = stage(telemetry_rows(r), "telemetry")
    forest = IF.fit_telemetry(rows)
    return IF.telemetry_anomaly(IF.decision(rows, forest)).select(c("id").alias("event_id"), "decision", "anomaly", "label")


def iforest_labeled(r):
    vecs = V.anomaly_features(feature_table(r)).select("event_id", "t_us", six_digits("x").alias("x")).join(
        outcomes(r).select("event_id", "is_attack"), "event_id")
    rows = stage(vecs.withColumnRenamed("event_id", "id"), "labelled")
    forest = IF.fit_labelled(rows.filter("not is_attack"), rows.filter("is_attack"))
    return IF.feature_anomaly(IF.decision(rows, forest)).select(
        c("id").alias("event_id"), "decision", "anomaly", "is_anomaly")


def adaptive_decision_forest(r):
    """Decisions with the trained anomaly: from the middle of the time on, scores come from a forest of the newest 1000
    rows before it; up to there, and where too few rows came before, from the cold-start heuristic."""
    rows = stage(telemetry_rows(r), "telemetry")
    mid = rows.agg(F.expr("(min(t_us) + max(t_us)) div 2")).first()[0]
    train = M.newest(rows.filter(c("t_us") <= mid), C.TELEMETRY_ROWS, ("t_us", "id"))
    forest, scored = IF.fit_telemetry(train), D.scored(r, CFG, "ip").withColumn("repeat", F.lit(0.0))
    if forest is not None:
        warm = IF.telemetry_anomaly(IF.decision(rows.filter(c("t_us") > mid), forest)).select(c("id").alias("event_id"), c("anomaly").alias("warm"))
        scored = scored.join(warm, "event_id", "left").withColumn("anomaly", F.coalesce("warm", "anomaly")).drop("warm")
    return D.decide(scored).select("event_id", "total_risk", "action")


def anomaly_heuristic(r):
    both = known(r, "ip")
    warm = scoring.cold_anomaly(c("sensitive_route_ratio"), c("failed_auth_ratio"), c("probe_density"))
    cold = V.cold_anomaly(V.anomaly_features(feature_table(r))).select("event_id", c("anomaly").alias("feature_anomaly"))
    return both.select("event_id", warm.alias("anomaly")).withColumn(
        "label", scoring.cold_anomaly_label(c("anomaly"))).join(cold, "event_id")


# ---------------------------------------------------------------- mining
def url_payloads(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select(c("url").alias("payload"))


def payload_clusters(spark, sf):
    found = stage(MI.cluster_shapes(MI.shapes(url_payloads(spark, sf))), "clusters")
    names = found.groupBy("cluster").agg(F.min("shape").alias("cluster_name"), F.sum("weight").alias("cluster_size"))
    return found.join(names, "cluster").select("shape", "weight", "core", "cluster_name", "cluster_size")


def cluster_core(spark, sf):
    return rounded(MI.mine_rules(url_payloads(spark, sf)).select("core", "cluster_size", "confidence"))


def evolved_rules(spark, sf):
    now = latest_us(RQ.requests(spark, sf, SPREAD))
    return rounded(RU.evolved_rules(MI.mine_rules(url_payloads(spark, sf)), F.lit(now)).drop("auto_generated"))


def queries():
    """Query name -> function of (spark, folder of the tables)."""
    return {
        # sources and sinks
        "src_requests": src_requests,
        "ingest_features": ingest_features,
        "log_requests": named(logs.log_requests),
        "honeypot_log": named(decoys),
        "system_events": system_event_log,
        "upsert_profiles": named(upsert_profiles),
        "blocklist_ops": named(lambda r: tables.block_list(RS.block_ops(r)).select("ip", "t_us", "event_id", "expires_us")),
        "seed_rules": named(seed_rules),
        "log_scan": log_scan,
        "risk_lookup": named(risk_lookup),
        # filters and lookups
        "recent_requests": named(recent_requests),
        "active_blocks": named(active_blocks),
        "is_blocked": named(is_blocked),
        "active_rules": named(lambda r: rule_columns(RU.active_rules(observed_rules(r)))),
        "expire_rules": named(expired),
        "failed_login": named(lambda r: r.filter(text.failed_login(c("method"), c("endpoint"), c("payload"))).select(
            "event_id", "ip", "t_us")),
        "deceptive_hits": named(lambda r: r.filter(text.deceptive_route(c("endpoint"))).select(
            "event_id", "ip", "endpoint", "method")),
        "events_by_type": named(lambda r: RP.events_by_type(system_events(r), "HONEYPOT_INTERACTION", 200).select(
            "event_id", "event_type", "severity", "description", "t_us")),
        # joins
        "rule_performance": named(rule_performance),
        "asof_blocks": named(asof_blocks),
        "rule_match": named(rule_match),
        "rule_sets": named(rule_sets),
        "evolution_multipliers": named(evolution_multipliers),
        # aggregations
        "dashboard_stats": named(dashboard_stats),
        "attacker_members": named(attacker_members),
        "behavior_endpoints": named(behavior_endpoints),
        "attacker_profiles": named(lambda r: RP.attacker_profiles(decoys(r))),
        "honeypot_summary": named(lambda r: RP.honeypot_summary(decoys(r))),
        "forensic_reports": named(forensic_reports),
        "forensic_members": named(lambda r: RP.forensic_members(RP.incidents(decision_table(r), r))),
        "live_dashboard": named(live_dashboard),
        "behavior_profile": named(behavior_profile),
        "feature_rollup": named(lambda r: FT.feature_rollup(r, DAY * SECOND)),
        "profile_summary": named(lambda r: RP.profile_summary(r, latest_us(r), CFG.short_us)),
        "profile_agents": named(lambda r: RP.profile_agents(r, latest_us(r), CFG.short_us)),
        "rule_effectiveness": named(rule_effectiveness),
        "signature_confidence": named(signature_confidence),
        "attack_signatures": named(lambda r: RU.attack_signatures(r)[0]),
        "signature_sources": named(lambda r: RU.attack_signatures(r)[1]),
        "healing_status": named(healing_status),
        "healing_state": named(healing_state),
        # trailing-window features
        "feat_frequency": named(feat_frequency),
        "feat_failure": named(feature_columns("failure_count", "failure_rate", "consecutive_failures", "login_failures",
                                              "failure_score")),
        "feat_pattern": named(feature_columns("unique_endpoints", "sensitive_hits", "scan_pattern",
                                              "enumeration_detected", "unusual_methods", "pattern_score")),
        "feat_payload": named(feature_columns("current_flags", "total_flags_recent", "flags_sql_injection", "flags_xss",
                                              "flags_path_traversal", "flags_command_injection", "payload_score")),
        "feat_session": named(feature_columns("unique_sessions", "unique_user_agents", "bot_indicators",
                                              "session_score")),
        "feat_baseline": named(feature_columns("requests_long", "has_baseline", "rate_deviation", "baseline_score")),
        "enumeration": named(lambda r: FT.features(r.withColumn("site", F.lit("all")), CFG, "site").select(
            "event_id", "enumeration_detected")),
        # identity memory
        "behavior_memory": named(behavior_memory),
        "behavior_memory_ip": named(behavior_memory_ip),
        "behavior_deviation": named(lambda r: known(r).select("event_id", "deviation")),
        "fingerprints": named(lambda r: M.fingerprints(r, CFG)),
        "repeat_offender": named(repeat_offender),
        "deception_intent": named(lambda r: known(r).select("event_id", "hit", "repeats", "fake_posts", "deception")),
        "ml_telemetry": named(lambda r: known(r).select("event_id", *M.TELEMETRY)),
        # top lists
        "recent_history": named(recent_history),
        "latest_n": named(lambda r: M.newest(decoys(r), 100).select("event_id", "ip_address", "interaction_type", "t_us")),
        "risk_ranking": named(risk_ranking),
        "top_k": named(lambda r: RP.top_k(r, c("endpoint"))),
        "blocked_sets": named(lambda r: RP.blocked_sets(decision_table(r))),
        "pool_diversity": named(pool_diversity),
        # text
        "signature_match": signature_match,
        "payload_flags": payload_flags,
        "struct_fingerprint": struct_fingerprint,
        "trigram_tf": trigram_tf,
        "json_props": json_props,
        "lr_calibration": lr_calibration,
        # scores and decisions
        "raw_risk": named(lambda r: RK.raw_risk(feature_table(r)).select("event_id", "boosted_freq", "elevated_signals",
                                                                         "raw")),
        "decayed_risk": named(decayed_risk),
        "risk_level": named(risk_level),
        "decay_all": named(decay_all),
        "adaptive_decision": named(adaptive_decision("fingerprint")),
        "adaptive_decision_ip": named(adaptive_decision("ip")),
        "adaptive_decision_forest": named(adaptive_decision_forest),
        "feedback_decision": named(feedback_decision),
        "decision_summary": named(entry_summary),
        "anomaly_heuristic": named(anomaly_heuristic),
        "iforest_score": named(iforest_score),
        "iforest_labeled": named(iforest_labeled),
        "bayes_fusion": named(bayes_fusion),
        "dynamic_prior": named(lambda r: FB.dynamic_prior(outcomes(r), CFG)),
        "threshold_tuning": named(threshold_tuning),
        "response_actions": named(response_actions),
        "auto_behavior_rules": named(auto_behavior_rules),
        "auto_payload_rules": named(auto_payload_rules),
        "evolution_gate": named(evolution_gate),
        "evolution_loop": named(evolution_loop),
        "corrections_full": named(corrections_full),
        "apply_corrections": named(apply_corrections),
        "component_stats": named(component_stats),
        "defense_state": named(lambda r: RS.defense_state(level_changes(r))),
        # vectors and mining
        "anomaly_features": named(anomaly_features),
        "behavior_embedding": named(behavior_embedding),
        "kb_top1": kb_top1,
        "kb_remove": kb_remove,
        "actor_correlation": actor_correlation,
        "campaigns": campaigns,
        "actor_campaigns": named(actor_campaigns),
        "campaign_rows": named(campaign_rows),
        "payload_clusters": payload_clusters,
        "cluster_core": cluster_core,
        "evolved_rules": evolved_rules,
    }
