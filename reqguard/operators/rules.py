"""Defense rules: defaults, matching, effectiveness, generation from behaviour and payloads."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import Config
from reqguard.functions import text
from reqguard.operators.running import running
from reqguard.sources.schemas import RULES
from reqguard.sources.tables import insert_absent

MATCH_BATCH = 500
FAN = 1024


def default_rules(spark: SparkSession, created_us: int = 0) -> DataFrame:
    rows = [(i, name, kind, pattern, action, severity, True, 0, 0.5, created_us, None, False, None)
            for i, (name, kind, pattern, action, severity) in enumerate(C.DEFAULT_RULES, start=1)]
    return spark.createDataFrame(rows, RULES)


def seed_rules(rules: DataFrame) -> DataFrame:
    """Rules with the defaults added where no rule of that name exists."""
    return insert_absent(rules, default_rules(rules.sparkSession), ["rule_name"])


def active_rules(rules: DataFrame) -> DataFrame:
    """Active rules; severities sort as text, descending."""
    return rules.filter("is_active").orderBy(F.desc("severity"), "rule_name")


def expire_rules(rules: DataFrame, now_us: Column) -> tuple[DataFrame, DataFrame]:
    """(rules still valid, expired rules)"""
    gone = F.coalesce(F.col("expires_us") < now_us, F.lit(False))
    return rules.filter(~gone), rules.filter(gone)


def _usable(spark: SparkSession, pattern: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def pattern_hits(payloads: DataFrame, rules: DataFrame, *kept: str) -> DataFrame:
    """(kept columns, pattern) for each distinct pattern of an active payload rule that a payload matches.

    Generated rules repeat few patterns under many names, so each distinct pattern is evaluated once. Patterns are
    literals in the plan, compiled once per task; rows are matched without a shuffle, in batches of patterns, and any
    number of patterns is applied. Those that do not compile are left out.
    """
    spark, target = payloads.sparkSession, F.lower("payload")
    wanted = usable_rules(rules).select("pattern").distinct().orderBy("pattern")
    parts, batch = [], []

    def matched():
        hits = F.array(*[F.when((target != "") & target.rlike("(?di)" + p), F.lit(p)) for p in batch])
        return payloads.select(*kept, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("pattern"))

    for row in wanted.toLocalIterator():
        if _usable(spark, row["pattern"]):
            batch.append(row["pattern"])
        if len(batch) == MATCH_BATCH:
            parts.append(matched())
            batch = []
    if batch or not parts:
        batch = batch or ["(?!)"]
        parts.append(matched())
    return reduce(lambda a, b: a.unionByName(b), parts)


def usable_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("is_active").filter("rule_type = 'PAYLOAD' and pattern is not null and pattern <> ''")


def rule_hits(payloads: DataFrame, rules: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, rule_name, action, severity): each active payload rule that a payload matches."""
    return pattern_hits(payloads, rules, key).join(usable_rules(rules).select("pattern", "rule_name", "action", "severity"), "pattern").drop("pattern")


def rule_match(payloads: DataFrame, rules: DataFrame, key: str = "event_id") -> DataFrame:
    """Add ``matched_rules`` (names of all active rules that match, in rule order) and ``blocked`` to rows with a payload."""
    names = F.array_sort(F.collect_list(F.struct("severity", "rule_name")), lambda a, b: (
        F.when(a["severity"] > b["severity"], -1).when(a["severity"] < b["severity"], 1)
        .when(a["rule_name"] < b["rule_name"], -1).when(a["rule_name"] > b["rule_name"], 1).otherwise(0)))
    found = rule_hits(payloads, rules, key).groupBy(key).agg(
        F.transform(names, lambda x: x["rule_name"]).alias("matched_rules"), F.max(F.col("action") == "BLOCK").alias("blocked"))
    return payloads.join(found, key, "left").withColumns({
        "matched_rules": F.coalesce("matched_rules", F.array().cast("array<string>")), "blocked": F.coalesce("blocked", F.lit(False))})


# ------------------------------------------------------------------ rules in force at a request
START, END = -(2 ** 62), 2 ** 62


def rule_lives(rules: DataFrame) -> DataFrame:
    """(id, rule_name, pattern, action, severity, from_us, until_us) of the usable rules: a rule is in force from its
    creation until just before it expires. One that expires before it is created never is."""
    born, gone = F.coalesce("created_us", F.lit(START)), F.coalesce("expires_us", F.lit(END))
    return usable_rules(rules).filter(born < gone).select(
        "id", "rule_name", "pattern", "action", "severity", born.alias("from_us"), gone.alias("until_us"))


def rule_changes(rules: DataFrame) -> DataFrame:
    """(pattern, at_us, rules, blocking): by how much the number of a pattern's rules in force, and of those that block,
    changes at a time. At most two rows for each rule."""
    steps = F.array(F.struct(F.col("from_us").alias("at_us"), F.lit(1).alias("step")),
                    F.struct(F.col("until_us").alias("at_us"), F.lit(-1).alias("step")))
    rows = rule_lives(rules).select("pattern", "action", F.explode(steps).alias("s")).filter(F.col("s.at_us") < END)
    step = F.col("s.step").cast("long")
    return rows.groupBy("pattern", "s.at_us").agg(
        F.sum(step).alias("rules"), F.sum(F.when(F.col("action") == "BLOCK", step).otherwise(0)).alias("blocking"))


def set_id(pattern: str = "pattern", since: str = "since_us") -> Column:
    """Names the rules of a pattern that are in force together from some time on."""
    return F.concat(F.substring(F.md5(pattern), 1, 16), F.lit("@"), F.col(since).cast("string"))


def hits_in_force(hits: DataFrame, rules: DataFrame, cfg: Config) -> DataFrame:
    """Hits (event_id, t_us, pattern) while a rule of their pattern is in force, with n_rules and n_blocking (how many
    are, and block) and since_us (the last time that changed).

    Hits and changes lie on one timeline per pattern, on which the changes are summed; a row is made for each hit, however
    many rules share its pattern, and a pattern that many payloads match is spread over time segments.
    """
    zero = F.lit(0).cast("long")
    asked = hits.select("pattern", "t_us", "event_id", F.lit(1).alias("turn"), zero.alias("rules"), zero.alias("blocking"),
                        F.lit(None).cast("long").alias("change_us"))
    changes = rule_changes(rules).select("pattern", F.col("at_us").alias("t_us"), zero.alias("event_id"), F.lit(0).alias("turn"), "rules",
                                         "blocking", F.col("at_us").alias("change_us"))
    seen = running(asked.unionByName(changes), ["pattern"], {
        "n_rules": ("sum", F.col("rules")), "n_blocking": ("sum", F.col("blocking")), "since_us": ("max", F.col("change_us"))},
        cfg.segment_us, ("t_us", "turn", "event_id"))
    return seen.filter("turn = 1 AND n_rules > 0").select("event_id", "t_us", "pattern", "n_rules", "n_blocking", "since_us")


def rules_at_requests(requests: DataFrame, rules: DataFrame, cfg: Config) -> DataFrame:
    """Requests (event_id, t_us, payload) -> event_id, n_rules (matched rules in force at the time), blocked and rule_sets
    (the sets of `rule_sets` whose rules match, in order): one row for each request."""
    hits = hits_in_force(pattern_hits(requests, rules, "event_id", "t_us"), rules, cfg)
    none = requests.select("event_id", F.lit(0).cast("long").alias("n_rules"), F.lit(False).alias("blocks"), F.lit(None).cast("string").alias("rule_set"))
    found = hits.select("event_id", "n_rules", (F.col("n_blocking") > 0).alias("blocks"), set_id().alias("rule_set"))
    return none.unionByName(found).groupBy("event_id").agg(
        F.sum("n_rules").alias("n_rules"), F.bool_or("blocks").alias("blocked"), F.sort_array(F.collect_list("rule_set")).alias("rule_sets"))


def rule_sets(rules: DataFrame) -> DataFrame:
    """(rule_set, pattern, since_us, rule_name, action, severity): a row for each rule of each set of rules that are in
    force together. Rules that expire are matched with the sets of the time cells they live in, whose width is the longest
    life, so a rule meets the sets of two cells at most."""
    lives = rule_lives(rules)
    sets = rule_changes(rules).select("pattern", F.col("at_us").alias("since_us"))
    mortal = lives.filter(F.col("until_us") < END)
    width = mortal.agg(F.max(F.col("until_us") - F.col("from_us"))).first()[0] or 1
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    short = mortal.withColumn("last_us", F.col("until_us") - 1).withColumn("_cell", F.explode(F.sequence(cell("from_us"), cell("last_us"))))
    now = F.col("since_us").between(F.col("from_us"), F.col("until_us") - 1)
    kept = [set_id().alias("rule_set"), "pattern", "since_us", "rule_name", "action", "severity"]
    return (short.join(sets.withColumn("_cell", cell("since_us")), ["pattern", "_cell"]).filter(now).select(*kept)
            .unionByName(lives.filter(F.col("until_us") >= END).join(sets, "pattern").filter(now).select(*kept)))


def effectiveness_in_force(rules: DataFrame, hits: DataFrame, cfg: Config) -> DataFrame:
    """Per rule with hits while it was in force: counts and smoothed effectiveness; hits has event_id, t_us, pattern and
    is_true_positive."""
    counted = counts_in_force(rules, hits.withColumn("step", F.lit(1)), cfg)
    return with_effectiveness(counted.filter(F.col("true_positives") + F.col("false_positives") > 0))


def counts_in_force(rules: DataFrame, hits: DataFrame, cfg: Config) -> DataFrame:
    """(rule_id, rule_name, true_positives, false_positives, last_us) of every rule; hits have a step, which is added to
    one of the counts: 1, or -1 to take a hit back.

    A rule's counts are what the running counts of its pattern's hits gain between its creation and its expiry, so hits
    are never multiplied by rules.
    """
    c, zero = F.col, F.lit(0).cast("long")
    step = c("step").cast("long")
    lives = rule_lives(rules)
    shown = hits.select("pattern", "t_us", F.lit(1).alias("turn"), "event_id", F.when(c("is_true_positive"), step).otherwise(0).alias("tp"),
                        F.when(c("is_true_positive"), 0).otherwise(step).alias("fp"), F.when(step > 0, c("t_us")).alias("hit_us"))
    marks = lives.select("pattern", F.explode(F.array("from_us", "until_us")).alias("t_us"), F.lit(0).alias("turn"), c("id").alias("event_id"),
                         zero.alias("tp"), zero.alias("fp"), "rule_name", "from_us")
    seen = running(shown.unionByName(marks, allowMissingColumns=True), ["pattern"], {
        "hits": ("sum", c("tp")), "misses": ("sum", c("fp")), "last_us": ("max", c("hit_us"))}, cfg.segment_us, ("t_us", "turn", "event_id"))
    start = F.when(c("t_us") == c("from_us"), -1).otherwise(1)
    return seen.filter("turn = 0").groupBy(c("event_id").alias("rule_id"), "rule_name").agg(
        F.sum(c("hits") * start).alias("true_positives"), F.sum(c("misses") * start).alias("false_positives"), F.max("last_us").alias("last_us"))


def with_effectiveness(counts: DataFrame) -> DataFrame:
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return counts.withColumns({"true_negatives": F.lit(0).cast("long"), "false_negatives": F.lit(0).cast("long"),
                               "effectiveness": (tp + 1) / (tp + fp + 2)})


def rule_effectiveness(rules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per rule with outcomes (rule_name, is_true_positive, t_us): counts and smoothed effectiveness."""
    seen = outcomes.groupBy("rule_name").agg(
        F.count_if("is_true_positive").alias("true_positives"),
        F.count_if(~F.col("is_true_positive")).alias("false_positives"), F.max("t_us").alias("last_us"))
    return with_effectiveness(rules.select(F.col("id").alias("rule_id"), "rule_name").join(seen, "rule_name"))


def with_confidence(rules: DataFrame, effectiveness: DataFrame) -> DataFrame:
    """Rules whose confidence is their effectiveness, where known."""
    known = effectiveness.select(F.col("rule_id").alias("id"), "effectiveness")
    return (rules.join(known, "id", "left")
            .withColumn("confidence", F.coalesce("effectiveness", "confidence")).drop("effectiveness"))


def rule_performance(rules: DataFrame, effectiveness: DataFrame) -> DataFrame:
    return (rules.select("id", "rule_name")
            .join(effectiveness.drop("rule_name"), F.col("id") == F.col("rule_id")).drop("id")
            .orderBy(F.desc("effectiveness"), "rule_name"))


def signature_confidence(changes: DataFrame, cfg: Config, start: float = 0.5) -> DataFrame:
    """Confidence per signature after its changes (signature, t_us, event_id, delta), clamped to [0, 1] at each one.

    "Add, then clamp" steps combine to one such step: x -> min(hi, max(lo, x + add)). A signature's changes are numbered
    and cut into blocks, each block is reduced to one step, runs of blocks again, and what is left is applied in order.
    """
    c = F.col

    def then(f, g):
        def clamp(x):
            return F.greatest(g["lo"], F.least(g["hi"], x))
        return F.struct((f["add"] + g["add"]).alias("add"), clamp(f["lo"] + g["add"]).alias("lo"),
                        clamp(f["hi"] + g["add"]).alias("hi"))

    nothing = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    rows = running(changes, ["signature"], {"at": ("sum", F.lit(1).cast("long"))}, cfg.segment_us)
    steps = rows.select("signature", (c("at") - 1).alias("at"), F.lit(1).cast("long").alias("changes"), F.struct(
        c("delta").alias("add"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")).alias("f"))
    for size in (cfg.block_rows, FAN):
        steps = (steps.groupBy("signature", F.expr(f"at div {size}").alias("at"))
                 .agg(F.sum("changes").alias("changes"), F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs"))
                 .select("signature", "at", "changes", F.aggregate("fs", nothing, lambda f, s: then(f, s["f"])).alias("f")))
    last = steps.groupBy("signature").agg(F.sum("changes").alias("changes"),
                                          F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs"))
    return last.select("signature", "changes", F.aggregate("fs", F.lit(start), lambda x, s: F.least(
        s["f"]["hi"], F.greatest(s["f"]["lo"], x + s["f"]["add"]))).alias("confidence"))


def attack_signatures(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures with first and last time, count, number of sources, severity; their source ips, one row each)"""
    flagged = (requests.withColumn("flags", text.payload_flags(F.col("payload"))).filter(F.size("flags") > 0)
               .withColumn("signature", F.sha2("payload", 256)))
    severe = F.arrays_overlap("flags", F.array(F.lit("SQL_INJECTION"), F.lit("COMMAND_INJECTION")))
    table = flagged.groupBy("signature").agg(
        F.min(F.array_join("flags", "+")).alias("attack_type"), F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"), F.count("*").alias("occurrences"), F.count_distinct("ip").alias("n_sources"),
        F.max(F.when(severe, "HIGH").otherwise("MEDIUM")).alias("_severity"), F.bool_or(severe).alias("_high"))
    table = table.withColumn("severity", F.when(F.col("_high"), "HIGH").otherwise("MEDIUM"))
    return (table.drop("_severity", "_high"),
            flagged.select("signature", F.col("ip").alias("source_ip")).distinct())


def behavior_rules(features: DataFrame) -> DataFrame:
    """Rules from behaviour: the first time each (kind, actor) meets its condition while its risk is at least 50.

    features has key, event_id, t_us, score and the trailing-window features.
    """
    c = F.col
    key = c("key")
    kinds = [
        ("BRUTE_FORCE", c("login_failures") > 5, "RATE", F.concat(F.lit("login:"), key, F.lit(":max_3/min")), "BLOCK",
         "HIGH"),
        ("BURST", c("burst_detected") | (c("acceleration") > 5), "RATE",
         F.concat(F.lit("burst:"), key, F.lit(":max_5/10s")), "THROTTLE", "MEDIUM"),
        ("SCAN", c("scan_pattern") | (c("unique_endpoints") > 12), "ACCESS",
         F.to_json(F.struct(key.alias("blocked_ip"))), "BLOCK", "HIGH"),
        ("ENUM", c("enumeration_detected"), "ACCESS",
         F.to_json(F.struct(key.alias("blocked_ip"), F.lit("enum").alias("type"))), "BLOCK", "HIGH"),
    ]
    hits = F.filter(F.array(*[F.when(cond, F.struct(
        F.lit(kind).alias("kind"), F.lit(rtype).alias("rule_type"), pattern.alias("pattern"),
        F.lit(action).alias("action"), F.lit(severity).alias("severity")))
        for kind, cond, rtype, pattern, action, severity in kinds]), lambda x: x.isNotNull())
    made = (features.filter(c("score") >= 50).select("key", "event_id", "t_us", F.explode(hits).alias("h"))
            .select("key", "event_id", "t_us", "h.*"))
    first = made.groupBy("kind", "key").agg(F.min(F.struct(
        "t_us", "event_id", "rule_type", "pattern", "action", "severity")).alias("f")).select("kind", "key", "f.*")
    return _as_rules(first, F.concat(F.lit("Auto_"), c("kind"), F.lit("_"), F.substring(F.md5(
        F.concat_ws("_", "kind", "key")), 1, 8)))


def payload_rules(requests: DataFrame, bucket_us: int = 300_000_000) -> DataFrame:
    """Rules from payload flags: the first request per flag and time bucket; requests has a risk ``score``."""
    c = F.col
    found = (requests.filter(c("score") >= 50).select(
        "event_id", "t_us", F.col("key"), F.explode(text.payload_flags(c("payload"))).alias("kind"))
        .withColumn("bucket", F.expr(f"t_us div {bucket_us}")))
    first = found.groupBy("kind", "bucket").agg(F.min(F.struct("t_us", "event_id", "key")).alias("f")).select(
        "kind", "bucket", "f.*")
    pattern, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for flag, (p, s) in C.AUTO_PAYLOAD_RULES.items():
        pattern = F.when(c("kind") == flag, p).otherwise(pattern)
        severity = F.when(c("kind") == flag, s).otherwise(severity)
    rows = first.withColumns({"rule_type": F.lit("PAYLOAD"), "pattern": pattern, "action": F.lit("BLOCK"),
                              "severity": severity})
    return _as_rules(rows, F.concat(F.lit("Auto_"), c("kind"), F.lit("_"), c("bucket").cast("string")))


def _as_rules(rows: DataFrame, name: Column) -> DataFrame:
    return rows.select(
        "kind", "key", "event_id", "t_us", name.alias("rule_name"), "rule_type", "pattern", "action", "severity",
        F.lit(C.AUTO_RULE_CONFIDENCE).alias("confidence"), F.col("t_us").alias("created_us"),
        (F.col("t_us") + C.RULE_TTL_S * 1_000_000).alias("expires_us"), F.lit(True).alias("auto_generated"))


def healing_log(rules: DataFrame) -> DataFrame:
    """One log row per generated rule."""
    pattern = F.when(F.col("rule_type") == "PAYLOAD", F.col("pattern")).otherwise(
        F.concat(F.lit("IP="), F.col("key")))
    return rules.select("event_id", F.col("kind").alias("attack_type"), pattern.alias("pattern_detected"),
                        F.col("rule_name").alias("rule_generated"), F.col("t_us").alias("applied_us"))


def pattern_of(core: Column) -> Column:
    return F.concat(F.lit(".*"), text.escape_regex(core), F.lit(".*"))


def evolved_rules(cores: DataFrame, now_us: Column, min_confidence: float = 0.6) -> DataFrame:
    """Rules from mined payload cores (core, cluster_size, confidence) that are sure enough to inject."""
    sure = cores.filter(F.col("confidence") > min_confidence).withColumn("pattern", pattern_of(F.col("core")))
    high = F.when(F.col("confidence") > 0.8, "HIGH").otherwise("MEDIUM")
    return sure.select(
        F.concat(F.lit("Evolve_"), F.substring(F.md5("pattern"), 1, 8)).alias("rule_name"),
        F.lit("PAYLOAD").alias("rule_type"), "pattern", F.lit("BLOCK").alias("action"), high.alias("severity"),
        F.lit(C.AUTO_RULE_CONFIDENCE).alias("confidence"), now_us.alias("created_us"),
        (now_us + C.RULE_TTL_S * 1_000_000).alias("expires_us"), F.lit(True).alias("auto_generated"),
        F.concat(F.lit("mined, sure to "), F.format_string("%.2f", F.col("confidence")), F.lit(", payloads "),
                 F.col("cluster_size").cast("string")).alias("description"))
