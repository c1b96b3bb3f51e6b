"""Confirmed outcomes and corrections: prior, thresholds, labels, and when to evolve."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import SECOND, Config
from reqguard.functions import scoring
from reqguard.operators import rules as rule_ops
from reqguard.operators.memory import newest
from reqguard.operators.mining import pool_diversity
from reqguard.operators.reports import merged
from reqguard.operators.running import running
from reqguard.session import stage


def dynamic_prior(outcomes: DataFrame, cfg: Config, window: int = C.OUTCOME_WINDOW) -> DataFrame:
    """(event_id, n, attacks, prior) before each outcome (event_id, t_us, is_attack), over the last ``window`` ones.

    Outcomes are numbered with a running count over time segments; the attacks among the last ``window`` are the
    difference of two running sums, fetched by number.
    """
    c = F.col
    rows = outcomes.select("event_id", "t_us", c("is_attack").cast("long").alias("hit"), F.lit(0).alias("all"))
    seen = stage(running(rows, ["all"], {"rn": ("sum", F.lit(1).cast("long")), "hits": ("sum", c("hit"))},
                         cfg.segment_us, piece_rows=cfg.block_rows), "outcomes")
    older = seen.select((c("rn") + window + 1).alias("rn"), c("hits").alias("older"))
    attacks = c("hits") - c("hit") - F.coalesce("older", F.lit(0))
    out = seen.join(older, "rn", "left").select(
        "event_id", F.least(c("rn") - 1, F.lit(window)).alias("n"), attacks.alias("attacks"))
    return out.withColumn("prior", prior(c("attacks"), c("n")))


def prior(attacks: Column, n: Column) -> Column:
    return F.when(n == 0, C.BASE_PRIOR).otherwise((attacks + 1) / (n + 50))


def threshold_tuning(outcomes: DataFrame, missed: DataFrame, current: float = C.POSTERIOR_ACTIONS[0][0]) -> DataFrame:
    """One row: the block threshold after the newest 400 outcomes (is_attack) and newest 100 missed attacks."""
    recent = newest(outcomes, 400).agg(F.count("*").alias("n"), F.count_if(~F.col("is_attack")).alias("fp"))
    lost = newest(missed, 100).agg(F.count("*").alias("fn"))
    both = merged([recent, lost])
    fp, fn = F.col("fp") / F.col("n"), F.col("fn") / F.col("n")
    tuned = F.when(F.col("n") >= 20, scoring.tuned_block_threshold(F.lit(current), fp, fn)).otherwise(current)
    return both.withColumn("block_threshold", tuned)


def evolution_gate(attacks: DataFrame, cooldown_us: int = C.EVOLUTION_COOLDOWN_S * SECOND) -> DataFrame:
    """Cool-down periods in which enough different confirmed payloads came together to learn from.

    attacks has t_us and payload; payloads of more than 10 characters are pooled per period.
    """
    pooled = attacks.filter(F.length("payload") > C.EVOLUTION_POOL_CHARS).withColumn(
        "period_us", F.expr(f"(t_us div {cooldown_us}) * {cooldown_us}"))
    return pool_diversity(pooled, ["period_us"]).filter((F.col("n") >= C.EVOLUTION_POOL_MIN) & F.col("diverse"))


def corrected_outcomes(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Outcomes from feedback (event_id, was_attack) on decisions: label, trust, and which error was made."""
    c = F.col
    out = decisions.join(feedback, "event_id")
    flagged = c("action") != "allow"
    return out.withColumns({
        "is_attack": c("was_attack"), "trusted": ~c("was_attack"),
        "error": F.when(flagged & ~c("was_attack"), "false_positive").when(~flagged & c("was_attack"), "false_negative")
        .otherwise("none")})


def apply_corrections(corrections: DataFrame, hits: DataFrame, rules: DataFrame, cfg: Config) -> DataFrame:
    """Rules with the confidence that the corrected outcomes give them; hits (event_id, t_us, pattern) count for the rules
    of their pattern that were in force."""
    judged = hits.join(corrections.select("event_id", F.col("is_attack").alias("is_true_positive")), "event_id")
    return rule_ops.with_confidence(rules, rule_ops.effectiveness_in_force(rules, judged, cfg))


# ------------------------------------------------------------------ corrections as signed changes
def retractions(outcomes: DataFrame, feedback: DataFrame) -> DataFrame:
    """What feedback (event_id, was_attack) changes: for each outcome that it flips, the outcome with its old label and
    step -1, and with its new one and step 1."""
    c = F.col
    old, new = (F.struct(label.alias("is_attack"), F.lit(step).alias("step")) for label, step in ((c("is_attack"), -1), (c("was_attack"), 1)))
    flipped = outcomes.join(feedback.select("event_id", "was_attack"), "event_id").filter(c("is_attack") != c("was_attack"))
    rest = [x for x in outcomes.columns if x != "is_attack"]
    return flipped.select(*rest, F.explode(F.array(old, new)).alias("_change")).select(*rest, "_change.*")


def label_counts(outcomes: DataFrame) -> DataFrame:
    """(is_attack, n): the state that `corrected_labels` keeps up to date."""
    return outcomes.groupBy("is_attack").agg(F.count("*").alias("n"))


def corrected_labels(counts: DataFrame, changes: DataFrame) -> DataFrame:
    return counts.unionByName(changes.groupBy("is_attack").agg(F.sum("step").alias("n"))).groupBy("is_attack").agg(F.sum("n").alias("n"))


def corrected_memory(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Memory entries (entry_id) without those whose event was no attack, and with those whose event was one."""
    ids = changes.filter("step = 1").select(F.col("event_id").alias("entry_id"), "is_attack")
    kept = entries.join(ids.filter("NOT is_attack"), "entry_id", "left_anti").select("entry_id")
    return kept.unionByName(ids.filter("is_attack").select("entry_id")).distinct()


def corrected_effectiveness(counts: DataFrame, hits: DataFrame, changes: DataFrame, rules: DataFrame, cfg: Config) -> DataFrame:
    """Effectiveness of rules from their counts and the changes, which count for the patterns (hits: event_id, pattern)
    that their events match, in the rules that were in force."""
    moved = hits.select("event_id", "pattern").join(changes.select("event_id", "t_us", F.col("is_attack").alias("is_true_positive"), "step"), "event_id")
    both = counts.unionByName(rule_ops.counts_in_force(rules, moved, cfg))
    total = both.groupBy("rule_id", "rule_name").agg(*[F.sum(x).alias(x) for x in ("true_positives", "false_positives")], F.max("last_us").alias("last_us"))
    return rule_ops.with_effectiveness(total.filter(F.col("true_positives") + F.col("false_positives") > 0))


def prior_state(outcomes: DataFrame, window: int = C.OUTCOME_WINDOW) -> DataFrame:
    """One row: n and attacks among the newest outcomes, and from which place (from_us, from_id) on they lie."""
    first = F.min(F.struct("t_us", "event_id"))
    return newest(outcomes, window).agg(F.count("*").alias("n"), F.count_if("is_attack").alias("attacks"), first["t_us"].alias("from_us"), first["event_id"].alias("from_id"))


def corrected_prior(state: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: n, attacks and prior after the changes to outcomes that the state counts."""
    c = F.col
    attacks = changes.filter("is_attack").groupBy("t_us", "event_id").agg(F.sum("step").alias("step"))
    start = state.select("from_us", "from_id").first()  # one row
    at = F.lit(start["from_us"])
    inside = attacks.filter((c("t_us") > at) | ((c("t_us") == at) & (c("event_id") >= F.lit(start["from_id"])))).agg(F.coalesce(F.sum("step"), F.lit(0)).alias("more"))
    both = merged([state.select("n", "attacks"), inside])
    return both.select("n", (c("attacks") + c("more")).alias("attacks")).withColumn("prior", prior(c("attacks"), c("n")))
