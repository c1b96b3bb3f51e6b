"""Adaptive decisions with feedback: repeat offenders and multipliers raised by earlier severe actions.

An action depends on the actions taken before it, as if requests came one by one. More severe actions only ever raise the
scores, so the decisions are found from below: severe without any feedback, then what those make severe, and so on, until
no action turns severe. Each round looks only at the keys of the actions that turned severe in the last one.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import Config
from reqguard.functions import scoring, text
from reqguard.operators import memory as M
from reqguard.operators.running import running
from reqguard.session import stage


def scored(requests: DataFrame, cfg: Config, key: str = "fingerprint") -> DataFrame:
    """Requests with deviation, anomaly (cold-start heuristic), signature and decoy scores."""
    known = M.telemetry(M.deception_intent(M.behavior_deviation(M.behavior_memory(requests, cfg, key))))
    anomaly = scoring.cold_anomaly(F.col("sensitive_route_ratio"), F.col("failed_auth_ratio"), F.col("probe_density"))
    known = known.withColumn("anomaly", anomaly).select("event_id", "deviation", "anomaly", "deception")
    rows = text.signature_match(M.identified(requests, key)).select(
        "event_id", "t_us", "ip", "endpoint", "method", "fingerprint", "identity", "matched", "signature_score")
    return rows.join(known, "event_id")


def decide(df: DataFrame, deviation="deviation", anomaly="anomaly", repeat="repeat", signature="signature_score",
           deception="deception") -> DataFrame:
    """Add ``total_risk``, ``action`` and ``reason`` from five score columns."""
    cols = [F.col(x) for x in (deviation, anomaly, signature, deception)]
    out = df.withColumn("total_risk", scoring.total_risk(
        F.col(deviation), F.col(anomaly), F.col(repeat), F.col(signature), F.col(deception)))
    return out.withColumns({"action": scoring.adaptive_action(F.col("total_risk"), *cols),
                            "reason": scoring.adaptive_reason(F.col("total_risk"), *cols)})


def severe(action="action"):
    return F.col(action).isin(C.SEVERE_ACTIONS)


def feedback_keys(actions: DataFrame) -> DataFrame:
    """(event_id, t_us, k): what an action counts for and looks up, a row each for its path, fingerprint and signatures."""
    c = F.col

    def item(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    keys = F.concat(F.array(item("path", c("endpoint")), item("fingerprint", c("fingerprint"))),
                    F.transform("matched", lambda s: item("signature", s)))
    return actions.select("event_id", "t_us", F.explode(keys).alias("k"))


COUNTS = ["path_actions", "fingerprint_actions", "signature_actions", "n_signatures"]


def earlier_severe(keys: DataFrame, cfg: Config) -> DataFrame:
    """Rows (event_id, t_us, k, severe) -> per event the number of earlier severe ones on its path, its fingerprint and
    each of its signatures, and how many signatures it has.

    All three lookups are running counts of the same rows under different keys, so they are computed as one.
    """
    c = F.col
    seen = running(keys, ["k"], {"earlier": ("sum", c("severe"), "before")}, cfg.segment_us)

    def of(kind):
        return F.when(c("k.kind") == kind, c("earlier"))

    return seen.groupBy("event_id").agg(
        F.max(of("path")).alias("path_actions"), F.max(of("fingerprint")).alias("fingerprint_actions"),
        F.sum(of("signature")).alias("signature_actions"), F.count(of("signature")).alias("n_signatures"))


def prior_severe(actions: DataFrame, cfg: Config) -> DataFrame:
    """For each action, the number of earlier severe ones on its path, fingerprint and each of its signatures."""
    flags = actions.select("event_id", severe().cast("long").alias("severe"))
    return earlier_severe(feedback_keys(actions).join(flags, "event_id"), cfg)


def raised(counts: DataFrame) -> DataFrame:
    """Adds path, fingerprint and signature multipliers and the repeat-offender score to rows with COUNTS."""
    c = F.col
    sig = F.when(c("n_signatures") > 0,
                 F.lit(1.0) + c("signature_actions").cast("double") * 0.15 / c("n_signatures")).otherwise(1.0)
    return counts.withColumns({
        "path_mult": F.lit(1.0) + c("path_actions") * 0.1, "fingerprint_mult": F.lit(1.0) + c("fingerprint_actions") * 0.25,
        "signature_mult": sig, "repeat": F.least(F.lit(100.0), c("fingerprint_actions") * 25.0)})


def multipliers(actions: DataFrame, cfg: Config) -> DataFrame:
    """Per event: path, fingerprint and signature multipliers and the repeat-offender score before the event."""
    return raised(prior_severe(actions, cfg)).select("event_id", "path_mult", "fingerprint_mult", "signature_mult", "repeat")


def first_pass(requests: DataFrame, cfg: Config, key: str = "fingerprint") -> DataFrame:
    """Decisions without feedback: no repeat score, all multipliers 1."""
    return decide(scored(requests, cfg, key).withColumn("repeat", F.lit(0.0)))


def adjusted(scores: DataFrame) -> DataFrame:
    """Decisions from scores and COUNTS."""
    c = F.col
    out = raised(scores).withColumns({
        "adj_deviation": c("deviation") * c("fingerprint_mult"), "adj_anomaly": c("anomaly") * c("fingerprint_mult"),
        "adj_signature": c("signature_score") * c("signature_mult"), "adj_deception": c("deception") * c("path_mult")})
    return decide(out, "adj_deviation", "adj_anomaly", "repeat", "adj_signature", "adj_deception")


def with_feedback(actions: DataFrame, cfg: Config) -> DataFrame:
    """First-pass decisions (written) -> the decisions that are taken when each one sees the severe actions before it.

    A first round counts all severe actions of the first pass. Each further round counts, on the keys of the actions that
    turned severe in the round before, how many more lie before an event, and decides those events again that gained. It
    ends when no action turns severe, which is after as many rounds as the longest chain of actions that made each other
    severe. Counts of all rounds add up to the counts of all severe actions, so the result is that of a replay.
    """
    c = F.col
    severe_now = severe().cast("long").alias("severe")
    keys = stage(actions.select("event_id", "t_us", "endpoint", "fingerprint", "matched", severe_now).transform(
        lambda a: feedback_keys(a).join(a.select("event_id", "severe"), "event_id")), "feedback-keys")
    scores = actions.withColumn("_before", severe()).drop("repeat", "total_risk", "action", "reason")
    taken = stage(adjusted(scores.join(earlier_severe(keys, cfg), "event_id")), "feedback")
    turned = stage(taken.filter(severe() & ~c("_before")).select("event_id"), "feedback-turned")
    added = later = None
    while not turned.isEmpty():
        mine = turned.withColumn("_turned", F.lit(1).cast("long"))
        hot = keys.join(turned, "event_id", "left_semi").select("k").distinct()
        steps = keys.join(hot, "k", "left_semi").join(mine, "event_id", "left").select(
            "event_id", "t_us", "k", F.coalesce("_turned", F.lit(0).cast("long")).alias("severe"))
        more = earlier_severe(steps, cfg).select("event_id", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in COUNTS[:3]])
        more = stage(more.filter(" + ".join(COUNTS[:3]) + " > 0"), "feedback-more")
        added = more if added is None else stage(added.unionByName(more).groupBy("event_id").agg(*[F.sum(x).alias(x) for x in COUNTS[:3]]), "feedback-added")
        again = with_more(taken.filter(~severe()), added.join(more, "event_id", "left_semi"), "inner")
        again = again if later is None else again.join(later, "event_id", "left_anti")
        turned = stage(again.filter(severe()).select("event_id"), "feedback-turned")
        later = turned if later is None else stage(later.unionByName(turned), "feedback-later")
    return (taken if added is None else with_more(taken, added, "left")).drop("_before", *COUNTS)


def with_more(taken: DataFrame, added: DataFrame, how: str) -> DataFrame:
    """Decisions again, with what was added to their counts."""
    more = added.select("event_id", *[F.col(x).alias(f"_{x}") for x in COUNTS[:3]])
    rows = taken.join(more, "event_id", how).withColumns({
        x: F.col(x) + F.coalesce(f"_{x}", F.lit(0).cast("long")) for x in COUNTS[:3]}).drop(*[f"_{x}" for x in COUNTS[:3]])
    made = ["repeat", "total_risk", "action", "reason", "path_mult", "fingerprint_mult", "signature_mult",
            "adj_deviation", "adj_anomaly", "adj_signature", "adj_deception"]
    return adjusted(rows.drop(*made))


def decisions(requests: DataFrame, cfg: Config, key: str = "fingerprint") -> DataFrame:
    """The full decision table: one row per request, with scores, multipliers, action and reason."""
    return with_feedback(stage(first_pass(requests, cfg, key), "first-pass"), cfg)


def apply_multipliers(actions: DataFrame, frozen: DataFrame) -> DataFrame:
    """Multipliers from a frozen table (kind, value, n) of completed epochs, 1.0 where nothing is known."""
    c = F.col

    def table(kind, name):
        return frozen.filter(c("kind") == kind).select(c("value").alias(name), c("n").alias(f"_{kind}"))

    sigs = actions.select("event_id", F.explode("matched").alias("sig")).join(
        table("signature", "sig"), "sig", "left").groupBy("event_id").agg(
        F.avg(F.lit(1.0) + F.coalesce("_signature", F.lit(0)) * 0.15).alias("signature_mult"))
    out = (actions.join(table("path", "endpoint"), "endpoint", "left")
           .join(table("fingerprint", "fingerprint"), "fingerprint", "left").join(sigs, "event_id", "left"))
    n_fp = F.coalesce("_fingerprint", F.lit(0))
    return out.withColumns({
        "path_mult": F.lit(1.0) + F.coalesce("_path", F.lit(0)) * 0.1, "fingerprint_mult": F.lit(1.0) + n_fp * 0.25,
        "signature_mult": F.coalesce("signature_mult", F.lit(1.0)),
        "repeat": F.least(F.lit(100.0), n_fp * 25.0)}).drop("_path", "_fingerprint")


def severe_counts(actions: DataFrame) -> DataFrame:
    """Table (kind, value, n): severe actions per path, fingerprint and signature, for ``apply_multipliers``."""
    return feedback_keys(actions.filter(severe())).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))
