"""Structured Streaming jobs over request streams.

Requests have ``ts`` (timestamp) besides the columns of the batch operators. Jobs that carry state per actor run the
batch operators on each micro-batch (``foreachBatch``) and keep their state in versioned tables: batch N reads the
newest version before N and writes version N, so a repeated batch gives the same result, and a busy actor is spread
over tasks in the stream as in batch.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqguard import constants as C
from reqguard.config import SECOND, Config
from reqguard.functions import text
from reqguard.operators import decisions as D
from reqguard.operators import memory as M
from reqguard.operators import risk as RK
from reqguard.operators import vectors as V
from reqguard.session import stage
from reqguard.sources.tables import latest_per_key, load_snapshot, save_snapshot

WATERMARK = "10 minutes"


def with_event_time(requests: DataFrame, column: str = "t_us") -> DataFrame:
    return requests.withColumn("ts", F.timestamp_micros(column)).withWatermark("ts", WATERMARK)


# ------------------------------------------------------------------ windowed roll-up
def feature_rollup(requests: DataFrame, window_s: int = 300, key: str = "ip") -> DataFrame:
    """Requests, failures and distinct endpoints per actor and window, once the watermark has passed it.

    Distinct endpoints are counted by a first aggregation per endpoint, which also thins out a busy actor.
    """
    c = F.col
    size = f"{window_s} seconds"
    per_path = requests.groupBy(F.window("ts", size), key, "endpoint").agg(
        F.count("*").alias("n"), F.count_if(c("status_code").isin(C.FAILURE_CODES)).alias("failed"),
        F.count_if(c("endpoint").isin(C.SENSITIVE_ENDPOINTS)).alias("sensitive"))
    return per_path.groupBy(F.window(F.window_time("window"), size), key).agg(
        F.sum("n").alias("requests"), F.sum("failed").alias("failures"), F.sum("sensitive").alias("sensitive_hits"),
        F.count("*").alias("unique_endpoints")).select(
        F.unix_micros("window.start").alias("window_us"), key, "requests", "failures", "sensitive_hits",
        "unique_endpoints")


def active_actors(vectors: DataFrame, window_s: int = C.CORRELATION_WINDOW_S) -> DataFrame:
    """Newest behaviour vector per actor and window; vectors has ts, ip, t_us and vec."""
    return vectors.groupBy(F.window("ts", f"{window_s} seconds"), "ip").agg(
        F.max_by("vec", F.struct("t_us", "event_id")).alias("vec")).select(
        F.unix_micros("window.start").alias("window_us"), "ip", "vec")


def first_rules(rules: DataFrame) -> DataFrame:
    """Generated rules (kind, key, ts) without repeats within the watermark."""
    return rules.dropDuplicatesWithinWatermark(["kind", "key"])


# ------------------------------------------------------------------ state carried from batch to batch
def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
          available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def memory_batch(state: str, out: str, cfg: Config, key: str = "fingerprint") -> Callable:
    """Identity memory, deviation and decoy score of each batch's requests."""
    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = stage(M.identity_rows(batch, key), "batch")
        kept = load_snapshot(spark, f"{state}/rows", before=n + 1)
        agents = load_snapshot(spark, f"{state}/agents", before=n + 1)
        memory = stage(M.remember_more(new, kept, agents, cfg), "memory")
        _write(M.deception_intent(M.behavior_deviation(memory)), out, n)
        seen = new.filter("user_agent <> ''").select("identity", "user_agent").distinct()
        save_snapshot(seen if agents is None else agents.unionByName(seen).distinct(), f"{state}/agents", n + 1)
        save_snapshot(M.rows_to_keep(kept, new, memory), f"{state}/rows", n + 1)
    return run


def risk_batch(state: str, out: str, cfg: Config, lam: float = C.DECAY_LAMBDA, evict: bool = True) -> Callable:
    """Decayed risk of each batch's rows (event_id, key, t_us, raw). With evict, scores that have fallen below 1 by the
    newest event time seen leave the state; their actors start anew. A row older than the state never raises a score by
    its age."""
    def run(batch: DataFrame, n: int) -> None:
        before = load_snapshot(batch.sparkSession, state, before=n + 1)
        scored = stage(RK.decayed_risk(RK.numbered(batch.select("event_id", "key", "t_us", "raw"), cfg), cfg, lam, before),
                       "scored")
        _write(scored.select("event_id", "key", "t_us", "raw", "score", "risk_level"), out, n)
        rows = scored.select("key", "t_us", "event_id", "score")
        last = latest_per_key(rows if before is None else before.unionByName(rows), ["key"])
        if evict:
            last = stage(last, "last")
            newest_us = last.agg(F.max("t_us")).first()[0]
            last = last if newest_us is None else RK.sweep(last, F.lit(newest_us), lam).select("key", "t_us", "event_id", "score")
        save_snapshot(last, state, n + 1)
    return run


def expiry_batch(state: str, late_us: int = 0) -> Callable:
    """Blocks and locks (item, op, t_us, event_id, expires_us): the last operation per item, kept while in force at the
    newest event time seen, and for late_us more, in which older operations may still come."""
    def run(batch: DataFrame, n: int) -> None:
        before = load_snapshot(batch.sparkSession, state, before=n + 1)
        rows = batch.select("item", "op", "t_us", "event_id", "expires_us")
        last = stage(latest_per_key(rows if before is None else before.unionByName(rows), ["item"]), "last")
        newest_us = last.agg(F.max("t_us")).first()[0]
        if newest_us is not None:
            recent = F.greatest("t_us", F.coalesce("expires_us", "t_us")) > newest_us - late_us
            forever = (F.col("op") != "unblock") & F.col("expires_us").isNull()
            last = last.filter(forever | recent if late_us else forever | ((F.col("op") != "unblock") & (F.col("expires_us") > newest_us)))
        save_snapshot(last, state, n + 1)
    return run


def in_force(table: DataFrame, now_us: Column) -> DataFrame:
    return table.filter((F.col("op") != "unblock") & (F.col("expires_us").isNull() | (F.col("expires_us") > now_us)))


def correlation_batch(out: str, threshold: float = C.CORRELATION_SIM) -> Callable:
    """Correlation between the actors of each finished window of ``active_actors``."""
    def run(batch: DataFrame, n: int) -> None:
        actors = batch.select("window_us", "ip", V.unit(F.col("vec").cast("array<double>")).alias("vec"))
        _write(V.correlate(actors, threshold, group="window_us"), out, n)
    return run


def feedback_batch(state: str, out: str) -> Callable:
    """Decisions with the multipliers of all batches before, then counts for the next one.

    Batches have the columns of ``decisions.scored``.
    """
    def run(batch: DataFrame, n: int) -> None:
        scored = stage(batch, "scored")
        before = load_snapshot(batch.sparkSession, state, before=n + 1)
        empty = batch.sparkSession.createDataFrame([], "kind string, value string, n long")
        table = empty if before is None else before
        rows = D.apply_multipliers(scored, table).withColumns({
            "adj_deviation": F.col("deviation") * F.col("fingerprint_mult"),
            "adj_anomaly": F.col("anomaly") * F.col("fingerprint_mult"),
            "adj_signature": F.col("signature_score") * F.col("signature_mult"),
            "adj_deception": F.col("deception") * F.col("path_mult")})
        decided = stage(D.decide(rows, "adj_deviation", "adj_anomaly", "repeat", "adj_signature", "adj_deception"),
                        "decided")
        _write(decided, out, n)
        counts = table.unionByName(D.severe_counts(decided)).groupBy("kind", "value").agg(F.sum("n").alias("n"))
        save_snapshot(counts, state, n + 1)
    return run


def signatures(requests: DataFrame) -> DataFrame:
    """Stateless scores of a request stream: signatures and payload flags."""
    return text.signature_match(requests).withColumn("flags", text.payload_flags(F.col("payload")))


