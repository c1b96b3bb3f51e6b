"""Per-actor risk: raw score per request, decayed score with memory, and what is left of it later."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import Config
from reqguard.functions import scoring
from reqguard.functions.rounding import round_half_up
from reqguard.operators.running import block_window, rank_blocks, running
from reqguard.session import stage

LEVELS = 1001  # a stored score is one of 0.0, 0.1, ... 100.0
FAN = 1024


def raw_risk(features: DataFrame) -> DataFrame:
    """Add ``raw``, ``boosted_freq`` and ``elevated_signals`` to the trailing-window features."""
    c = F.col
    raw, boosted, elevated = scoring.raw_risk(
        c("freq_score"), c("failure_score"), c("pattern_score"), c("payload_score"), c("session_score"),
        c("baseline_score"), c("burst_detected"), c("acceleration"))
    return features.withColumns({"raw": raw, "boosted_freq": boosted, "elevated_signals": elevated})


def next_score(prev: float, raw: float, seconds: float, lam: float) -> float:
    """Score after a request: decay towards the raw risk, kept near it when it is high, in steps of 0.1."""
    score = raw
    if prev > 0:
        d = math.exp(-lam * seconds)
        score = d * prev + (1 - d) * raw
        if raw > 60:
            score = max(score, raw * 0.9)
    return math.floor(min(100.0, max(0.0, score)) * 10.0 + 0.5) / 10.0


def _fold(lam: float):
    """Fold rows sorted by (key, block, number); each block starts from its ``start`` score."""
    def run(batches):
        at, prev = None, 0.0
        for pdf in batches:
            scores = []
            for key, blk, start, raw, sec in zip(pdf["key"], pdf["_blk"], pdf["start"], pdf["raw"], pdf["seconds"]):
                if (key, blk) != at:
                    at, prev = (key, blk), start
                prev = next_score(prev, raw, sec, lam)
                scores.append(prev)
            yield pd.DataFrame({"event_id": pdf["event_id"], "score": scores})
    return run


def _transfer(lam: float):
    """For one block: the final score, in tenths, for each possible starting score."""
    def run(pdf):
        pdf = pdf.sort_values("rn")
        values, place = np.arange(LEVELS) / 10.0, np.arange(LEVELS)
        for i, (raw, sec) in enumerate(zip(pdf["raw"], pdf["seconds"])):
            d = math.exp(-lam * sec)
            moved = d * values + (1 - d) * raw
            if raw > 60:
                moved = np.maximum(moved, raw * 0.9)
            moved = np.where(values > 0, moved, raw)
            values = np.floor(np.clip(moved, 0.0, 100.0) * 10.0 + 0.5) / 10.0
            if i % 32 == 0 and len(values) > 1:  # starting scores that met stay together
                values, back = np.unique(values, return_inverse=True)
                place = back[place]
        ends = np.rint(values[place] * 10).astype(int)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "_blk": [pdf["_blk"].iloc[0]], "ends": [ends.tolist()]})
    return run


def _compose(pdf):
    state = np.arange(LEVELS)
    for ends in pdf.sort_values("_blk")["ends"]:
        state = np.asarray(ends)[state]
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "_sup": [pdf["_sup"].iloc[0]], "ends": [state.tolist()]})


def _walk(by: str):
    """Starting score of each piece from the ends of the pieces before it; the first starts from ``start``."""
    def run(pdf):
        pdf = pdf.sort_values(by)
        state, starts = int(pdf["start"].iloc[0]), []
        for ends in pdf["ends"]:
            starts.append(state)
            state = int(ends[state])
        out = pd.DataFrame({"key": pdf["key"].to_numpy(), by: pdf[by].to_numpy(), "start": starts})
        after = pd.DataFrame({"key": [pdf["key"].iloc[0]], by: [int(pdf[by].iloc[-1]) + 1], "start": [state]})
        return pd.concat([out, after])
    return run


def block_starts(rows: DataFrame, block_rows: int, lam: float) -> DataFrame:
    """Starting score of every later block of a key that has more than one; ``first`` is that of its first block.

    The recursion rounds to tenths, so a block is fully described by where it takes each of the 1,001 possible scores.
    These tables are built block by block in parallel, composed per run of FAN blocks and then per key.
    """
    full = rows.groupBy("key", "_blk").agg(F.count("*").alias("n")).filter(F.col("n") == block_rows)
    ends = stage(rows.join(full.select("key", "_blk"), ["key", "_blk"]).select("key", "_blk", "rn", "raw", "seconds")
                 .groupBy("key", "_blk").applyInPandas(_transfer(lam), "key string, _blk long, ends array<int>"),
                 "risk-blocks").withColumn("_sup", F.expr(f"_blk div {FAN}"))
    runs = ends.groupBy("key", "_sup").applyInPandas(_compose, "key string, _sup long, ends array<int>")
    first = rows.filter("rn = 1").select("key", F.round(F.col("first") * 10).cast("int").alias("start"))
    run_starts = runs.join(first, "key").groupBy("key").applyInPandas(
        _walk("_sup"), "key string, _sup long, start int")
    starts = ends.join(run_starts, ["key", "_sup"]).groupBy("key", "_sup").applyInPandas(
        _walk("_blk"), "key string, _blk long, start int")
    # the block after a run is also the first block of the next run, with the same start
    return starts.groupBy("key", "_blk").agg((F.first("start") / 10.0).alias("start"))


def decayed_risk(risks: DataFrame, cfg: Config, lam: float = C.DECAY_LAMBDA, state: DataFrame | None = None) -> DataFrame:
    """Add ``score`` and ``risk_level``: the actor's risk after each request, decayed between requests.

    risks has event_id, key, rn (row number per key), t_us, t1 (previous request) and raw. Blocks of a busy key are
    folded in parallel once their starting scores are known; other keys are a single block. ``state`` (key, t_us, score)
    holds the last scores of earlier rows; without it every key starts from 0. A row older than the state counts as if it
    came with it: no decay, and never a gain.
    """
    c = F.col
    if state is not None:
        before = state.select("key", c("t_us").alias("_t"), c("score").alias("first"))
        risks = risks.join(before, "key", "left").withColumns({
            "t1": F.coalesce("t1", "_t"), "first": F.coalesce("first", F.lit(0.0))}).drop("_t")
    else:
        risks = risks.withColumn("first", F.lit(0.0))
    risks = stage(risks, "raw-risk")
    rows = risks.select("event_id", "key", "rn", "raw", "first",
                        F.greatest(F.coalesce((c("t_us") - c("t1")) / 1e6, F.lit(0.0)), F.lit(0.0)).alias("seconds"),
                        F.expr(f"(rn - 1) div {cfg.block_rows}").alias("_blk"))
    long_keys = rows.filter(c("rn") > cfg.block_rows).select("key").distinct()
    starts = block_starts(rows.join(long_keys, "key", "left_semi"), cfg.block_rows, lam)
    rows = rows.join(starts, ["key", "_blk"], "left").withColumn("start", F.coalesce("start", "first"))
    folded = (rows.select("event_id", "key", "_blk", "rn", "start", "raw", "seconds").repartition("key", "_blk")
              .sortWithinPartitions("key", "_blk", "rn").mapInPandas(_fold(lam), "event_id long, score double"))
    return risks.drop("first").join(folded, "event_id").withColumn("risk_level", scoring.risk_level(c("score")))


def numbered(risks: DataFrame, cfg: Config) -> DataFrame:
    """Risks (event_id, key, t_us, raw) with ``rn`` and ``t1``, as ``decayed_risk`` needs them."""
    seen = running(risks, ["key"], {"rn": ("sum", F.lit(1).cast("long"))}, cfg.segment_us)
    blocks = rank_blocks(seen, "rn", cfg.block_rows, 1)
    return (blocks.withColumn("t1", F.lag("t_us").over(block_window(["key"], "rn"))).filter(~F.col("_ghost"))
            .drop("_blk", "_ghost"))


def current_scores(risk: DataFrame) -> DataFrame:
    """Latest score row per actor, with the whole score history as (t_us, score) rows left in ``risk``."""
    return risk.groupBy("key").agg(F.max_by(F.struct(
        "t_us", "event_id", "score", "boosted_freq", "failure_score", "pattern_score", "payload_score",
        "session_score", "baseline_score", "risk_level"), F.struct("t_us", "event_id")).alias("r")).select("key", "r.*")


def risk_at(scores: DataFrame, now_us: Column, lam: float = C.DECAY_LAMBDA) -> DataFrame:
    """Scores decayed to ``now_us``; the level is that of the unrounded score."""
    left = scoring.decayed(F.col("score"), (now_us - F.col("t_us")) / 1e6, lam)
    return scores.withColumns({"current_score": round_half_up(left, 1), "current_level": scoring.risk_level(left),
                               "_left": left})


def sweep(scores: DataFrame, now_us: Column, lam: float = C.DECAY_LAMBDA) -> DataFrame:
    """Scores decayed to ``now_us``, without those that fell below 1."""
    return risk_at(scores, now_us, lam).filter(F.col("_left") >= 1).drop("_left")


def decay_all(scores: DataFrame, factor: float = 0.9, ticks: int = 1) -> DataFrame:
    return scores.withColumn("score", F.col("score") * F.pow(F.lit(factor), F.lit(ticks)))


def risk_lookup(keys: DataFrame, scores: DataFrame) -> DataFrame:
    """Risk of each listed key; keys never seen are NORMAL with score 0."""
    return keys.join(scores, "key", "left").withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "risk_level": F.coalesce("risk_level", F.lit("NORMAL"))})
