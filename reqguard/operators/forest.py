"""Isolation forest: trees are grown as Spark tasks from bounded sub-samples, scoring is a vectorised expression."""

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.functions import scoring
from reqguard.functions.rounding import round_half_up
from reqguard.operators.memory import newest
from reqguard.session import sent


def average_path(n):
    """Mean path length of an unsuccessful search in a tree over n rows."""
    n = np.asarray(n, dtype=float)
    big = np.where(n > 2, n, 3.0)
    out = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


#: All random choices are hashes in whole numbers below this prime, so that any engine can grow the same forest.
PRIME = 2_147_483_647


def mixed(a, b):
    """A number below PRIME from two others below 2^31; for Python's numbers and for columns."""
    z = (a * 7919 + b * 104_729 + 12_345) % PRIME
    z = (z * z + a) % PRIME
    return (z * z + b * 31 + 7) % PRIME


def tree_key(seed: int, tree):
    return tree + seed * 1000


@dataclass(frozen=True)
class Forest:
    """Node arrays (tree x node) and the score offset. A node's children are 2 node and 2 node + 1; the root is 1."""
    feature: np.ndarray
    threshold: np.ndarray
    depth: np.ndarray
    height: int
    norm: float
    offset: float = 0.0


_NODES = "tree int, node int, feature int, threshold double, depth double"


def _grow(seed: int, height: int):
    """Splits the rows of one tree. A node's feature, among those that vary, and the place of its cut are hashes of it."""
    def run(pdf):
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        nodes, todo, key = [], [(1, x, 0)], tree_key(seed, tree)
        while todo:
            node, rows, level = todo.pop()
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
            spread = np.flatnonzero(high > low)
            if level >= height or len(rows) <= 1 or len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, level + float(average_path(len(rows)))))
                continue
            f = int(spread[mixed(key, 2 * node) % len(spread)])
            cut = float(low[f] + mixed(key, 2 * node + 1) / PRIME * (high[f] - low[f]))
            nodes.append((tree, node, f, cut, 0.0))
            left = rows[:, f] <= cut
            todo += [(2 * node, rows[left], level + 1), (2 * node + 1, rows[~left], level + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "depth"])
    return run


def fit(rows: DataFrame, trees: int = C.FOREST_TREES, contamination: float = C.FOREST_CONTAMINATION, seed: int = 42,
        subsample: int = C.FOREST_SUBSAMPLE) -> Forest:
    """Fit on training rows (id, x). Sub-samples are drawn by hash, so they do not depend on the partitioning.

    A row offers itself to the trees whose hash of it lies below a threshold, about four times as many rows as a tree
    takes; each tree takes the first by hash, counted before the shuffle. The score offset is the contamination quantile
    over all rows: scores have six digits, so it comes from a count of at most a million of them.
    """
    rows = rows.select("id", "x")
    n = rows.count()
    size = min(subsample, n)
    height = max(1, int(np.ceil(np.log2(max(size, 2)))))
    offer = int(min(1.0, 4 * size / max(n, 1)) * PRIME)
    base = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 7), 16, 10).cast("long")
    offered = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")), lambda t: F.struct(
        t.alias("tree"), mixed(F.col("_base"), tree_key(seed, t)).alias("turn"))), lambda o: o["turn"] <= offer)
    drawn = rows.withColumn("_base", base).select("id", "x", F.explode(offered).alias("o")).select("id", "x", "o.*")
    w = Window.partitionBy("tree").orderBy("turn", "id")
    drawn = drawn.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")
    nodes = drawn.groupBy("tree").applyInPandas(_grow(seed, height), _NODES).toPandas()  # trees x 511 rows at most
    shape = (trees, 2 ** (height + 1))
    parts = {}
    for name, empty in (("feature", -1), ("threshold", 0.0), ("depth", 0.0)):
        parts[name] = np.full(shape, empty)
        parts[name][nodes["tree"], nodes["node"]] = nodes[name]
    forest = Forest(**parts, height=height, norm=float(average_path(size)))
    return replace(forest, offset=quantile(raw_score(rows, forest).select((-F.col("score")).alias("score")), contamination, n))


def quantile(scores: DataFrame, share: float, n: int) -> float:
    """The least score that a share of the n rows does not exceed."""
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("score")))
    return float(upto.filter(F.col("upto") >= share * n).agg(F.min("score")).first()[0])


def _paths(x: np.ndarray, f: Forest) -> np.ndarray:
    total = np.zeros(len(x))
    row = np.arange(len(x))
    for feature, threshold, depth in zip(f.feature, f.threshold, f.depth):
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(f.height):
            at = feature[node]
            step = 2 * node + (x[row, np.maximum(at, 0)] > threshold[node])
            node = np.where(at >= 0, step, node)
        total += depth[node]
    return total / len(f.feature)


def raw_score(rows: DataFrame, forest: Forest) -> DataFrame:
    """Add ``score`` in (0, 1), to six digits; the forest goes to the tasks as one bounded broadcast."""
    shared = sent(rows.sparkSession, forest)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        f = shared()
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(2.0 ** (-_paths(np.stack(x.to_numpy()).astype(float), f) / f.norm))

    return rows.withColumn("score", round_half_up(score("x"), 6))


def decision(rows: DataFrame, forest: Forest) -> DataFrame:
    """Add ``decision`` (negative is anomalous) and ``is_anomaly``."""
    out = raw_score(rows, forest).withColumn("decision", -F.col("score") - forest.offset)
    return out.drop("score").withColumn("is_anomaly", F.col("decision") < 0)


def telemetry_anomaly(decided: DataFrame) -> DataFrame:
    """Add ``anomaly`` and ``label`` for the telemetry model."""
    return decided.withColumns({"anomaly": scoring.sigmoid(F.col("decision") * -5.0),
                                "label": F.when(F.col("is_anomaly"), "ANOMALY").otherwise("NORMAL")})


def feature_anomaly(decided: DataFrame) -> DataFrame:
    """Add ``anomaly`` for the labelled feature model."""
    return decided.withColumn("anomaly", scoring.sigmoid(F.col("decision") * -10.0 + 1.2))


def fit_telemetry(rows: DataFrame, **options) -> Forest | None:
    """Telemetry model from all rows (id, x); None, for the cold-start scores, below 100 rows."""
    return fit(rows, **options) if rows.limit(C.FOREST_MIN_ROWS).count() == C.FOREST_MIN_ROWS else None


def fit_labelled(normals: DataFrame, attacks: DataFrame, seed: int = 42) -> Forest | None:
    """Feature model from the newest trusted normals and confirmed attacks (id, t_us, x); None below 100 normals."""
    good = newest(normals.withColumn("event_id", F.col("id")), C.LABELLED_NORMALS).select("id", "x")
    bad = newest(attacks.withColumn("event_id", F.col("id")), C.LABELLED_ATTACKS).select("id", "x")
    n_good, n_bad = good.count(), bad.count()
    if n_good < C.FOREST_MIN_ROWS:
        return None
    share = max(0.01, min(0.3, n_bad / (n_good + n_bad + 1e-9)))
    return fit(good.unionByName(bad), C.LABELLED_TREES, share, seed)


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(x).cast("double") for x in columns])
