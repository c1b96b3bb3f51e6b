"""Comparing the rows of a group with each other without one task per group.

A group is cut into tiles of a bounded number of rows by hash, and every pair of tiles is one task. A task compares its
two tiles as matrices and returns per-row results only, so neither a large group nor many similar rows pile up anywhere.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 2048


def tile_pairs(df: DataFrame, group: list[str], id_col: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Send each row to the tile pairs (``_i`` <= ``_j``) of its group; ``_left``/``_right`` tell its sides.

    Group on (group, ``_i``, ``_j``) afterwards. A pair of rows meets in exactly one tile pair.
    """
    c = F.col
    n_tiles = df.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(float(tile_rows))).cast("int").alias("_tiles"))
    tiled = df.join(n_tiles, group).withColumn("_tile", F.pmod(F.xxhash64(id_col), c("_tiles")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), c("_tiles") - 1), lambda t: F.struct(
        F.least(t, c("_tile")).alias("_i"), F.greatest(t, c("_tile")).alias("_j"),
        (c("_tile") <= t).alias("_left"), (c("_tile") >= t).alias("_right")))
    return tiled.select("*", F.explode(others).alias("_p")).select("*", "_p.*").drop("_p", "_tiles", "_tile")


def sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """(left rows, right rows, whether both are the same tile) of one tile pair."""
    left, right = pdf[pdf["_left"]], pdf[pdf["_right"]]
    same = bool(pdf["_i"].iloc[0] == pdf["_j"].iloc[0])
    return left, right, same


def spanning_edges(ids_a: np.ndarray, ids_b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` (a x b) connects: fewer than there are rows, each as (smaller, larger)."""
    n = len(ids_a)
    ids = np.concatenate([ids_a, ids_b])
    todo_a, todo_b = np.ones(n, bool), np.ones(len(ids_b), bool)
    edges = []
    for start in range(n):
        if not todo_a[start] or not linked[start].any():
            continue
        todo_a[start] = False
        members, front_a = [start], np.array([start])
        while len(front_a):
            front_b = np.flatnonzero(linked[front_a].any(axis=0) & todo_b)
            todo_b[front_b] = False
            members.extend(n + front_b)
            front_a = np.flatnonzero(linked[:, front_b].any(axis=1) & todo_a) if len(front_b) else front_b
            todo_a[front_a] = False
            members.extend(front_a)
        group = np.unique(ids[members])
        edges.extend((int(group[0]), int(x)) for x in group[1:])
    return edges

