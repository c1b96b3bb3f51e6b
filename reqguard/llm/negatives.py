"""Operator 12: hard negatives by exact integer products, several candidates to a multiplication."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqguard.llm.stage import stage

#: Integers up to 2^53 are exact in a double, so one matrix product of doubles serves all fields packed into it; wider
#: sums go to Python's unbounded integers, with so many fields each.
BITS, WIDE_FIELDS = 53, 16
#: Rows of a block, and scores of a tile held at once in a task.
LEAST_ROWS, MOST_ROWS, ANCHOR_ROWS, TILE = 2048, 32_768, 4096, 1 << 21
SCALE = 256
LARGEST = 2**63 - 1
NONE = -(2**63)


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of each component, a row per vector; shorter vectors end in zeros. Integers of 64 bits where they
    hold all of them, otherwise unbounded ones."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(vectors.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    x = np.zeros((len(sizes), dims))
    x[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    if np.abs(x).max(initial=0) < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    # a component that large is an integer itself, so it is scaled as one
    exact = [[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)


@dataclass
class Packed:
    """Candidates whose components, biased to be at least 0, lie side by side in fields of one integer per component."""
    count: int
    dims: int
    width: int
    fields: int
    wide: bool
    low: int
    low_anchor: int
    sums: np.ndarray
    packed: np.ndarray

    @staticmethod
    def of(candidates: np.ndarray, anchors: np.ndarray) -> "Packed":
        """A field has room for the largest sum of products of these anchors and candidates."""
        n, dims = candidates.shape
        low, low_anchor = (min(0, int(x.min())) for x in (candidates, anchors))
        width = max(1, (dims * (int(candidates.max()) - low) * (int(anchors.max()) - low_anchor)).bit_length())
        wide = width > BITS
        kind, fields = (object, WIDE_FIELDS) if wide else (np.float64, BITS // width)
        biased = candidates.astype(object) - low if wide else candidates - low
        each = -(-n // fields)
        packed = np.zeros((dims, each), dtype=kind)
        for f in range(fields):
            part = biased[f * each:(f + 1) * each]
            packed[:, :len(part)] += part.T.astype(kind) * 2 ** (width * f)
        return Packed(n, dims, width, fields, wide, low, low_anchor, biased.sum(axis=1), packed)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, a row per anchor and a column per candidate: each anchor component is multiplied once with all
        fields of an integer, the fields are read, and what the biases added is taken off. What 64 bits cannot hold is
        the nearest that they can."""
        a = anchors.astype(object) - self.low_anchor if self.wide else anchors - self.low_anchor
        product = a @ self.packed if self.wide else (a.astype(np.float64) @ self.packed).astype(np.int64)
        mask = (1 << self.width) - 1
        fields = np.concatenate([(product >> (self.width * f)) & mask for f in range(self.fields)], axis=1)[:, :self.count]
        exact = fields + self.low * a.sum(axis=1)[:, None] + self.low_anchor * self.sums[None, :] + self.dims * self.low * self.low_anchor
        return (np.clip(exact, -LARGEST, LARGEST) if self.wide else exact).astype(np.int64)


def tiles(anchors: np.ndarray, candidates: np.ndarray):
    """(first anchor, scores of it and those after it with all candidates), in tiles of bounded size."""
    if not len(anchors) or not len(candidates):
        return
    if not candidates.shape[1] or not anchors.shape[1]:
        yield 0, np.zeros((len(anchors), len(candidates)), dtype=np.int64)
        return
    dims = max(anchors.shape[1], candidates.shape[1])
    anchors, candidates = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (anchors, candidates))
    packed, step = Packed.of(candidates, anchors), max(1, TILE // len(candidates))
    for i in range(0, len(anchors), step):
        yield i, packed.scores(anchors[i:i + step])


def best(scores: np.ndarray, n: int):
    """The columns of the n highest scores of each row, in turn (the first of equal ones): (rows, columns, scores)."""
    at = np.arange(len(scores))
    for _ in range(min(n, scores.shape[1])):
        column = scores.argmax(axis=1)
        value = scores[at, column]
        some = value != NONE
        if not some.any():
            return
        yield at[some], column[some], value[some]
        scores[at, column] = NONE


def in_order(rows: pa.Table) -> pa.Table:
    """Rows by id (null ids last), so that the first of equal scores has the smaller id."""
    return rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])


def codes(*columns) -> list[np.ndarray]:
    """Labels as numbers, alike in all columns."""
    known: dict = {}
    return [np.array([known.setdefault(x, len(known)) for x in c.to_pylist()], dtype=np.int64) for c in columns]


def alike(rows: pa.Table, anchors: pa.Table, n: int) -> pa.Table:
    """Of one block of rows: for each anchor, the n of the same label with the highest scores."""
    rows = in_order(rows)
    label, anchor_label = codes(rows["label"], anchors["label"])
    v, w = integers(rows["embedding"]), integers(anchors["embedding"])
    uid, anchor_uid = rows["uid"].to_numpy(), anchors["uid"].to_numpy()
    found = [(np.empty(0, np.int64),) * 3]
    for one in np.unique(anchor_label):
        mine, theirs = np.flatnonzero(anchor_label == one), np.flatnonzero(label == one)
        for i, scores in tiles(w[mine], v[theirs]):
            here = mine[i:i + len(scores)]
            scores[anchor_uid[here][:, None] == uid[theirs][None, :]] = NONE
            found += [(here[a], theirs[c], s) for a, c, s in best(scores, n)]
    a, c, s = map(np.concatenate, zip(*found))
    return pa.table({"uid": anchor_uid[a], "positive_id": rows["vec_id"].take(c), "row": uid[c], "positive_score": s})


def unlike(rows: pa.Table, anchors: pa.Table, n: int, least: int, most: int) -> pa.Table:
    """Of one block of rows: for each anchor and positive, the n of another label with the highest scores that are from
    least to most hundredths of the positive's."""
    rows = in_order(rows)
    label, anchor_label = codes(rows["label"], anchors["label"])
    positives = anchors["positives"].to_pylist()
    found = [(np.empty(0, np.int64),) * 4]
    for i, scores in tiles(integers(anchors["embedding"]), integers(rows["embedding"])):
        scores[anchor_label[i:i + len(scores), None] == label[None, :]] = NONE
        for p in range(max(map(len, positives[i:i + len(scores)]))):
            have = np.array([a for a in range(len(scores)) if p < len(positives[i + a])])
            given = [positives[i + a][p]["positive_score"] for a in have]
            low = np.array([max(-LARGEST, -(-least * x // 100)) for x in given])
            high = np.array([min(LARGEST, most * x // 100) for x in given])
            mine = scores[have]
            mine[(mine < low[:, None]) | (mine > high[:, None])] = NONE
            found += [(i + have[a], c, s, np.full(len(a), p)) for a, c, s in best(mine, n)]
    a, c, s, p = map(np.concatenate, zip(*found))
    return pa.table({
        "uid": anchors["uid"].to_numpy()[a], "place": p, "anchor_id": anchors["vec_id"].take(a),
        "positive_id": pa.array([positives[x][y]["positive_id"] for x, y in zip(a.tolist(), p.tolist())], pa.int64()),
        "positive_score": pa.array([positives[x][y]["positive_score"] for x, y in zip(a.tolist(), p.tolist())], pa.int64()),
        "negative_id": rows["vec_id"].take(c), "row": rows["uid"].to_numpy()[c], "negative_score": s})


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part, each with a number of its own (uid)."""
    v = F.col("embedding").cast("array<double>")
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("embedding"))
    return rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~wrong) \
               .withColumn("uid", F.monotonically_increasing_id())


def in_blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, work, schema: str) -> DataFrame:
    """work(rows, anchors) on each block of rows and block of anchors: a grid of tasks of bounded size."""
    per_block = max(LEAST_ROWS, min(MOST_ROWS, n_rows // 64))
    blocks, groups = max(1, -(-n_rows // per_block)), max(1, -(-n_anchors // ANCHOR_ROWS))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_b", dealt(blocks)).withColumn("_g", every(groups))
    right = anchors.withColumn("_g", dealt(groups)).withColumn("_b", every(blocks))
    left, right = (x.repartition(blocks * groups, "_b", "_g").groupBy("_b", "_g") for x in (left, right))
    return left.cogroup(right).applyInArrow(work, schema)


def first(rows: DataFrame, by: list[str], score: str, id_: str, n: int, name: str) -> DataFrame:
    """The n rows of highest score in each group, ties by id, with their place from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(id_), "row")
    return rows.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)


def hard_negatives(rows: DataFrame, anchor, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Rows (vec_id, label, embedding, others) and a condition on vec_id that says which are anchors -> anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Each component counts as floor(256 x); a row's score is its integer inner product with the anchor. An anchor's
    positives are the other rows of its label with the highest scores; for each, the negatives are the rows of other
    labels with the highest scores among those from least to most hundredths of the positive's. Ties go by vec_id.

    Two passes over a grid of blocks of rows and of anchors: the first finds the positives among rows of the anchor's
    label, the second the negatives within the limits that these set. A block gives a few rows for each anchor, and
    windows keep the first of all blocks; so neither a frequent label nor a frequent vector piles up anywhere.

    Rows with a null label, a null vector or a null or non-finite component take no part. Null ids are never anchors and
    come last among equal scores. Rows that repeat an id or a whole row are rows of their own: as anchors, each gives its
    own result, and each can be a positive or negative. Components that a shorter vector lacks count as 0; the score with
    an empty vector is 0. A score beyond 64 bits counts as the nearest that fits. Other columns are not read. Without
    rows, anchors, positives or negatives in the limits there is no result row.
    """
    rows = stage(usable(rows), "negatives-rows")
    anchors = rows.filter(F.coalesce(anchor, F.lit(False)))
    n_rows, n_anchors = rows.count(), anchors.count()

    found = in_blocks(rows, anchors, n_rows, n_anchors, lambda r, a: alike(r, a, positives),
                      "uid long, positive_id long, row long, positive_score long")
    chosen = first(found, ["uid"], "positive_score", "positive_id", positives, "place") \
        .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    with_positives = stage(anchors.join(chosen, "uid"), "negatives-anchors")
    found = in_blocks(rows, with_positives, n_rows, n_anchors, lambda r, a: unlike(r, a, negatives, least, most),
                      "uid long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, row long, negative_score long")
    return first(found, ["uid", "place"], "negative_score", "negative_id", negatives, "rank").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
