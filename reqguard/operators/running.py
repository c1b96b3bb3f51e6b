"""Running aggregates and row frames per key that do not put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts all rows of a key in a single task, which fails when one key holds
a large share of the data. Both helpers below cut a key's ordered rows into pieces and group on (key, piece):

* ``running`` cuts by time segment. Per-segment totals are aggregated first (partial aggregation before the shuffle),
  the small totals are accumulated over the segments of a key, and each segment starts from its carry.
* ``rank_blocks`` cuts by row number and repeats the last ``halo`` rows of a block in the next one, so that ``lag`` and
  ``rowsBetween`` see what they would see over the whole key.

Sorts put a hash of the key first: as a number it decides most comparisons, where keys that begin alike, or structs, are
compared in full each time.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqguard.session import stage


def _combined(how: str, name: str) -> str:
    if how == "sum":
        return f"coalesce(_c_{name}, 0) + coalesce(_r_{name}, 0) AS {name}"
    return f"{'greatest' if how == 'max' else 'least'}(_c_{name}, _r_{name}) AS {name}"


def with_pieces(df: DataFrame, piece_rows: int, order) -> DataFrame:
    """Adds _piece to rows with _key and _seg: 0, or consecutive ranges of the order where a segment has more than
    piece_rows rows of a key. Only the rows of such segments are dealt by sampled splitters."""
    crowded = stage(df.groupBy("_key", "_seg").agg(F.count("*").alias("n")).filter(F.col("n") > piece_rows), "crowded")
    n = crowded.agg(F.sum("n")).first()[0]
    if n is None:
        return df.withColumn("_piece", F.lit(0))
    groups = crowded.select("_key", "_seg")
    dealt = df.join(groups, ["_key", "_seg"], "left_semi").repartitionByRange(2 * -(-n // piece_rows) + 1, "_key", "_seg", *order)
    dealt = stage(dealt.withColumn("_piece", F.spark_partition_id() + 1), "pieces")
    return df.join(groups, ["_key", "_seg"], "left_anti").withColumn("_piece", F.lit(0)).unionByName(dealt)


def running(df: DataFrame, keys: list[str], aggs: dict, segment_us: int, order=("t_us", "event_id"), written: bool = False,
            piece_rows: int | None = None) -> DataFrame:
    """Add running aggregates per key.

    ``aggs`` maps a new column to ``(sum|min|max, Column)`` or, when a row must not see itself, to
    ``(sum|min|max, Column, "before")``. Totals have at most (time span / segment) rows per key, however many events the
    key has. A null is a key like any other. Structs compare field by field, so ``max(struct(t, id, x))`` gives the
    latest x.

    The totals and the sums within a segment each read the input, the former only a few of its columns. With ``written``,
    the rows are written to the shared folder first, so that a costly input is evaluated once. With ``piece_rows``, a
    segment in which a key has more rows than that, even all at one moment, is cut into pieces of its order, whose totals
    are accumulated like those of segments; this counts the rows of all segments first.
    """
    cols, names = df.columns, list(aggs)
    how = {n: a[0] for n, a in aggs.items()}
    # keys are compared as a struct, in which a null equals a null
    df = df.withColumns({"_key": F.struct(*keys), "_seg": F.expr(f"{order[0]} div {int(segment_us)}"),
                         **{f"_v_{n}": a[1] for n, a in aggs.items()}})
    if written:
        df = stage(df, "running")
    df = df.withColumn("_hash", F.xxhash64("_key", "_seg"))
    part = ["_hash", "_key", "_seg"]
    if piece_rows is not None:
        part, df = [*part, "_piece"], with_pieces(df, piece_rows, order)
    totals = df.groupBy(*part).agg(*[F.expr(f"{how[n]}(_v_{n}) AS _c_{n}") for n in names])
    earlier = f"(PARTITION BY _key ORDER BY {', '.join(part[2:])} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = totals.selectExpr(*part, *[f"{how[n]}(_c_{n}) OVER {earlier} AS _c_{n}" for n in names])

    def inside(n):
        last = "1 PRECEDING" if len(aggs[n]) == 3 else "CURRENT ROW"
        return f"(PARTITION BY {', '.join(part)} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND {last})"

    rows = df.selectExpr(*cols, *part, *[f"{how[n]}(_v_{n}) OVER {inside(n)} AS _r_{n}" for n in names])
    out = rows.join(carry, part)
    return out.selectExpr(*[x for x in cols if x not in names], *[_combined(how[n], n) for n in names])


def rank_blocks(df: DataFrame, rn: str, block_rows: int, halo: int) -> DataFrame:
    """Add ``_blk`` and ``_ghost``: rows numbered ``rn`` (1, 2, ...) per key in blocks, each led by ``halo`` repeats.

    Use with ``block_window`` and filter ``_ghost`` out afterwards.
    """
    size = max(block_rows, halo)
    own = F.expr(f"({rn} - 1) div {size}")
    repeats = F.col(rn) > (own + 1) * size - halo
    return (df.withColumn("_blk", F.explode(F.when(repeats, F.array(own, own + 1)).otherwise(F.array(own))))
              .withColumn("_ghost", F.col("_blk") != own))


def block_window(keys: list[str], rn: str):
    return Window.partitionBy(F.xxhash64(*keys, "_blk"), *keys, "_blk").orderBy(rn)
