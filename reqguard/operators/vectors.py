"""Behaviour vectors, the memory of known attacks, and correlation between actors."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard import constants as C
from reqguard.config import SECOND, Config
from reqguard.functions import scoring, text
from reqguard.operators.graph import components
from reqguard.operators.memory import newest
from reqguard.operators.running import running
from reqguard.operators.tiles import TILE_ROWS, tile_pairs
from reqguard.session import sent, stage


# ------------------------------------------------------------------ vectors
def _capped(name: str, cap: float) -> Column:
    return F.least(F.col(name).cast("double"), F.lit(float(cap)))


def _flag(name: str) -> Column:
    return F.when(F.col(name), 1.0).otherwise(0.0)


# feature, cap: the shared dimensions of the anomaly features and the embedding, in order
DIMENSIONS = [
    ("requests_in_window", 200), ("burst_detected", None), ("failure_rate", 1), ("consecutive_failures", 20),
    ("unique_endpoints", 50), ("sensitive_hits", 10), ("scan_pattern", None), ("current_flags", 5),
    ("unique_user_agents", 10), ("acceleration", 20), ("enumeration_detected", None), ("unique_sessions", 10),
]


def anomaly_features(features: DataFrame) -> DataFrame:
    """Add ``x``: the 12 capped anomaly features. The share of new endpoints is 0, as no window lies outside its own
    baseline."""
    parts = [F.lit(0.0) if n == "enumeration_detected" else _flag(n) if cap is None else _capped(n, cap)
             for n, cap in DIMENSIONS]
    return features.withColumn("x", F.array(*parts))


def cold_anomaly(vectors: DataFrame) -> DataFrame:
    """Anomaly of the 12 features before a forest is trained."""
    x = F.col("x")
    return vectors.withColumn("anomaly", scoring.cold_feature_anomaly(
        {"rate": x[0], "burst": x[1], "failure_rate": x[2], "scan": x[6], "flags": x[7]}))


def _with(value: Column, fn) -> Column:
    """fn(value) with the value computed once per row, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def lexical(payload: Column) -> Column:
    """52 bigram buckets of the whole lower-cased payload, scaled to a maximum of 1."""
    low = F.lower(payload)

    def buckets(text_):
        return F.transform(text.ngrams(text_, 2), lambda g: F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("int")
                           % C.LEXICAL_DIM)

    def counts(found):
        return F.transform(F.sequence(F.lit(0), F.lit(C.LEXICAL_DIM - 1)),
                           lambda b: (F.size(found) - F.size(F.array_remove(found, b))).cast("double"))

    def scaled(n):
        return _with(F.greatest(F.array_max(n), F.lit(1.0)), lambda top: F.transform(n, lambda x: x / top))

    return _with(low, lambda t: _with(buckets(t), lambda found: _with(counts(found), scaled)))


def unit(vec: Column) -> Column:
    """The vector divided by its length."""
    def divided(v):
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
        return _with(length, lambda n: F.transform(v, lambda x: x / n))
    return _with(vec, divided)


def behavior_embedding(features: DataFrame) -> DataFrame:
    """Add ``vec``: 12 scaled features and 52 lexical buckets of ``payload``, as a unit vector."""
    structured = [_flag(n) if cap is None else _capped(n, cap) / float(cap) for n, cap in DIMENSIONS]
    empty = F.array_repeat(F.lit(0.0), C.LEXICAL_DIM)
    lex = F.when(F.col("payload") == "", empty).otherwise(lexical(F.col("payload")))
    return features.withColumn("vec", unit(F.concat(F.array(*structured), lex)))


# ------------------------------------------------------------------ memory of known attacks
def memorize(memory: DataFrame, new: DataFrame, cap: int | None = None) -> DataFrame:
    """Memory with new entries (entry_id, vec, stored_us) as unit vectors; with a cap, the oldest leave when it is full."""
    both = memory.unionByName(new.withColumn("vec", unit(F.col("vec").cast("array<double>"))))
    return both if cap is None else newest(both, cap, ("stored_us", "entry_id"))


MEMORY_TILE = 4096
#: Rows lie in at most about so many bins, and a row goes to each bin that it is to meet once: so what is sent grows with
#: the rows, and not with their square, up to bins of BIN_ROWS rows, which a task can hold.
BINS, BIN_ROWS = 24, 65_536
#: So many blocks of a timeline; a row that stands for long goes to many, so the rest is kept in few tiles.
BLOCKS = 96
#: Least rows of a tile or block of a timeline. A query looks at few of a tile's vectors, so larger tiles cost it little.
TIMELINE_TILE = 16_384


def bin_rows(n: int, least: int, bins: int = BINS) -> int:
    """Rows of a bin, out of n."""
    return max(least, min(BIN_ROWS, -(-n // bins)))


def _nearest(queries: pa.Table, entries: pa.Table) -> pa.Table:
    """The most similar entry of one memory tile for each query of one block; the smaller id at ties."""
    ids, order = entries.column("entry_id").to_numpy(), np.argsort(entries.column("entry_id").to_numpy())
    best, sims = np.empty(0, np.int64), np.empty(0)
    if len(ids) and queries.num_rows:
        m = np.stack(entries.column("vec").to_numpy())[order]
        q = np.stack(queries.column("vec").to_numpy())
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)
        for at in range(0, len(q), 2048):
            s = q[at:at + 2048] @ m.T
            best, sims = np.append(best, ids[order][s.argmax(axis=1)]), np.append(sims, s.max(axis=1))
        return pa.table({"id": queries.column("id"), "entry_id": pa.array(best), "similarity": pa.array(sims)})
    return pa.table({"id": pa.array([], pa.int64()), "entry_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})


def top1(queries: DataFrame, memory: DataFrame, id_col: str = "event_id", tile: int = MEMORY_TILE) -> DataFrame:
    """(id, entry_id, similarity): the most similar memory entry per vector; similarity 0 for an empty memory.

    The memory is cut into tiles of about ``tile`` entries and the queries into as large blocks; each block meets each
    tile in a task of its own as a matrix product, and a query's best is the best of its tiles. Nothing is collected.
    """
    c = F.col

    def cut(df, name):
        return df.withColumn(name, F.pmod(F.xxhash64("id" if name == "_block" else "entry_id"), c("_n")).cast("int"))

    def pieces(df):
        return df.agg(F.greatest(F.ceil(F.count("*") / F.lit(float(tile))), F.lit(1)).cast("int").alias("n")).first()["n"]

    asked = queries.select(c(id_col).alias("id"), c("vec").cast("array<double>").alias("vec"))
    n_blocks, n_tiles = pieces(asked), pieces(memory)
    q = cut(asked.withColumn("_n", F.lit(n_blocks)), "_block").withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    m = cut(memory.select("entry_id", "vec").withColumn("_n", F.lit(n_tiles)), "_tile").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    near = q.groupBy("_block", "_tile").cogroup(m.groupBy("_block", "_tile")).applyInArrow(
        _nearest, "id long, entry_id long, similarity double")
    best = near.groupBy("id").agg(F.max(F.struct("similarity", (-c("entry_id")).alias("back"))).alias("b"))
    return asked.select("id").join(best, "id", "left").select(
        c("id").alias(id_col), (-c("b.back")).alias("entry_id"), F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))


def _nearest_before(queries: pa.Table, entries: pa.Table) -> pa.Table:
    """For each query of one block, the most similar entry of one tile that was stored before it; the first at ties."""
    entries = entries.sort_by("number")
    ids, number, before = (x.to_numpy() for x in (entries["entry_id"], entries["number"], queries["before"]))
    if not len(ids) or not len(before):
        return pa.table({"id": pa.array([], pa.int64()), "entry_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
    top, best = most_similar(matrix(queries["vec"]), matrix(entries["vec"]), before, number - 1, np.full(len(ids), 2 ** 63 - 1))
    some = np.isfinite(top)
    return pa.table({"id": queries["id"].to_numpy()[some], "entry_id": ids[best[some]], "similarity": top[some]})


def matrix(vectors) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


#: Similarities held at once in a task.
SCORES = 1 << 20
#: Vectors of a task are dealt into cells of about CELL_ROWS, of which there are at most CELLS.
CELL_ROWS, CELLS = 64, 512
#: Rounding of angles, which must not rule anything out.
SLACK = 1e-6


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most similar pivot of each row, and its similarity."""
    cell, top, rows = np.empty(len(x), np.int64), np.empty(len(x)), max(1, SCORES // len(pivots))
    for at in range(0, len(x), rows):
        s = x[at:at + rows] @ pivots.T
        cell[at:at + rows] = here = s.argmax(axis=1)
        top[at:at + rows] = s[np.arange(len(s)), here]
    return cell, top


def similarities(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return q @ v.T


def most_similar(q: np.ndarray, v: np.ndarray, place: np.ndarray, start: np.ndarray, until: np.ndarray,
                 mine: np.ndarray | None = None, theirs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q, the highest similarity to the rows of v that stand at its place (start < place <= until) and are
    not its own (mine, theirs), and the first row that has it; -inf and -1 without any. Rows are unit vectors, or zeros.

    Exact. The rows of v lie in cells around pivots. A query first meets the two cells of the most similar pivots; then
    those cells that can hold something as similar as what it has found: by the triangle inequality, no angle in a cell is
    less than the angle to its pivot without the largest angle in the cell. Cells of which nothing stands at the place
    are left out, too.
    """
    pivots = v[np.linspace(0, len(v) - 1, max(1, min(CELLS, len(v) // CELL_ROWS))).astype(np.int64)]
    cell, top = nearest_pivots(v, pivots)
    used, cell = np.unique(cell, return_inverse=True)  # equal pivots leave cells empty
    pivots, order = pivots[used], np.argsort(cell, kind="stable")
    v, start, until, theirs = v[order], start[order], until[order], None if theirs is None else theirs[order]
    first = np.searchsorted(cell[order], np.arange(len(used) + 1))
    radius = np.maximum.reduceat(np.arccos(np.clip(top[order], -1, 1)), first[:-1])
    since, till = np.minimum.reduceat(start, first[:-1]), np.maximum.reduceat(until, first[:-1])
    turn = np.stack([np.cos(radius), np.sin(radius)])
    best, found = np.full(len(q), -np.inf), np.full(len(q), -1)

    def meet(rows: np.ndarray, c: int) -> None:
        """The queries of these rows meet a cell."""
        a, b = first[c], first[c + 1]
        for at in range(0, len(rows), max(1, SCORES // (b - a))):
            x = rows[at:at + max(1, SCORES // (b - a))]
            s, here = similarities(q[x], v[a:b]), place[x, None]
            out = (start[None, a:b] >= here) | (here > until[None, a:b])
            if mine is not None:
                out |= mine[x, None] == theirs[None, a:b]
            s[out] = -np.inf
            k = s.argmax(axis=1)
            highest, row = s[np.arange(len(x)), k], order[a + k]
            new = ~(highest <= best[x]) | ((highest == best[x]) & (row < found[x]))
            best[x[new]], found[x[new]] = highest[new], row[new]

    def meet_all(rows: np.ndarray, cells: np.ndarray) -> None:
        """Each query meets its cell; the cells are sorted."""
        ends = np.flatnonzero(np.diff(cells)) + 1
        for x, c in zip(np.split(rows, ends), cells[np.concatenate([[0], ends])] if len(rows) else []):
            meet(x, c)

    def left(x: np.ndarray, s: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Which cells are to be met still, by the queries' similarities to the pivots."""
        angle = np.arccos(np.clip(best[x], -1, 1)) + SLACK
        few = s < np.stack([np.cos(angle), -np.sin(angle)], axis=1) @ turn  # the cosine of the angle and the radius
        if not angle.max() + radius.max() <= np.pi:
            few &= angle[:, None] + radius <= np.pi
        return todo & ~few

    nearest = nearest_pivots(q, pivots)[0]
    by_cell = np.lexsort((place, nearest))
    meet_all(by_cell, nearest[by_cell])
    rows = max(1, SCORES // len(pivots))
    for at in range(0, len(q) if len(pivots) > 1 else 0, rows):
        x = by_cell[at:at + rows]
        s, here, each = q[x] @ pivots.T, place[x, None], np.arange(len(x))
        todo = (since < here) & (here <= till)
        todo[each, nearest[x]] = False
        todo = left(x, s, todo)
        second = np.where(todo, s, -np.inf).argmax(axis=1)
        some = np.flatnonzero(todo[each, second])
        some = some[np.argsort(second[some], kind="stable")]
        meet_all(x[some], second[some])
        todo[some, second[some]] = False
        cells, which = np.nonzero(left(x, s, todo).T)
        meet_all(x[which], cells)
    return best, found


def with_rows(df: DataFrame, label: str) -> DataFrame:
    """The rows, written, with a number of their own (_row): timelines are made without the vectors, which join by it."""
    return stage(df.withColumn("_row", F.monotonically_increasing_id()), label)


def top1_before(queries: DataFrame, memory: DataFrame, cfg: Config, id_col: str = "event_id", tile: int = TIMELINE_TILE) -> DataFrame:
    """(id, entry_id, similarity): the most similar memory entry stored before each query (id, t_us, vec); similarity 0
    where none was. At equal times, entries of smaller ids than the query's are before it, so none meets itself; at equal
    similarity the entry stored first counts.

    Of entries with equal vectors only the first is ever needed. Entries and queries are numbered on one timeline and cut
    into tiles and blocks of consecutive ones, of at least ``tile`` rows and a bounded number of each (`bin_rows`). A query
    goes to the tiles that begin before it: wholly earlier ones, and one that is open, where later entries are masked. A block and a tile meet in one task (`most_similar`).
    """
    c, zero, one = F.col, F.lit(0).cast("long"), F.lit(1).cast("long")
    firsts = memory.withColumn("_hash", F.xxhash64("vec")).groupBy("_hash", "vec").agg(F.min(F.struct("stored_us", "entry_id")).alias("f")).select("f.*", "vec")
    asked = queries.select(c(id_col).alias("id"), "t_us", unit(c("vec").cast("array<double>")).alias("vec"))
    rows = with_rows(firsts.select(c("stored_us").alias("t_us"), c("entry_id").alias("id"), F.lit(1).alias("turn"), one.alias("entry"), zero.alias("query"), "vec")
                     .unionByName(asked.select("t_us", "id", F.lit(0).alias("turn"), zero.alias("entry"), one.alias("query"), "vec")), "memory-rows")
    timeline = rows.drop("vec").withColumn("all", F.lit(0))
    placed = stage(running(timeline, ["all"], {"before": ("sum", c("entry")), "at": ("sum", c("query"))}, cfg.segment_us, ("t_us", "id", "turn"),
                           piece_rows=max(cfg.block_rows, BIN_ROWS)), "memory-timeline")
    n_queries, n_entries = placed.agg(F.coalesce(F.max("at"), zero), F.coalesce(F.max("before"), zero)).first()
    vecs = lambda turn: rows.filter(c("turn") == turn).select("_row", "vec")
    blocks = placed.filter("turn = 0 AND before > 0").select("id", "_row", "before", F.expr(f"cast((at - 1) div {bin_rows(n_queries, tile, BLOCKS)} as int)").alias("_block"))
    last = F.expr(f"cast((before - 1) div {bin_rows(n_entries, tile)} as int)")
    grid = blocks.groupBy("_block").agg(F.max(last).alias("_last")).select("_block", F.explode(F.sequence(F.lit(0), "_last")).alias("_tile"))
    m = placed.filter("turn = 1").select(c("id").alias("entry_id"), "_row", c("before").alias("number"), last.alias("_tile")).join(vecs(1), "_row").join(grid, "_tile")
    m = m.select("entry_id", "number", *[c(x).alias(x) for x in ("vec", "_block", "_tile")])  # names of their own, for the join below
    q = blocks.join(vecs(0), "_row").select("id", "vec", "before", "_block", F.explode(F.sequence(F.lit(0), last)).alias("_tile"))
    near = q.groupBy("_block", "_tile").cogroup(m.groupBy("_block", "_tile")).applyInArrow(
        _nearest_before, "id long, entry_id long, similarity double")
    best = near.groupBy("id").agg(F.max_by(F.struct("entry_id", "similarity"), "similarity").alias("b"))
    return asked.select("id").join(best, "id", "left").select(
        c("id").alias(id_col), "b.entry_id", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))


def remove(memory: DataFrame, cleared: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Memory without the nearest entry of each cleared vector, where it is nearly identical to it."""
    near = top1(cleared, memory, id_col).filter(F.col("similarity") > C.MEMORY_REMOVE_SIM).select("entry_id").distinct()
    return memory.join(near, "entry_id", "left_anti")


# ------------------------------------------------------------------ correlation between actors
def latest_vectors(vectors: DataFrame, now_us: int | None = None, window_us: int | None = None) -> DataFrame:
    """Newest unit vector per actor (ip, t_us, event_id, vec), of those active within the window before ``now_us``."""
    if now_us is not None:
        vectors = vectors.filter((F.col("t_us") >= now_us - window_us) & (F.col("t_us") <= now_us))
    newest_vec = F.max_by("vec", F.struct("t_us", "event_id")).alias("vec")
    return vectors.groupBy("ip").agg(newest_vec).withColumn("vec", unit(F.col("vec").cast("array<double>")))


_FOUND = "a long, b long, best double, twins long"


#: Rows of either side that are compared as one matrix product.
PANEL = 2048


def panels(rows: np.ndarray, cell: np.ndarray) -> list[np.ndarray]:
    """Rows of a side, cell by cell, in panels of at most PANEL of one cell."""
    rows = rows[np.argsort(cell[rows], kind="stable")]
    parts = np.split(rows, np.flatnonzero(np.diff(cell[rows])) + 1) if len(rows) else []
    return [p[at:at + PANEL] for p in parts for at in range(0, len(p), PANEL)]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row of each row's group, once the groups of each a and its b are one."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _compare(threshold: float, links: bool = False, get_wanted=None):
    """Compare two bins: a row (vid, vid, best, twins) per vector, or, for links, rows (a, b, -1, 0) that connect what is
    similar there, fewer than there are vectors. Panels of cells that are not wanted together are left out."""
    def run(pairs: pa.Table) -> pa.Table:
        left, right = (np.flatnonzero(pairs[x].to_numpy()) for x in ("_left", "_right"))
        ids, n, vecs = pairs["vid"].to_numpy(), pairs["n"].to_numpy().astype(float), matrix(pairs["vec"])
        cell = pairs["cell"].to_numpy() if get_wanted else np.zeros(len(ids), np.int64)
        wanted = get_wanted() if get_wanted else np.ones((1, 1), bool)
        same = pairs["_i"][0].as_py() == pairs["_j"][0].as_py()
        best, twins, root = np.full(len(ids), -np.inf), np.zeros(len(ids)), np.arange(len(ids))
        rows, columns = panels(left, cell), panels(right, cell)
        for i, x in enumerate(rows):
            for k, y in enumerate(columns):
                if same and k < i or not wanted[cell[x[0]], cell[y[0]]]:
                    continue
                s = vecs[x] @ vecs[y].T
                if same and k == i:
                    np.fill_diagonal(s, -1.0)
                near = s > threshold
                if links:
                    a, b = np.nonzero(near)
                    root = joined(root, x[a], y[b])
                    continue
                best[x], twins[x] = np.maximum(best[x], s.max(axis=1)), twins[x] + near @ n[y]
                if not (same and k == i):
                    best[y], twins[y] = np.maximum(best[y], s.max(axis=0)), twins[y] + n[x] @ near
        if links:
            at = np.flatnonzero(root != np.arange(len(root)))
            ends = np.sort(np.stack([ids[root[at]], ids[at]]), axis=0)
            return pa.table({"a": ends[0], "b": ends[1], "best": np.full(len(at), -1.0), "twins": np.zeros(len(at), np.int64)})
        met = np.isfinite(best)
        return pa.table({"a": ids[met], "b": ids[met], "best": best[met], "twins": np.rint(twins[met]).astype(np.int64)})
    return run


#: Pivots by which distinct vectors are dealt into cells: at most so many, so that all pairs of cells can be looked at.
PIVOTS = 1024


def in_cells(rows: DataFrame, tile_rows: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors (vid, vec, others) with the cell of their nearest pivot, its tile of at most about tile_rows and
    the cell's tiles; the angles between pivots, the largest angle in each cell, and its first tile (one more at the end).

    Pivots are the vectors of the smallest ids, one for each tile that there will be.
    """
    n = rows.count()
    pivots = rows.orderBy("vid").select("vec").limit(max(1, min(PIVOTS, -(-n // tile_rows)))).collect()  # bounded
    p = np.array([r["vec"] for r in pivots], dtype=float).reshape(len(pivots), -1)
    names = rows.columns
    shared = sent(rows.sparkSession, p)

    def near(batches):
        for batch in batches:
            v = matrix(pa.chunked_array([batch.column(names.index("vec"))])) if batch.num_rows else np.zeros((0, shared().shape[1]))
            s = v @ shared().T
            cell = s.argmax(axis=1)
            angle = np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=[*names, "cell", "angle"])

    schema = rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle")).schema
    placed = stage(rows.mapInArrow(near, schema), "cells")
    size, radius = np.zeros(len(p), np.int64), np.zeros(len(p))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():  # a row for each pivot
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    tiles = -(-size // tile_rows)
    first = np.concatenate([[0], np.cumsum(tiles)])
    counts, starts = (F.get(F.lit(np.asarray(x, dtype=np.int64)), F.col("cell")) for x in (np.maximum(tiles, 1), first[:-1]))
    placed = placed.withColumn("tile", (starts + F.pmod(F.xxhash64("vid"), counts)).cast("int"))
    return placed, np.arccos(np.clip(p @ p.T, -1, 1)), radius, first


def least_angles(between: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """A bound from below on the angle of any two vectors of two cells, by the triangle inequality."""
    bound = between - radius[:, None] - radius[None, :]
    np.fill_diagonal(bound, 0.0)
    return np.maximum(bound, 0.0)


def meetings(placed: DataFrame, first: np.ndarray, wanted: np.ndarray, bins: np.ndarray | None = None) -> DataFrame:
    """Vectors sent to the pairs of bins (``_i`` <= ``_j``) whose cells are to meet; each tile is a bin, or lies in the
    one given."""
    bins = np.arange(first[-1]) if bins is None else bins
    partners = [(i, sorted({int(bins[t]) for j in np.flatnonzero(wanted[i]) for t in range(int(first[j]), int(first[j + 1]))})) for i in range(len(wanted))]
    table = placed.sparkSession.createDataFrame(partners, "cell int, others array<int>")
    own = F.get(F.lit(np.asarray(bins, dtype=np.int32)), F.col("tile"))
    rows = placed.withColumn("tile", own).join(F.broadcast(table), "cell").select("vid", "vec", "n", "g", "cell", "tile", F.explode("others").alias("_t"))
    return rows.select("vid", "vec", "n", "g", "cell", F.least("tile", "_t").alias("_i"), F.greatest("tile", "_t").alias("_j"),
                       (F.col("tile") <= F.col("_t")).alias("_left"), (F.col("tile") >= F.col("_t")).alias("_right"))


def in_bins(placed: DataFrame, n_tiles: int, tile_rows: int) -> np.ndarray:
    """The bin of each tile: consecutive tiles, whose cells' pivots come one after the other."""
    size = np.zeros(n_tiles, np.int64)
    for r in placed.groupBy("tile").agg(F.count("*").alias("n")).collect():  # a row for each tile
        size[r["tile"]] = r["n"]
    return (np.cumsum(size) - size) // bin_rows(int(size.sum()), tile_rows)


def _by_cells(rows: DataFrame, threshold: float, tile_rows: int, maxima: bool) -> DataFrame:
    """What the comparisons found: maxima and twins, or links. Pairs of cells that lie too far apart for the threshold are
    left out; for the maxima, those follow that lie nearer than the best that some vector of either cell has found by then."""
    def compared(cells):
        pairs = meetings(placed, first, cells, bins)
        one = _compare(threshold, not maxima, sent(rows.sparkSession, cells))
        return stage(pairs.groupBy("_i", "_j").applyInArrow(one, _FOUND), "similar")

    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], _FOUND)
    placed, between, radius, first = in_cells(rows, tile_rows)
    bins = in_bins(placed, int(first[-1]), tile_rows)
    bound = least_angles(between, radius)
    wanted = bound <= np.arccos(np.clip(threshold, -1, 1)) + SLACK
    found = compared(wanted)
    if not maxima or wanted.all():
        return found
    best = found.groupBy(F.col("a").alias("vid")).agg(F.max("best").alias("best"))
    farthest = np.zeros(len(bound))
    for r in placed.select("vid", "cell").join(best, "vid", "left").groupBy("cell").agg(F.min(F.coalesce("best", F.lit(-1.0))).alias("least")).collect():
        farthest[r["cell"]] = np.arccos(np.clip(r["least"], -1, 1))
    later = ~wanted & (bound <= np.maximum(farthest[:, None], farthest[None, :]) + SLACK)
    return found.unionByName(compared(later)) if later.any() else found


def _compared(actors: DataFrame, threshold: float, tile_rows: int, group: str | None = None, maxima: bool = False) -> tuple[DataFrame, DataFrame]:
    """(actors with ``vid``, what the tile comparisons found); equal vectors of a group are compared once."""
    text_of = F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")
    own = actors.withColumn("g", F.col(group) if group else F.lit(0))
    tagged = stage(own.withColumn("vid", F.xxhash64("g", text_of)), "actors")
    rows = tagged.groupBy("vid").agg(F.first("vec").alias("vec"), F.first("g").alias("g"), F.count("*").alias("n"))
    if group is None:
        return tagged, _by_cells(stage(rows, "vectors"), threshold, tile_rows, maxima)
    pairs = tile_pairs(rows, ["g"], "vid", tile_rows)
    return tagged, stage(pairs.groupBy("g", "_i", "_j").applyInArrow(_compare(threshold), _FOUND), "similar")


def correlate(actors: DataFrame, threshold: float = C.CORRELATION_SIM, tile_rows: int = TILE_ROWS, group: str | None = None) -> DataFrame:
    """(ip, max_similarity, peers): highest cosine to any other actor and the number of actors above the threshold.

    Exact. With a group column (kept in the result), actors are compared within each group, all groups in one job. Actors
    with equal vectors are compared once; the distinct vectors are compared tile by tile as matrix products, which return
    one row per vector and tile. Without a group, tiles lie in cells around pivots, and the angles between pivots rule out
    pairs of cells whose vectors can neither be similar nor hold a vector's maximum; what is sent to be compared grows with
    the vectors, as these lie in a bounded number of bins.
    """
    tagged, found = _compared(actors, threshold, tile_rows, group, maxima=True)
    best = found.groupBy(F.col("a").alias("vid")).agg(F.max("best").alias("best"), F.sum("twins").alias("twins"))
    copies = tagged.groupBy("vid").agg(F.count("*").alias("n"), F.first("vec").alias("v")).select(
        "vid", "n", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("self"))
    per_vec = copies.join(best, "vid", "left").select(
        "vid", F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n") > 1, F.col("self")).otherwise(0.0)).alias(
            "max_similarity"),
        (F.coalesce("twins", F.lit(0)) + F.when(F.col("self") > threshold, F.col("n") - 1).otherwise(0)).alias("peers"))
    kept = [group] if group else []
    return tagged.select("ip", "vid", *kept).join(per_vec, "vid").select(
        "ip", F.greatest("max_similarity", F.lit(0.0)).alias("max_similarity"), "peers", *kept)


def _correlated_before(queries: pa.Table, vectors: pa.Table) -> pa.Table:
    """For each query of one block, the highest similarity to vectors of other actors that stand at its place."""
    codes: dict = {}
    mine, theirs = (np.array([codes.setdefault(x, len(codes)) for x in t["ip"].to_pylist()], dtype=np.int64) for t in (queries, vectors))
    if not len(mine) or not len(theirs):
        return pa.table({"event_id": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
    at, start, end = (x.to_numpy() for x in (queries["at"], vectors["at"], vectors["until"]))
    top, _ = most_similar(matrix(queries["vec"]), matrix(vectors["vec"]), at, start, end, mine, theirs)
    some = np.isfinite(top)
    return pa.table({"event_id": queries["event_id"].to_numpy()[some], "best": top[some]})


def correlate_before(vectors: DataFrame, window_us: int, cfg: Config, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(event_id, max_similarity): for each vector (event_id, ip, t_us, vec), the highest cosine to the vectors that other
    actors showed last before it, within the window; 0 without any.

    A vector stands from its place in the order of time up to its actor's next vector or the end of its window. Places are
    numbers on one timeline, cut into blocks of consecutive ones, of at least ``tile_rows`` places and a bounded number of
    blocks (`bin_rows`); a vector goes to the blocks it stands in, and there to a tile of actors, so a task sees a block and
    a tile, whatever the number of actors.
    """
    c, zero, one = F.col, F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = with_rows(vectors.select("event_id", "ip", "t_us", unit(c("vec").cast("array<double>")).alias("vec")), "correlation-rows")
    ends = rows.select("event_id", "ip", (c("t_us") + window_us).alias("t_us"), F.lit(1).alias("turn"), zero.alias("one"))
    line = rows.drop("vec").withColumn("turn", F.lit(0)).withColumn("one", one).unionByName(ends, allowMissingColumns=True).withColumn("all", F.lit(0))
    # a window ends after everything at its last moment
    line = line.withColumn("_id", F.when(c("turn") == 0, c("event_id")).otherwise(F.lit(2 ** 63 - 1)))
    placed = running(line, ["all"], {"at": ("sum", c("one"))}, cfg.segment_us, ("t_us", "_id", "event_id", "turn"), piece_rows=max(cfg.block_rows, BIN_ROWS))
    placed = stage(placed.select("event_id", "ip", "t_us", "turn", "_row", "at"), "correlation-timeline")
    shown = stage(running(placed.filter("turn = 0").drop("turn"), ["ip"], {"rn": ("sum", one)}, cfg.segment_us), "correlation-shown")
    after = shown.select("ip", (c("rn") - 1).alias("rn"), (c("at") - 1).alias("until"))
    window = placed.filter("turn = 1").select("event_id", c("at").alias("window_end"))
    stands = shown.join(after, ["ip", "rn"], "left").join(window, "event_id").withColumn("until", F.least("until", "window_end"))
    stands = stage(stands.select("event_id", "ip", "_row", "at", "until").join(rows.select("_row", "vec"), "_row"), "correlation-stands")
    places, = placed.agg(F.coalesce(F.max("at"), zero)).first()
    size, tile = bin_rows(places, tile_rows, BLOCKS), bin_rows(places, 2 * tile_rows)
    block = lambda x: F.expr(f"cast(({x}) div {size} as int)")
    standing = stands.filter("until > at")
    spans = standing.select(block("at").alias("_first"), block("until - 1").alias("_last"))
    n, = spans.select(F.explode(F.sequence("_first", "_last")).alias("_block")).groupBy("_block").agg(F.count("*").alias("n")).agg(F.max("n")).first()
    tiles = max(1, -(-(n or 0) // tile))
    v = standing.select("ip", "vec", "at", "until", F.explode(F.sequence(block("at"), block("until - 1"))).alias("_block"))
    v = v.withColumn("_tile", F.pmod(F.xxhash64("ip"), F.lit(tiles)).cast("int"))
    v = v.select("until", *[c(x).alias(x) for x in ("ip", "vec", "at", "_block", "_tile")])  # names of their own, for the join below
    q = stands.select("event_id", "ip", "vec", "at", block("at - 1").alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_tile"))
    near = q.groupBy("_block", "_tile").cogroup(v.groupBy("_block", "_tile")).applyInArrow(_correlated_before, "event_id long, best double")
    best = near.groupBy("event_id").agg(F.max("best").alias("best"))
    return shown.select("event_id").join(best, "event_id", "left").select(
        "event_id", F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)).alias("max_similarity"))


def campaigns(actors: DataFrame, threshold: float = C.CORRELATION_SIM, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(ip, campaign): actors linked by chains of similar vectors; a campaign is named after its first member ip.

    Comparing two bins returns only as many links as connect what is similar there, not every similar pair; cells that lie
    too far apart are not compared.
    """
    c = F.col
    tagged, found = _compared(actors, threshold, tile_rows)
    groups = components(found.select("a", "b")).withColumnRenamed("id", "vid")
    sizes = tagged.groupBy("vid").agg(F.count("*").alias("n"))
    linked = (sizes.join(groups, "vid", "left").filter((c("n") > 1) | c("component").isNotNull())
              .select("vid", F.coalesce("component", "vid").alias("component")))
    members = tagged.select("ip", "vid").join(linked, "vid")
    names = members.groupBy("component").agg(F.min("ip").alias("campaign"))
    return members.join(names, "component").select("ip", "campaign")


def campaign_rows(members: DataFrame, correlated: DataFrame, now_us: Column, requests: DataFrame) -> DataFrame:
    """One row per campaign: id, number of members, highest similarity, how many endpoints and payloads all its members
    requested, status. Members are the rows of ``campaigns``."""
    sizes = members.join(correlated, "ip").groupBy("campaign").agg(
        F.count("*").alias("n_members"), F.max("max_similarity").alias("similarity_score"))
    kinds = F.array(*[F.struct(F.lit(x).alias("what"), F.col(x).alias("value")) for x in ("endpoint", "payload")])
    shown = requests.select("ip", F.explode(kinds).alias("v")).filter("v.value <> ''").distinct().join(members, "ip")
    by_all = shown.groupBy("campaign", "v").agg(F.count("*").alias("n")).join(sizes.select("campaign", "n_members"), "campaign").filter("n = n_members")
    common = by_all.groupBy("campaign").agg(F.count_if(F.col("v.what") == "endpoint").alias("common_endpoints"),
                                            F.count_if(F.col("v.what") == "payload").alias("common_payloads"))
    none = F.lit(0).cast("long")
    return sizes.join(common, "campaign", "left").select(
        F.substring(F.sha2("campaign", 256), 1, 16).alias("campaign_id"), "campaign", "n_members", "similarity_score",
        F.coalesce("common_endpoints", none).alias("common_endpoints"), F.coalesce("common_payloads", none).alias("common_payloads"),
        now_us.alias("detected_us"), F.lit("ACTIVE").alias("status"))
