"""Operator 4: documents linked by the Jaccard similarity of their word shingles, by rare-first prefix filtering."""

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reqguard.llm.shingles import Hasher, digest, text_parts
from reqguard.llm.stage import discard, release, sent, stage
from reqguard.llm.text import carried, given_back
from reqguard.operators.graph import components

#: Links: 100 * |both| >= PERCENT * |either|.
PERCENT = 75
#: Cells that count in how many documents the shingles of a hash range occur (2 ** CELL_BITS); the order of shingles
#: from rare to frequent is that of (count of the cell, hash).
CELL_BITS = 20
#: Cells of a row in the table of counts.
CHUNK = 1 << 14
#: Rounds in which nodes are compared with one hub each, before the pairs that are left.
ROUNDS = 2
#: Bytes of prefix rows in a partition.
PART_BYTES = 16 << 20
LAST = 2 ** 63 - 1


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def sets_and_counts(batches):
    """(id, text) -> a row per document (id, n, d1, d2: size and digest of its set, mark: md5 of the text), and per task a
    row for each chunk of cells (id: the chunk, cells: documents per cell, d1, d2 and mark null)."""
    hasher, counts = Hasher(), np.zeros(1 << CELL_BITS, np.uint32)
    names = ["id", "n", "d1", "d2", "mark", "cells"]
    for ids, texts in text_parts(batches):
        sets = hasher.shingles(texts)
        counts += np.bincount(cell(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)
        d = np.array([digest(s) for s in sets]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                                          pa.array([md5(t).digest() for t in texts], pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
    rows = counts.reshape(-1, CHUNK)
    none = pa.nulls(len(rows), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), none, none, none, pa.nulls(len(rows), pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], names=names)


def added_cells(rows: pa.Table) -> pa.Table:
    """Counts of one chunk, added up over the tasks; whichever exceeds 32 bits stays at their end."""
    total = np.zeros(CHUNK, np.uint64)
    for r in rows.column("cells"):
        total += np.frombuffer(r.as_buffer(), np.uint32)
    return pa.table({"id": rows.column("id").slice(0, 1), "cells": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})


def prefix_size(n):
    """How many of its n shingles, in the common order, a set must show: two that link share one of these."""
    return n - (PERCENT * n + 99) // 100 + 1


def index_size(n):
    """The same for the smaller of two sets."""
    return n - F.ceil(F.lit(2 * PERCENT) * n / F.lit(100 + PERCENT)) + 1


def prefix_size_of(n):
    """The same as an expression."""
    return n - F.floor((PERCENT * n + 99) / 100) + 1


def prefixes(get_counts):
    def run(batches):
        """(id, text) -> (token, node, n, pos, freq: the count of the token's cell): the rarest shingles of each set, in
        order; a set that a task has met before shows nothing."""
        counts, hasher, met = get_counts(), Hasher(), set()
        for _, texts in text_parts(batches):
            tokens, nodes, sizes, lengths, often = [], [], [], [], []
            for s in hasher.shingles(texts):
                d = tuple(digest(s).tolist())
                if len(s) and d not in met:
                    met.add(d)
                    p = prefix_size(len(s))
                    tokens.append(s[np.argsort(counts[cell(s)], kind="stable")[:p]])
                    often.append(counts[cell(tokens[-1])])
                    nodes.append(d[0])
                    sizes.append(len(s))
                    lengths.append(p)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
                     pa.array(np.repeat(np.array(sizes, np.int64), lengths)), pa.array(np.concatenate([np.arange(p) for p in lengths])),
                     pa.array(np.concatenate(often).astype(np.int64))],
                    names=["token", "node", "n", "pos", "freq"])

    return run


def whole_sets(batches):
    """(id, text) -> (id, d1, d2, tokens)."""
    hasher = Hasher()
    for ids, texts in text_parts(batches):
        sets = hasher.shingles(texts)
        d = np.array([digest(s) for s in sets]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
            names=["id", "d1", "d2", "tokens"])


def fewest_common(na, nb):
    """The least number of common prefix shingles that two linking sets of these sizes can have: what they need in all,
    less what can lie behind the prefixes."""
    need = F.ceil((F.lit(PERCENT) * (na + nb)) / F.lit(100 + PERCENT))
    behind = lambda n: F.floor(F.lit(PERCENT) * n / F.lit(100) + F.lit(0.99)) - 1
    return F.greatest(F.lit(1), need - F.greatest(behind(na), behind(nb)))


def near_size(na, nb):
    """The length filter."""
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def with_reach(lists: DataFrame) -> DataFrame:
    """Rows of shared prefix shingles -> with share, the part of its prefix that a node shares; last_freq and last_token,
    the place in the common order of the last shingle it shares; after, how many it shares from this one on; and most.

    most is how many shingles a node can share, from this one on, with a node whose last shared shingle comes no sooner.
    A shingle that no other prefix shows and that comes before the last shared one would lie in the prefix of such a node
    if its set had it; so it is in none. A node whose last shared shingle comes sooner may have it behind its prefix.
    """
    node = Window.partitionBy("node")
    behind = node.orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    last = F.max(F.struct("freq", F.col("token").bitwiseXOR(F.lit(-2 ** 63)).alias("token"))).over(node)  # tokens have no sign
    shared = F.count(F.lit(1))
    return lists.select("token", "node", "n", "pos", (shared.over(node) / prefix_size_of(F.col("n"))).alias("share"),
                        shared.over(behind).alias("after"), (shared.over(behind) + F.col("n") - 1 - F.max("pos").over(node)).alias("most"), last.alias("_last")).select(
        "token", "node", "n", "pos", "share", "after", "most", F.col("_last.freq").alias("last_freq"), F.col("_last.token").alias("last_token"))


def linked(base: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of nodes -> those whose sets link, each pair verified once on its whole sets.

    Only texts of documents in some pair are turned into sets; sets go to the pairs by joins.
    """
    named = stage(pairs.select("a", "b"), "jaccard-pairs")
    nodes = named.select(F.col("a").alias("d1")).union(named.select("b")).distinct()
    wanted = stage(nodes.join(reps, "d1").select("rep", "d1", "d2"), "jaccard-wanted")
    ids = wanted.select(F.col("rep").alias("id")).hint("shuffle_hash")
    sets = base.join(ids, "id", "left_semi").mapInArrow(whole_sets, "id long, d1 long, d2 long, tokens array<long>")
    sets = stage(sets.join(wanted, (sets["id"] == wanted["rep"]) & (sets["d1"] == wanted["d1"]) & (sets["d2"] == wanted["d2"]), "left_semi")
                 .dropDuplicates(["d1", "d2"]).select("d1", "tokens"), "jaccard-sets")
    release(base.sparkSession)
    sa, sb = (sets.select(F.col("d1").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    met = named.join(sa, "a").join(sb, "b").withColumn("both", both)
    either = F.size("ta") + F.size("tb") - F.col("both")
    found = stage(met.filter(100 * F.col("both") >= PERCENT * either).select("a", "b"), "jaccard-links")
    discard(named, wanted, sets)
    release(base.sparkSession)
    return found


def ordered_pair(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def with_components(lists: DataFrame, links: DataFrame | None) -> DataFrame:
    """Lists with the component of each node by the links found so far."""
    if links is None:
        return lists.withColumn("component", F.col("node"))
    together = components(links, "a", "b").withColumnRenamed("id", "node")
    return lists.join(together, "node", "left").withColumn("component", F.coalesce("component", "node"))


def hub_pairs(marked: DataFrame) -> DataFrame:
    """For each node the one node of another component that it should be compared with first.

    In each shingle's list, the hub is the node most of whose prefix shingles are shared: the text that others are edited
    from has few shingles of its own. Each node meets the hub, or the best of another component if the hub is in its own;
    of all it meets so, the one met most often is its pair. So a group of near copies is compared with its hub only.
    """
    lists = Window.partitionBy("token")
    one = F.struct("share", "node", "n", "component")
    rows = marked.withColumn("_hub", F.max(one).over(lists))
    rows = rows.withColumn("_next", F.max(F.when(F.col("component") != F.col("_hub.component"), one)).over(lists))
    rows = rows.withColumn("_with", F.when(F.col("component") != F.col("_hub.component"), F.col("_hub")).otherwise(F.col("_next")))
    met = rows.filter("_with IS NOT NULL").filter(
        near_size(F.col("n"), F.col("_with.n"))).groupBy("node", F.col("_with.node").alias("with")).agg(
        F.count(F.lit(1)).alias("met"), F.max(fewest_common(F.col("n"), F.col("_with.n"))).alias("least"))
    best = met.filter(2 * F.col("met") >= F.col("least")).groupBy("node").agg(F.max(F.struct("met", "with")).alias("w"))
    return best.select(*ordered_pair(F.col("node"), F.col("w.with"))).distinct()


def pairs_apart(marked: DataFrame) -> DataFrame:
    """(a, b, na, nb): nodes of different components that a shingle brings together past the filters.

    Of the smaller set, x, the shingle must lie in its short index prefix; sizes must be near; from the shingle on,
    both must have as many as a link needs (so it is for the first one that a linking pair shares), and the one whose
    last shared shingle comes sooner must have them besides the prefix shingles that no other node shows; and from the
    shingle on, both must share as many prefix shingles as a linking pair has in common at least.
    """
    x, y = marked.alias("x"), marked.alias("y")
    nx, ny, px, py = (F.col(c) for c in ("x.n", "y.n", "x.pos", "y.pos"))
    need = F.ceil((F.lit(PERCENT) * (nx + ny)) / F.lit(100 + PERCENT))
    sooner = lambda u, v: (F.col(f"{u}.last_freq") < F.col(f"{v}.last_freq")) | (
        (F.col(f"{u}.last_freq") == F.col(f"{v}.last_freq")) & (F.col(f"{u}.last_token") <= F.col(f"{v}.last_token")))
    # the first shingle that a pair has in common has all others behind it
    reach = F.least(nx - px, ny - py, F.when(sooner("x", "y"), F.col("x.most")), F.when(sooner("y", "x"), F.col("y.most")))
    smaller = (nx < ny) | ((nx == ny) & (F.col("x.node") < F.col("y.node")))
    met = x.filter(F.col("pos") < index_size(F.col("n"))).join(
        y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & smaller & near_size(nx, ny) & (reach >= need)
        & (F.least(F.col("x.after"), F.col("y.after")) >= fewest_common(nx, ny)))
    a, b = ordered_pair(F.col("x.node"), F.col("y.node"))
    first = F.col("x.node") < F.col("y.node")
    return met.select(a, b, F.when(first, nx).otherwise(ny).alias("na"), F.when(first, ny).otherwise(nx).alias("nb")).distinct()


def with_enough_common(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb), those with as many common prefix shingles as a link has at least. The prefixes of the nodes
    in some pair are written once, as both sides of the pairs read them."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    shown = stage(lists.join(nodes, "node", "left_semi").groupBy("node").agg(F.collect_list("token").alias("tokens")), "jaccard-prefixes")
    sa, sb = (shown.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.join(sa, "a").join(sb, "b").withColumn("met", F.size(F.array_intersect("ta", "tb")))
    return both.filter(F.col("met") >= fewest_common(F.col("na"), F.col("nb"))).select("a", "b")


def components_by_shingles(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, others) -> _id (its id as a long, a null one as the largest), n_shingles and
    component: the smallest id reachable by links, its own included; group, which tells components of the same smallest id
    apart (null without shingles); mark, the md5 of its text.

    Null and empty texts have no shingles and link with nothing. Rows of equal sets belong together by their digest; rows
    that repeat an id stand for themselves. An empty table gives an empty result.

    1. One pass counts documents per hash cell, for the order from rare to frequent, and digests each set. Equal sets
       are one node from here on.
    2. The next pass emits prefix shingles; those met in one node alone end there.
    3. In ROUNDS rounds, each node is verified against one hub: groups of near copies come together by about one link
       for each copy, not by all pairs.
    4. Then every pair of nodes that are not together yet and that a shared prefix shingle brings together past the
       length and positional filters is looked at once: with too few common prefix shingles, what lies behind the prefixes
       (the suffixes) can't make up for it; the others are verified on their whole sets.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    first = stage(base.mapInArrow(sets_and_counts, "id long, n long, d1 long, d2 long, mark binary, cells binary"), "jaccard-sets-counts")
    rows = stage(first.filter("d1 IS NOT NULL").drop("cells"), "jaccard-rows")
    reps = stage(rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "jaccard-reps")
    chunks = first.filter("d1 IS NULL").select("id", "cells").groupBy("id").applyInArrow(added_cells, "id long, cells binary").collect()
    counts = np.zeros(1 << CELL_BITS, np.uint32)  # a fixed number of cells
    for r in chunks:
        counts[r["id"] * CHUNK:(r["id"] + 1) * CHUNK] = np.frombuffer(r["cells"], np.uint32)
    discard(first)
    parts = max(1, int(counts.sum(dtype=np.int64)) * 6 // PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_token = Window.partitionBy("token")
    shown = base.mapInArrow(prefixes(sent(spark, counts)), "token long, node long, n long, pos long, freq long")
    lists = shown.repartition(parts, "token").withColumn("_low", F.min("node").over(in_token)).withColumn("_high", F.max("node").over(in_token))
    lists = stage(lists.filter("_low <> _high").select("token", "node", "n", "pos", "freq").distinct(), "jaccard-lists")
    del shown
    release(spark)
    with_shares = stage(with_reach(lists), "jaccard-shares")
    discard(lists)
    lists = with_shares

    close = None
    for _ in range(ROUNDS):
        found = linked(base, reps, hub_pairs(with_components(lists, close)))
        close = found if close is None else stage(close.unionByName(found), "jaccard-close")
    marked = with_components(lists, close).withColumn("_low", F.min("component").over(in_token)).withColumn("_high", F.max("component").over(in_token))
    marked = stage(marked.filter("_low <> _high").select("token", "node", "n", "pos", "after", "most", "last_freq", "last_token", "component"), "jaccard-apart")
    met = stage(pairs_apart(marked), "jaccard-met")
    discard(marked)
    enough = stage(with_enough_common(lists, met), "jaccard-enough")
    discard(met, lists)
    apart = linked(base, reps, enough)
    found = components(close.unionByName(apart), "a", "b").select(F.col("id").alias("d1"), F.col("component").alias("group"))
    together = reps.join(found, "d1")
    least = together.groupBy("group").agg(F.min("rep").alias("component"))
    named = stage(together.join(least, "group").select("d1", "d2", "group", "component"), "jaccard-components")
    named = reps.join(named, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("group", "d1").alias("group"), F.coalesce("component", "rep").alias("component"))
    return rows.join(named, ["d1", "d2"], "left").select(
        F.col("id").alias("_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"), "group", "mark")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of docs -> doc_id, n_shingles, component_id. A null id stays null, also as a component."""
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return components_by_shingles(docs).select(null("_id").alias("doc_id"), "n_shingles", null("component").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of docs: of each group of linked documents the one with the smallest id,
    and of rows that repeat this id the one whose text's md5 is least. Rows that only share an id, null or not, are kept
    apart; documents without words link with nothing, and all of them stay."""
    text = F.coalesce(docs["text"], F.lit(""))
    words = text.rlike(r"[^ \t-\r]")
    first = components_by_shingles(docs).filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct("_id", "mark")).alias("f"))
    marked = carried(docs, F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("_jid"), F.unhex(F.md5(text.cast("binary"))).alias("_jmark"),
                     words.alias("_words"))
    kept = first.select(F.col("f._id").alias("_jid"), F.col("f.mark").alias("_jmark"))
    rows = marked.filter("_words").join(kept, ["_jid", "_jmark"], "left_semi").dropDuplicates(["_jid", "_jmark"])
    return given_back(rows, docs).unionByName(docs.filter(~words))
