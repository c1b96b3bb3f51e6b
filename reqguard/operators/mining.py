"""Mining rules from payloads: density clusters of payload shapes and the text their members share."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqguard import constants as C
from reqguard.functions import text
from reqguard.operators.graph import components
from reqguard.operators.tiles import sides, spanning_edges, tile_pairs
from reqguard.session import stage

TILE = 512
_FOUND = "a long, b long, x long"
_EMPTY = pd.DataFrame({"a": [], "b": [], "x": []}).astype("int64")


def shape_id(shape):
    """Number of a payload shape: the first 60 bits of its md5."""
    return F.conv(F.substring(F.md5(shape), 1, 15), 16, 10).cast("long")


def shapes(payloads: DataFrame) -> DataFrame:
    """(fid, shape, weight): distinct structural fingerprints with the number of payloads behind each."""
    shape = text.structural_fingerprint(F.col("payload"))
    return (payloads.select(shape.alias("shape")).groupBy("shape").agg(F.count("*").alias("weight"))
            .withColumn("fid", shape_id(F.col("shape"))))


def rare_prefixes(shape_rows: DataFrame, min_cosine: float) -> DataFrame:
    """Rows (gram, rank, fid, weight, grams, weights, earlier): each shape under the rare tri-grams it must be found by.

    Grams are ranked by how few shapes have them. Of two shapes with cosine >= min_cosine at least one shared gram lies
    in both prefixes, where a prefix ends as soon as the remaining grams are too short a vector to reach min_cosine.
    Common grams so drop out of the index, and the result stays exact.
    """
    c = F.col
    grams = stage(text.trigram_counts(shape_rows, "fid", "shape"), "grams")
    known = grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    rest = (Window.partitionBy("fid").orderBy(F.desc("df"), F.desc("gram"))
            .rowsBetween(Window.unboundedPreceding, 0))  # from the most common gram up to this one
    known = known.withColumn("left", F.sum(c("weight") * c("weight")).over(rest))
    entry = F.struct("df", "gram", c("weight").alias("w"), (c("left") >= min_cosine ** 2 - 1e-9).alias("use"))
    vectors = known.groupBy("fid").agg(F.array_sort(F.collect_list(entry)).alias("v"))
    used = F.filter("v", lambda e: e["use"])
    rows = vectors.join(shape_rows.select("fid", c("weight").alias("n")), "fid").select(
        "fid", "n", c("v.gram").alias("grams"), c("v.w").alias("weights"), used.alias("u"))
    return rows.select("fid", "n", "grams", "weights", F.posexplode("u.gram").alias("pos", "gram"), "u").select(
        "gram", "fid", "n", "grams", "weights", F.slice("u.gram", F.lit(1), c("pos")).alias("earlier"))


def _matrix(gram_lists, vocabulary, weight_lists=None):
    """Rows of gram weights (1 where none are given) over the grams of the vocabulary."""
    out = np.zeros((len(gram_lists), len(vocabulary)))
    for i, grams in enumerate(gram_lists):
        weights = [1.0] * len(grams) if weight_lists is None else weight_lists.iloc[i]
        for g, w in zip(grams, weights):
            if g in vocabulary:
                out[i, vocabulary[g]] = w
    return out


def _similar(pdf, min_cosine):
    """(left, right, same, matrix of similar pairs that are to be counted under this gram)"""
    left, right, same = sides(pdf)
    if not len(left) or not len(right):
        return left, right, same, None
    vocabulary = {g: i for i, g in enumerate(sorted({g for grams in left["grams"] for g in grams}))}
    a, b = (_matrix(rows["grams"], vocabulary, rows["weights"]) for rows in (left, right))
    near = a @ b.T >= min_cosine - 1e-9
    before = {g: i for i, g in enumerate(sorted({g for grams in left["earlier"] for g in grams}))}
    if before:  # pairs that share a rarer gram are counted there
        near &= _matrix(left["earlier"], before) @ _matrix(right["earlier"], before).T == 0
    if same:
        near &= left["fid"].to_numpy()[:, None] != right["fid"].to_numpy()[None, :]
    return left, right, same, near


def _degrees(min_cosine):
    def run(pdf):
        left, right, same, near = _similar(pdf, min_cosine)
        if near is None:
            return _EMPTY
        parts = [(left, near @ right["n"].to_numpy())]
        if not same:
            parts.append((right, near.T @ left["n"].to_numpy()))
        return pd.concat([pd.DataFrame({"a": r["fid"], "b": r["fid"], "x": d}) for r, d in parts])
    return run


def _core_links(min_cosine):
    def run(pdf):
        left, right, _, near = _similar(pdf, min_cosine)
        if near is None:
            return _EMPTY
        edges = spanning_edges(left["fid"].to_numpy(), right["fid"].to_numpy(), near)
        e = np.array(edges, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": e[:, 0], "b": e[:, 1], "x": 0})
    return run


def _border_labels(min_cosine):
    """Smallest cluster among the similar core shapes of each border shape."""
    none = np.iinfo(np.int64).max

    def run(pdf):
        left, right, same, near = _similar(pdf, min_cosine)
        if near is None:
            return _EMPTY
        out = []
        for rows, others, m in ((left, right, near),) if same else ((left, right, near), (right, left, near.T)):
            border, core = ~rows["core"].to_numpy(), others["core"].to_numpy()
            if border.any() and core.any():
                labels = np.where(m[border][:, core], others["cluster"].to_numpy()[core][None, :], none).min(axis=1)
                found = labels < none
                ids = rows["fid"].to_numpy()[border][found]
                out.append(pd.DataFrame({"a": ids, "b": ids, "x": labels[found]}))
        return pd.concat(out) if out else _EMPTY
    return run


def cluster_shapes(shape_rows: DataFrame, eps: float = C.CLUSTER_EPS, min_samples: int = C.CLUSTER_MIN_SAMPLES,
                   tile_rows: int = TILE) -> DataFrame:
    """Density clusters of payload shapes by cosine distance: (fid, shape, weight, core, cluster); noise is left out.

    A shape is core when the payloads within eps of it, its own included, number at least min_samples. Core shapes
    within eps of each other share a cluster, named after its smallest core fid; a border shape joins the smallest such
    cluster within eps. Each pair of candidate shapes is compared in exactly one tile pair; tasks return sums and links
    per shape, never lists of pairs.
    """
    c = F.col
    cosine = 1.0 - eps
    shape_rows = stage(shape_rows.filter(F.length("shape") >= 3), "shapes")
    index = stage(rare_prefixes(shape_rows, cosine), "gram-index")

    def compare(rows, job):
        pairs = tile_pairs(rows, ["gram"], "fid", tile_rows)
        return pairs.groupBy("gram", "_i", "_j").applyInPandas(job(cosine), _FOUND)

    degrees = compare(index, _degrees).groupBy(c("a").alias("fid")).agg(F.sum("x").alias("near"))
    marked = stage(shape_rows.join(degrees, "fid", "left").withColumn(
        "core", c("weight") + F.coalesce("near", F.lit(0)) >= min_samples).drop("near"), "cores")
    cores = marked.filter("core").select("fid")
    links = compare(index.join(cores, "fid"), _core_links).select("a", "b")
    groups = components(links)
    labelled = stage(marked.join(groups.withColumnRenamed("id", "fid"), "fid", "left").withColumn(
        "cluster", F.when(c("core"), F.coalesce("component", "fid"))).drop("component"), "labels")
    tags = labelled.select("fid", "core", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    borders = (compare(index.join(tags, "fid"), _border_labels).groupBy(c("a").alias("fid"))
               .agg(F.min("x").alias("border")))
    return (labelled.join(borders, "fid", "left").withColumn("cluster", F.coalesce("cluster", "border"))
            .drop("border").filter(c("cluster").isNotNull()))


def payload_clusters(payloads: DataFrame, clusters: DataFrame) -> DataFrame:
    """(payload, n, cluster) for the distinct payloads of clustered shapes."""
    rows = payloads.groupBy("payload").agg(F.count("*").alias("n")).withColumn(
        "fid", shape_id(text.structural_fingerprint(F.col("payload"))))
    return rows.join(clusters.select("fid", "cluster"), "fid").select("payload", "n", "cluster")


def cluster_sizes(clusters: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """(cluster, cluster_size, confidence) of clusters large enough to learn from."""
    sizes = clusters.groupBy("cluster").agg(F.sum("weight").alias("cluster_size"))
    sizes = sizes.withColumn("confidence", F.least(F.lit(1.0), F.col("cluster_size") / 20.0))
    return sizes.filter(F.col("confidence") >= min_confidence)


class Substrings:
    """The suffix automaton of a text: each state stands for strings that end at the same places of it, the longest of
    `size` characters, and `end` is the first such place. Built in linear time."""

    def __init__(self, text_: str):
        self.text, self.moves, self.link, self.size, self.end = text_, [{}], [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text_):
            new = self._state({}, self.size[last] + 1, 0, at)
            p = last
            while p >= 0 and c not in self.moves[p]:
                self.moves[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.moves[p][c]
                if self.size[p] + 1 < self.size[q]:
                    copy = self._state(dict(self.moves[q]), self.size[p] + 1, self.link[q], self.end[q])
                    while p >= 0 and self.moves[p].get(c) == q:
                        self.moves[p][c] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[new] = q
            last = new
        self.longest_first = sorted(range(1, len(self.size)), key=lambda v: -self.size[v])

    def _state(self, moves, size, link, end):
        for values, x in ((self.moves, moves), (self.size, size), (self.link, link), (self.end, end)):
            values.append(x)
        return len(self.size) - 1

    def matched(self, other: str) -> list[int]:
        """For each state, the length of its longest string that the other text contains; linear in both texts."""
        best, state, n = [0] * len(self.size), 0, 0
        for c in other:
            while state and c not in self.moves[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.moves[state]:
                state, n = self.moves[state][c], n + 1
            best[state] = max(best[state], n)
        for v in self.longest_first:
            if best[v] and self.link[v] > 0:  # with a string, all its endings are contained
                best[self.link[v]] = self.size[self.link[v]]
        return best

    def ending(self, state: int, n: int) -> str:
        """The string of n characters that a state stands for."""
        return self.text[self.end[state] + 1 - n:self.end[state] + 1]


def shared_lengths(seed: str, payload: str) -> list[int]:
    """For each position of seed, the length of the longest text starting there that payload contains."""
    own = Substrings(payload[::-1])
    out, state, n = [], 0, 0
    for c in reversed(seed):
        while state and c not in own.moves[state]:
            state = own.link[state]
            n = own.size[state]
        if c in own.moves[state]:
            state, n = own.moves[state][c], n + 1
        out.append(n)
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _matched(seed: pd.Series, payload: pd.Series) -> pd.Series:
    of_seed, out = {}, []  # rows of a batch share few seeds
    for s, p in zip(seed, payload):
        if s not in of_seed:
            of_seed = {**of_seed, s: Substrings(s)} if len(of_seed) < 8 else {s: Substrings(s)}
        out.append(of_seed[s].matched(p))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def _first_text(seed: pd.Series, states: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([min(Substrings(s).ending(v, k) for v in vs) for s, vs, k in zip(seed, states, n)])


def cluster_cores(members: DataFrame, min_chars: int = 7) -> DataFrame:
    """(cluster, core): the longest text that all payloads of a cluster contain, the first one in order on ties.

    Any such text is part of the cluster's shortest payload, its seed. Every payload runs through the seed's automaton, in
    linear time, and yields how much of each state it has; the minimum over the cluster is aggregated state by state,
    partially before the shuffle. A state that some payload lacks drops out by its count.
    """
    c = F.col
    seeds = stage(members.groupBy("cluster").agg(F.min(F.struct(F.length("payload"), "payload"))["payload"].alias("seed"),
                                                 F.count("*").alias("payloads")), "seeds")
    rows = members.join(seeds, "cluster").select("cluster", F.posexplode(_matched("seed", "payload")).alias("state", "n")).filter("n > 0")
    shared = rows.groupBy("cluster", "state").agg(F.min("n").alias("n"), F.count("*").alias("found")).filter(c("n") >= min_chars)
    whole = shared.join(seeds, "cluster").filter(c("found") == c("payloads"))
    best = whole.groupBy("cluster").agg(F.max("n").alias("n"))
    longest = whole.join(best, ["cluster", "n"]).groupBy("cluster", "n").agg(F.collect_list("state").alias("states"))
    return longest.join(seeds, "cluster").select("cluster", _first_text("seed", "states", "n").alias("core"))


def mine_rules(payloads: DataFrame, eps: float = C.CLUSTER_EPS, min_samples: int = C.CLUSTER_MIN_SAMPLES) -> DataFrame:
    """(cluster, cluster_size, confidence, core) of every cluster that is large and specific enough."""
    clusters = stage(cluster_shapes(shapes(payloads), eps, min_samples), "clusters")
    large = cluster_sizes(clusters)
    members = payload_clusters(payloads, clusters).join(large.select("cluster"), "cluster", "left_semi")
    return large.join(cluster_cores(members), "cluster")


def pool_diversity(pool: DataFrame, keys: list[str]) -> DataFrame:
    """Per pool: payloads, distinct share, and whether it is diverse enough to learn from."""
    out = pool.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("payload").alias("n_distinct"))
    share = F.col("n_distinct") / F.col("n")
    return out.withColumns({"share": share, "diverse": (F.col("n") >= 5) & (share > 0.4)})
