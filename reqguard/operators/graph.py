"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqguard.session import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id connected to each node, for undirected edges between numbers.

    Alternates two steps until all links are stars around the smallest: every node links its larger neighbours, then its smaller ones, to the
    smallest neighbour it has. The number of rounds grows with the logarithm of the size. Each round is written to the
    shared folder, which cuts the lineage.
    """
    c = F.col

    def link(e, larger):
        u, v = ("u", "v") if larger else ("v", "u")
        both = (e.select(c(u).alias("u"), c(v).alias("v")).unionByName(e.select(c(v).alias("u"), c(u).alias("v")))
                if larger else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), c("u")).alias("m"))
        met = both.join(least, "u")
        if larger:
            out = met.filter(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v"))
        else:
            out = met.select(c("v").alias("u"), c("m").alias("v")).unionByName(
                least.select("u", c("m").alias("v")))
        return out.filter(c("u") != c("v")).distinct()

    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(c("u") != c("v")).distinct(),
              "edges")
    def starred(e):
        """Every node has one link, to a node that has none: nothing is left to do."""
        ends = e.select(c("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(c("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
        return odd.isEmpty()

    while not starred(e):
        e = stage(link(link(e, True), False), "edges")
    roots = e.select(c("v").alias("id"), c("v").alias("component")).distinct()
    return e.select(c("u").alias("id"), c("v").alias("component")).unionByName(roots)
