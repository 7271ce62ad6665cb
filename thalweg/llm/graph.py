"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of the edges (a, b): label is the smallest vertex of its component.

    Each round gives a vertex the smallest label around it and then the label of its label, and is written to the
    shared folder; the number of rounds grows with the logarithm of a component's width.  Minima are combined before
    the shuffle, so a vertex of many edges is no burden.  Self-links and repeated edges are allowed; none give none.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("low"))
        top = labels.select(F.col("v").alias("low"), F.col("label").alias("top"))
        new, seen = lower.join(top, "low").select("v", "label", F.least("low", "top").alias("new")), Observation()
        new = saved(new.observe(seen, F.count_if(F.col("new") != F.col("label")).alias("changed")), "labels")
        labels = new.select("v", F.col("new").alias("label"))
        if not seen.get["changed"]:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(v, label) after further links (a, b): only links between different components are looked at, as links of labels.

    Vertices that are in no label table yet come in by their links; ``labels`` itself comes back where nothing changes.
    """
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"l{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    ends = saved(ends.where("la != lb").distinct(), "merges")
    if ends.isEmpty():
        return labels
    top = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("v").alias("label"), F.col("label").alias("top"))
    known = labels.union(ends.select("a", "la")).union(ends.select("b", "lb")).distinct()
    return saved(known.join(top, "label", "left").select("v", F.coalesce("top", "label").alias("label")), "labels")
