"""Connected components of a graph that may be larger than any machine: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp) for each vertex of links; comp is the smallest vertex that v reaches.

    Every round takes the least label among a vertex's neighbours, then the label of that label. Labels only fall,
    and the rounds end when none does; a star ends after two. Links may repeat, point at themselves or be none at all.
    Each round is written to the shared folder, so neither the plan nor the driver grows with the graph.
    """
    both = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).distinct(), "links")
    labels = staged(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "comp"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        over = labels.select(F.col("v").alias("low"), F.col("comp").alias("jump"))
        step = staged(lower.join(over, "low", "left").select("v", F.least("low", F.coalesce("jump", "low")).alias("comp"), (F.col("was") > F.least("low", F.coalesce("jump", "low"))).alias("fell")), "labels")
        labels = step.select("v", "comp")
        if step.filter("fell").isEmpty():
            return labels


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """(v, comp) of found (v, comp) after further links (a, b): only links between different components of it go round again.

    As a component's label is its smallest vertex, the smallest label that it reaches is the smallest vertex.
    """
    one, two = found.select(F.col("v").alias("a"), F.col("comp").alias("ca")), found.select(F.col("v").alias("b"), F.col("comp").alias("cb"))
    ends = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = staged(ends.filter("a <> b").distinct(), "links")
    if between.isEmpty():
        return found
    more = components(between).select(F.col("v").alias("comp"), F.col("comp").alias("low"))
    fresh = more.select(F.col("comp").alias("v")).join(found, "v", "left_anti").select("v", F.col("v").alias("comp"))
    return staged(found.unionByName(fresh).join(more, "comp", "left").select("v", F.coalesce("low", "comp").alias("comp")), "labels")
