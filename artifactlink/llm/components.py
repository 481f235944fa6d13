"""Connected components of an edge table by hooking and shortcutting, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.common import materialize


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(a, b) -> (v, c): every vertex of an edge, and the smallest vertex that it reaches. Links are symmetric.

    A round takes the smallest label among a vertex and its neighbours, then that label's own label; labels halve their
    distance to the smallest each round, and the loop ends when none changes."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("c").alias("near"))
        hooked = labels.join(near, labels.v == near.a).select("v", F.least("c", "near").alias("h"), F.col("c").alias("old"))
        jump = labels.select(F.col("v").alias("at"), F.col("c").alias("next"))
        new = materialize(hooked.join(jump, hooked.h == jump["at"]).select("v", F.least("h", "next").alias("c"), "old"), "labels")
        if new.where("c <> old").isEmpty():
            return new.select("v", "c")
        labels = new.select("v", "c")
    raise RuntimeError(f"components: labels still change after {rounds} rounds")
