"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopatch.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """Labels every node of ``edges(a, b)`` with the smallest node it reaches.

    Returns ``node, root``; an empty edge table gives an empty result.  Each
    round takes the least label among the neighbours (an aggregation with a
    map-side combine, so that a node with a great many edges is not gathered
    in one task) and then jumps from each label to that label's own label,
    which doubles the reach.  Lineage is cut in every round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        nearer = labels.join(heard, "node").select("node", F.least("root", "least").alias("mid"), F.col("root").alias("before"))
        onward = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = cut(nearer.join(onward, "mid").select("node", F.least("mid", "far").alias("root"), "before"))
        labels = step.select("node", "root")
        if step.where("root != before").isEmpty():
            return labels
