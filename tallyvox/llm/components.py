"""Connected components of a link table, as joins that never gather a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b: bigint).

    Each round gives a node the smallest label of itself and its neighbours and then
    that label's own label, so labels cross a chain of n links in about log(n) rounds. Each
    round is written to the shared folder. No links give no rows.
    """
    spark = links.sparkSession
    edges = written(spark, links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(spark, edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(spark, lower.join(jump, "component").select("node", "old", F.least("component", "next").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
