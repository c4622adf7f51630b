"""Connected components of links, by smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ziplore.session import pin


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (its smallest member) of every linked id.

    Labels start as the id itself. Each round a node takes the least label
    among its neighbours' and its own, and then that label's label, so chains
    shorten by halves. Every step is an equi-join or a grouping with partial
    minimum; the result is written each round, which cuts the lineage.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to")).filter(F.col(a) != F.col(b))
    edges = pin(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct())
    labels = pin(edges.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("component")))
    while True:
        none = F.lit(None).cast("long")
        told = edges.join(labels.withColumnRenamed("id", "to"), "to").select("id", "component", none.alias("_old"))
        own = labels.select("id", "component", F.col("component").alias("_old"))
        least = told.unionByName(own).groupBy("id").agg(F.min("component").alias("component"), F.max("_old").alias("_old"))
        further = labels.select(F.col("id").alias("component"), F.col("component").alias("_further"))
        jumped = least.join(further, "component", "left").select(
            "id", F.least("component", F.coalesce("_further", "component")).alias("component"), "_old"
        )
        after = pin(jumped)
        labels = after.select("id", "component")
        if after.filter("component != _old").isEmpty():
            return labels
