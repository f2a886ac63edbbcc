"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """The smallest id that each linked id can reach: ``node``, ``component``.

    Each round takes the least label of the neighbours and then the label of that label, so chains shrink
    by a factor each time. Labels are written each round and no link or label leaves the executors. Links
    with a null end are ignored; repeated links and links of an id to itself change nothing; an empty
    table gives an empty result.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("near")).filter("node IS NOT NULL AND near IS NOT NULL")
    edges = written(pairs.unionByName(pairs.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "edges")
    labels = written(edges.groupBy("node").agg(F.least("node", F.min("near")).alias("component")), "labels")
    for _ in range(rounds):
        near = labels.select(F.col("node").alias("near"), F.col("component").alias("near_label"))
        least = edges.join(near, "near").groupBy("node").agg(F.min("near_label").alias("least"))
        step = labels.join(least, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        step = step.join(jump, "via", "left").select("node", "old", F.least("via", "root").alias("component"))
        step = written(step, "labels")
        discard(labels)
        labels = step
        if step.filter("old <> component").isEmpty():
            discard(edges)
            return labels.select("node", "component")
    raise RuntimeError("components did not settle")
