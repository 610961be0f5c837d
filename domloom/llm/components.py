"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links`` (``a, b``); the component is its smallest id.

    Each round every id takes the smallest label among itself and its neighbours, then the
    label of that label, so paths shorten by doubling. Each round is written once; minima are
    partial sums of a kind, and a hub of any degree joins under adaptive skew splitting.
    """
    both = checkpointed(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    )
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("near")).select(
        F.col("a").alias("id"), F.least("a", "near").alias("component")
    ))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), ["b"]).groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near"))
        lowered = checkpointed(labels.join(near, ["id"]).select(
            "id", F.least("component", "near").alias("component"), F.col("component").alias("old")
        ))
        jump = lowered.select(F.col("id").alias("component"), F.col("component").alias("further"))
        stepped = checkpointed(lowered.join(jump, ["component"], "left").select(
            "id", F.coalesce("further", "component").alias("component"), "old"
        ))
        if stepped.where("component <> old").isEmpty():
            return labels
        labels = stepped.select("id", "component")
