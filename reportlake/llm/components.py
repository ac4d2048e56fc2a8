"""Connected components of a link table by Spark joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    Each round every node takes the smallest label among its own and its neighbours' and then its label's label, so the
    number of rounds grows with the logarithm of a component's diameter. Labels are summed per node before they are
    joined, so a node with very many links is no hot group.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        # hook: the old label itself learns the smaller one, so whole trees move at once
        hook = step.groupBy(F.col("old").alias("id")).agg(F.min("new").alias("hook"))
        met = step.join(hook, "id", "left").select("id", "old", F.least("new", F.coalesce("hook", "new")).alias("new"))
        met = written(met, "labels")
        jump = met.select(F.col("id").alias("new"), F.col("new").alias("further"))
        nxt = written(met.join(jump, "new", "left").select("id", "old", F.least("new", F.coalesce("further", "new")).alias("component")), "labels")
        label = nxt.select("id", "component")
        if nxt.where("component < old").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return label
