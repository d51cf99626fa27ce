"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import via_table


def components(links: DataFrame) -> DataFrame:
    """``node, label`` with the smallest node of each component, for the nodes in ``links`` (``a, b``).

    Every round gives a node the smallest label among its neighbours and then
    the label of that label, so labels travel twice as far each time. Hubs are
    summed before the shuffle; each round is a written table, so a lost
    executor costs one round at most.
    """
    both = via_table(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    state = via_table(both.groupBy("a").agg(F.min("b").alias("near")).select(
        F.col("a").alias("node"), F.least("a", "near").alias("label")), "labels")
    if state.isEmpty():
        return state
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("near"))
        met = state.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        far = state.select(F.col("node").alias("label"), F.col("label").alias("far"))
        state = via_table(met.join(far, "label", "left").select(
            "node", F.least("label", F.coalesce("far", "label")).alias("label"),
            (F.least("label", F.coalesce("far", "label")) != F.col("old")).alias("changed")), "labels")
        if state.filter("changed").isEmpty():
            return state.select("node", "label")
        state = state.select("node", "label")
