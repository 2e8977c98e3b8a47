"""Connected components as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a long, b long); component
    is the smallest id reachable.

    Each round takes the smallest label among a vertex's neighbours and then the
    label of its label, so paths shorten by more than half per round. Every round
    is written to the shared folder; only a count of changed rows comes back.
    Self loops and repeated edges are allowed; an empty input gives no rows.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .where("a <> b").distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("a").alias("id"))
                 .agg(F.least(F.col("a"), F.min("b")).alias("component")), "cc-labels")
    for _ in range(max_rounds):
        near = (both.join(labels, both.b == labels.id)
                .groupBy("a").agg(F.min("component").alias("near")))
        step = labels.join(near, labels.id == near.a, "left").select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        step = cut(step, "cc-step")
        up = step.select(F.col("id").alias("of"), F.col("component").alias("up"))
        labels = cut(step.join(up, step.component == up.of, "left").select(
            "id", F.least("component", "up").alias("component"), "was"), "cc-labels")
        if labels.where("component <> was").limit(1).count() == 0:
            break
        labels = labels.select("id", "component")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.select("id", "component")
