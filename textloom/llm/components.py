"""Connected components of a large sparse graph as a loop of small joins.

Every round, each component takes the smallest label next to any of its nodes (hooking), then
labels are shortened by looking up the label of the label. The tables are written to the shared
folder each round, so no plan grows and a lost executor costs one round at most; the tables of finished rounds
are deleted. Nothing but the news that labels moved reaches the driver. Labels shared by many nodes are joined with ``attach``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import attach, discard, stage
from textloom.operators.skew import crowded, join_back

#: Edges of one node that a task may get.
SHARE = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long, undirected, repeats and loops allowed); label is the component's smallest node.

    Give a star or chain for a group, not all of its pairs; the edges of a star's centre are dealt over many tasks.
    No edges give no rows. Raises if ``rounds`` rounds don't suffice, rather than return too fine a partition.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = stage(both, "cc-edges")
    heavy = stage(crowded(both, "b", SHARE), "cc-crowded")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "cc-labels")
    for k in range(rounds):
        near = join_back(both, labels.withColumnRenamed("node", "b"), "b", spread=F.col("a"), share=SHARE, heavy=heavy)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hook = labels.join(near, "node").groupBy("label").agg(F.min("near").alias("near"), F.count("*").alias("n"))
        hook = stage(hook.select("label", F.least("label", "near").alias("next"), "n"), f"cc-hook{k}")
        if hook.filter("next < label").isEmpty():
            discard(both, hook, heavy)
            return labels
        # two look-ups shorten chains of hooks: label -> next -> next
        for _ in range(2):
            sizes = hook.groupBy("next").agg(F.count("*").alias("m"))
            to = stage(hook.select(F.col("label").alias("next"), F.col("next").alias("after")).join(sizes, "next"), f"cc-to{k}")
            step = attach(hook, to, ["next"], "m", F.col("label"))
            shorter = stage(step.select("label", F.coalesce("after", "next").alias("next"), "n"), f"cc-hook{k}")
            discard(hook, to)
            hook = shorter
        moved = stage(attach(labels, hook, ["label"], "n", F.col("node")).select("node", F.coalesce("next", "label").alias("label")), f"cc-labels{k + 1}")
        discard(labels, hook)
        labels = moved
    raise RuntimeError(f"components did not settle in {rounds} rounds")
