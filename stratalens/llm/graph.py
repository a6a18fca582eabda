"""Connected components over edge tables, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, label): label is the smallest node reachable. edges: columns a and b, in any direction, repeats allowed.

    In each round a node takes the smallest label among its neighbours', then the label of its label. Labels are
    written to the shared folder after each round. Minima are taken before rows are shuffled; the joins are plain
    equi-joins, which adaptive execution splits where one node has very many neighbours.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = ws.save(both, "edges")
    labels = ws.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "m").alias("next"))
        step = ws.save(step, f"step-{turn}")
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        new = step.join(jump, F.col("next") == F.col("at"), "left").select("node", F.coalesce("beyond", "next").alias("label"), (F.coalesce("beyond", "next") != F.col("label")).alias("moved"))
        new = ws.save(new, f"labels-{turn}")
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "label")
        ws.drop(f"labels-{turn - 1}", f"step-{turn}")
        if not moved:
            return labels
