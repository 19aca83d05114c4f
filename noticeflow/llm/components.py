"""Connected components of a table of links."""

from pyspark.sql import functions as F

from noticeflow.llm.common import stage


def components(links):
    """`node`, `label` for every node of links (`a`, `b`): nodes are connected exactly if their labels, the least node, are equal.

    Labels spread over links and then jump to the label of the label, so the rounds grow with the
    logarithm of the longest path.  Every round is written: a lost executor costs one round at most,
    and joins are between plain tables, so that a node with very many links is split.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = stage(both)
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        far = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("far")), "b")
        best = stage(far.groupBy("a").agg(F.min("far").alias("far")))
        near = stage(
            labels.join(best, labels["node"] == best["a"]).select("node", "label", F.least("label", "far").alias("next"))
        )
        jump = near.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        labels = stage(near.join(jump, "next").select("node", F.least("next", "jumped").alias("label"), (F.col("label") != F.least("next", "jumped")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")
