"""Connected components of a link table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import discard, stored


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of links(a long, b long), by randomised contraction.

    Each round hashes nodes anew, merges every node into its neighbour of smallest hash if that is smaller than its own, and
    relabels the links; a constant share of the nodes goes per round, so rounds grow with the logarithm of the largest
    component, whatever its shape. Every round is written to the shared folder, and deleted when the next one stands. Neighbours meet only in a minimum, which is
    pre-aggregated, and relabelling joins stored tables, which AQE can split, so hubs are harmless. Rows with a null end and
    self links are ignored. The root is some node of the component.
    """
    now = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, merged, r = stored(now, "links"), [], 0
    while not now.isEmpty():
        r += 1
        h = lambda c: F.xxhash64(F.lit(r), c)  # noqa: E731, B023
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min_by("b", h("b")).alias("b"))
        up = stored(best.select(F.col("a").alias("node"), F.when(h("b") < h("a"), F.col("b")).otherwise(F.col("a")).alias("up")), "contract")
        merged.append(up)
        via = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: E731, B023
        half = now.join(via("a"), "a").select("b", "a_up")
        half = half.join(via("b"), "b").select("a_up", "b_up").where("a_up <> b_up")
        before, now = now, stored(half.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
        discard(before)
    if not merged:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots, last = merged[-1].withColumnRenamed("up", "root"), merged[-1]
    for up in reversed(merged[:-1]):
        later = roots.withColumnRenamed("node", "up").withColumnRenamed("root", "later")
        before, roots = roots, stored(up.join(later, "up", "left").select("node", F.coalesce("later", "up").alias("root")), "roots")
        discard(before, last, up)
    return roots
