"""Connected components of a graph held as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settled, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each end of ``edges`` (a, b) the least node it is connected with.

    Each round is two aggregations by node, and joins with their results, of the
    edges left, which are stars in the end; the number of rounds grows with the
    logarithm of the longest path. A star's edges stay apart rows, so that a hub of
    any degree is a skewed join and no large row. A node without an edge isn't listed.
    """
    return settled(lambda: _rounds(edges), "components")


def _rounds(edges: DataFrame) -> DataFrame:
    now = edges.select("a", "b").filter("a <> b")
    now = written(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        # large star: each node's larger neighbours go to the least of its neighbours and itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.filter("v > u").join(hubs, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        # small star: each node's smaller neighbours, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "edges")
        # two equal sums of mixed edges: nothing has changed
        total = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if total == seen:
            break
        seen = total
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
