"""Connected components of a graph given by edges, in rounds that end when no label changes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node on an edge.

    Alternates large-star and small-star steps: every node hangs its larger neighbours, then all but the smallest of
    its smaller ones, below the smallest neighbour. Each step is one aggregate with map-side combine and one join; a
    node that many share stays a key of small rows. Rounds fall with the logarithm of the longest chain.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        # settled when every left node hangs below one node that hangs below none
        tops = after.select(F.col("v").alias("u")).distinct()
        open_nodes = after.join(tops, "u", "left_semi").limit(1).count()
        double = after.groupBy("u").count().where("count > 1").limit(1).count() if not open_nodes else 1
        now = after
        if not open_nodes and not double:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
