"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that links reach; nodes without links are left out.

    Large stars and small stars in turn: every node ties its larger neighbours,
    then its smaller ones, to the least it knows.  The rounds grow with
    the logarithm of the longest path.  Each round is written to the shared folder, so a lost
    executor costs one round, and only sums of it come to the driver.
    """
    edges = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u != v").distinct()
        tied = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(tied, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u != v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select("u", "u").distinct())
        before = now
