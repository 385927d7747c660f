"""Connected components of a table of links, by alternating large and small stars.

Each round re-links every node to the least node it knows of; both steps take a
minimum for each node with a map-side combine and a join, so a node with links to a
third of all others is split like any skewed join. Rounds are written to the shared
folder, which ends their lineage, and deleted when the next one is there; nothing but
two counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, materialize


def _relink(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.select("u", F.col("m").alias("v")).union(small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node that isn't itself the least of its
    component; ``component`` is that least node. The result reads a scratch table."""
    now = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links")
    while True:
        nodes = now.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if nodes["n"] == nodes["d"] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last, now = now, materialize(_relink(now), "links")
        drop_scratch(last)
