"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: each node of an edge table ``a, b`` and the smallest node it reaches.

    Union-find by alternating large and small stars: in turn every node hands
    its larger neighbours, then its smaller ones, to its smallest neighbour,
    until each node hangs on its root. All steps are joins with per-node
    minima, which are combined before they move; the hot node of a star is a
    join key that can be split. Loops are ignored, NULL ends too.
    """
    links = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        both = links.select("hi", "lo").union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("hi", "m").alias("m"))
        large = (links.join(least, links["lo"] == least["u"]).select("hi", F.col("m").alias("lo"))).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least.withColumnRenamed("hi", "u"), F.col("hi") == F.col("u"))
        new = stage(small.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")),
                                                   F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
                    .select("e.*").filter("hi <> lo").distinct())
        total, children = new.agg(F.count(F.lit(1)), F.countDistinct("hi")).first()
        # a star forest: one parent each, and no parent is a child
        if total == children and new.join(new.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").count() == 0:
            roots = new.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return stage(new.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots))
        links = new
