"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): the least node that it reaches. Self-edges and repeated edges do no harm.

    Large stars hang a node's larger neighbours on its least neighbour, small
    stars hang the smaller ones and the node itself there, until each node
    hangs on one that hangs on nothing. The rounds grow with the logarithm of
    the components' size; each is written to the shared folder. A node with
    very many neighbours costs one row per task in the minimum, and its join
    can be split.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).filter("child <> parent").distinct(), "edges")
    while True:
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).union(now.select(F.col("parent").alias("u"), F.col("child").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct()
        down = large.groupBy(F.col("child").alias("w")).agg(F.min("parent").alias("m"))
        small = large.join(down, F.col("child") == F.col("w")).select(F.explode(F.array(F.struct(F.col("child").alias("c"), F.col("m").alias("p")), F.struct(F.col("parent").alias("c"), F.col("m").alias("p")))).alias("e"))
        now = materialise(small.select(F.col("e.c").alias("child"), F.col("e.p").alias("parent")).filter("child <> parent").distinct(), "edges")
        hung = now.select(F.col("child").alias("w")).distinct()
        twice = now.groupBy("child").agg(F.min("parent").alias("x"), F.max("parent").alias("y")).filter("x <> y")
        if now.join(hung, F.col("parent") == F.col("w"), "left_semi").isEmpty() and twice.isEmpty():
            break
    roots = now.select(F.col("parent").alias("node")).distinct().withColumn("label", F.col("node"))
    return materialise(now.select(F.col("child").alias("node"), F.col("parent").alias("label")).union(roots), "labels")
