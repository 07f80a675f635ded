"""Connected components of a graph that is larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (``a, b``); the label is the smallest node it reaches.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its smallest one,
    then its smaller neighbours.  Only minima are gathered, so a node of any degree is no single task.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now, seen = written(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(handed.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
