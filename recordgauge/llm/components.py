"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.plans.scratch import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that is no root; root is the component's smallest node.

    ``links`` has two bigint columns. Every round is written to the shared folder, so that the
    plan stays short and a lost executor costs one round at most. The number of rounds grows
    with the logarithm of the longest path; the rounds are compared by two sums over the edges,
    which is all that reaches the driver.
    """
    spark = links.sparkSession
    a, b = links.columns
    edges, path = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(),
        "components",
    )
    seen = None
    while True:
        summary = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
        ).first()
        if (summary.n, summary.x) == seen or not summary.n:
            break
        seen = (summary.n, summary.x)
        before = path
        edges, path = staged(_small_star(_large_star(edges).distinct()).distinct(), "components")
        discard(spark, before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
