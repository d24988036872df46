"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregate (pre-aggregated on every task, so a hub costs one
row per task) and an equi-join, which the skew join can split. Every round is
written, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import stage


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "u2")
    large = both.filter("v > u").join(least, F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "u2")
    small = large.join(least, F.col("u") == F.col("u2")).select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return small.filter("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges: two columns of ids -> ``node``, ``component`` (least id reachable), for every node that has an edge."""
    u, v = F.greatest(a, b), F.least(a, b)
    now = stage(edges.filter(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        now = stage(_round(now), "edges")
        after = _print(now)
        if after == seen:
            break
        seen = after
    # a star: every node points to its root, roots point nowhere
    return stage(now.select(F.col("u").alias("node"), F.col("v").alias("component"))
                 .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
