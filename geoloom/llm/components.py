"""Connected components of a graph of undirected edges, as alternating star contractions of DataFrames.

Each round points every vertex's neighbours at the smallest one known, first the larger neighbours of all vertices,
then the smaller ones. It ends when every component is a star around its smallest vertex, after a number of rounds
that grows with the logarithm of the longest path. Minima are combined before they are shuffled, and the joins can
split a vertex with very many edges, so no group of neighbours is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow import Stash


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v, no repeats."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).withColumn("m", F.least("u", "m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = _smallest(large)
    joined = large.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, stash: Stash, name: str = "components") -> DataFrame:
    """(vertex, component) for every vertex of edges (a, b): the smallest vertex that can be reached.

    Self-loops, repeated edges and either direction may occur; rows with a null end are no edges.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stash.keep(now, f"{name}-0")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, k = mark(now), 0
    while before[0]:
        k += 1
        now = stash.keep(_round(now), f"{name}-{k}")
        stash.drop(f"{name}-{k - 1}")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
