"""Connected components of a table of edges, by contraction.

In each round every vertex points at the least vertex among itself and its neighbours, and both ends of every edge are replaced by
what they point at. Vertices are compared by xxhash64 of their id, which maps 64-bit integers one to one, so the
expected number of vertices falls by a constant factor in each round whatever the ids; the rounds needed are
logarithmic. Edges and pointers stay in staged tables; the driver sees only counts of rows. A vertex with very many neighbours is
pre-aggregated (a minimum) and otherwise only a skewed side of an equi-join, which Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: a, b (64-bit integers). Returns id, label for every id on an edge between two different ids: equal labels
    just where ids are connected. Null ends and loops are passed over; repeated edges count once. An empty
    table gives an empty one."""
    edges = edges.where("a <> b")  # neither end is null then
    keys = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    ids = edges.select("a").union(edges.select("b")).distinct()
    now = staged(ordered(keys), f"{name}-edges")
    pointers: list[DataFrame] = []
    while not now.isEmpty():
        both = now.select("a", "b").union(now.select("b", "a"))
        point = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), f"{name}-points")
        pointers.append(point)
        left, right = point.select("a", F.col("m").alias("ma")), point.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        moved = now.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).where("a <> b")
        following = staged(ordered(moved), f"{name}-edges")
        unstage(now)
        now = following
    unstage(now)
    if not pointers:  # no edge: nothing here reads the given tables again, which may be deleted now
        return edges.sparkSession.createDataFrame([], "id long, label long")

    def through(later: DataFrame, earlier: DataFrame) -> DataFrame:
        on = later.select(F.col("a").alias("m"), F.col("m").alias("__m"))
        return earlier.join(on.hint("merge"), "m", "left").select("a", F.coalesce("__m", "m").alias("m"))

    last = reduce(through, reversed(pointers))
    out = staged(ids.select(F.col("a").alias("id"), F.xxhash64("a").alias("a")).join(last.hint("merge"), "a").select("id", F.col("m").alias("label")), f"{name}-labels")
    unstage(*pointers)
    return out


def ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
