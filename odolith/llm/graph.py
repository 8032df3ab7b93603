"""Connected components by alternating large-star and small-star steps, and joins that no frequent key can slow down.

Nulls and edges: edges with a null end or two equal ends join nothing; repeated edges count once; without edges there
are no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolith.session import cut

#: A key with more than this share of all rows is frequent, so there are fewer than 1 / FREQUENT such keys, at any size.
FREQUENT = 1 / 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key and in `rows_of_key` how many rows of left (`total` in all) have it.

    Frequent keys, of which right has fewer than 1 / FREQUENT rows, are broadcast, so their rows stay where they are;
    all other rows are shuffled by key. `rows_of_key` is not in the result.
    """
    often = F.col("rows_of_key") > max(1, total * FREQUENT)
    hot, rest = right.filter(often).drop("rows_of_key"), right.filter(~often).drop("rows_of_key")
    columns = [*left.columns, *(c for c in rest.columns if c != key)]
    stays = left.join(F.broadcast(hot), key).select(*columns)
    moves = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how).select(*columns)
    return stays.unionByName(moves)


def star_step(edges: DataFrame, n: int, small: bool) -> DataFrame:
    """edges (a > b), n of them. Large star: each node's larger neighbours are tied to its least neighbour or itself; small star: its smaller ones and itself."""
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows_of_key"))
        tied = spread_join(edges, least, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # a node without larger neighbours ties nothing
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("rows_of_key")).filter("rows_of_key > 0")
        larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        tied = spread_join(larger, least, "u", n).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return tied.filter("a > b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least node reachable) for every node of edges (a, b) that is not a root itself.

    Each round is written to the shared folder, so a lost executor costs one round at most. Ends when a round changes nothing.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        large = cut(star_step(now, seen[0], small=False), name)
        now = cut(star_step(large, large.count(), small=True), name)
