"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpoint

#: links within which the least neighbours are broadcast; more are joined by shuffle
BROADCAST_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(id, component): each id in links (a, b) with the smallest id that it reaches.

    Each round points every neighbour at the smallest one it shares (large star:
    the larger neighbours; small star: the others), as grouped minima and joins on
    an id, so that a hub's links are spread by the skew join.  It ends when a round
    changes nothing; ids and links stay distributed.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while mark != (now := _mark(edges)):
        mark = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(by_size(least, 2 * now[0], BROADCAST_LINKS), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(by_size(low, now[0], BROADCAST_LINKS), "a")
        edges = checkpoint(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                           .unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
