"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and two joins over the links, written to the shared folder before the next
round; the number of rounds grows with the logarithm of the longest path.  A star's centre has as many rows
as the star: aggregation combines them on the map side, and the centres of large stars, of which a bound on their
share leaves few, come to the rows by a broadcast.

Defined cases: links have no direction; repeated links, links of a node to itself and links with a null end add
nothing; a node without links isn't named; no links give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, join_groups, materialise


def _star(links: DataFrame, large: bool, n: int) -> DataFrame:
    """``links``: ``n`` of (a, b) with a > b.  Hangs each node's neighbours below the smallest of them."""
    back = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(back)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).withColumn("m", F.least("m", "u"))
    moved = join_groups(both, least, "u", "size", total=2 * n if large else n)
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link; the root is the component's smallest node."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = materialise(pairs, "links")
    state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    while True:
        # the first star has as many links at most
        nxt = materialise(_star(_star(now, True, state["n"]), False, state["n"]), "links")
        after = nxt.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        discard(now)
        now = nxt
        if after == state:
            break
        state = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
