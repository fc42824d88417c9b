"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialize

#: Edges a file of a round holds, about 4 MB: a table of few edges is not spread over all shuffle partitions.
FILE_EDGES = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u > v. Large star: each node links its larger neighbours to its least neighbour (or itself).
    Small star: each node links its smaller neighbours and itself to the least of them. The least one is an
    aggregate and comes back by a join, so no neighbourhood is ever collected."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(u, v) with u <> v: root is the least node that it reaches."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")
    edges, mark = materialize(edges), None
    files = max(1, -(-edges.count() // FILE_EDGES))  # no star has more edges than it was given
    while True:  # ends: each round lowers some node's root or changes nothing, and usually takes a few rounds
        edges = materialize(_star(_star(edges, True), False).coalesce(files))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
