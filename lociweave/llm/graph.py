"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst) -> (node, component), component the smallest node reached.

    Alternating large-star and small-star rounds: every round hangs neighbours
    on the least node they know, so the depth falls by a factor each time, and
    a node of huge degree costs its edges once a round. Rounds go on until no
    tree is deeper than a star (some log squared of the longest path), and end
    in a table in the shared folder. Neighbour lists are never collected: minima come from
    a partial aggregate, and hot nodes from a join that AQE can split.

    Loops and repeated or null edges are ignored; a node without edges does not
    appear; an empty table gives an empty table.
    """
    e = (
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = cut(e, "edges")
    while True:
        # A forest of stars: nothing that hangs on a node has something hanging on it.
        deep = e.select(F.col("v").alias("u")).distinct().join(e, "u", "left_semi")
        multi = e.groupBy("u").count().where("count > 1").select("u")
        if deep.unionByName(multi).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small, "edges")
