"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize, scratch


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for each node with an edge to another; root is the least node reachable.

    Each round joins the edges with one minimum per node, which is aggregated
    before the shuffle; a hot node's edges are dealt anew by AQE's skew join.
    Rounds are written to the shared folder; nothing is collected but two counts.
    Nulls and loops are dropped; an empty table gives an empty result.
    """
    with scratch(edges.sparkSession) as made:
        e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
        e, at = materialize(e, "edges")
        while True:
            # large star: neighbours above a node point to the least of its neighbourhood
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large, at_large = materialize(large, "edges")
            # small star: the neighbours below a node point to the least of them
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (
                large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
            )
            small, at_small = materialize(small, "edges")
            delete(e.sparkSession, at)
            delete(e.sparkSession, at_large)
            e, at = small, at_small
            # ended when each node has one parent and no parent is itself a child
            twice = e.groupBy("u").count().where("count > 1").limit(1).count()
            if not twice and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
                found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
                found = found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
                return made.keep(found, "components")
