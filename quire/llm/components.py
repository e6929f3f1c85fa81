"""Connected components of an edge table, by alternating star operations.

A large star links the larger neighbours of each node to its smallest one, a
small star does so with the smaller neighbours; both keep connectivity, and
once all edges point at nodes that point nowhere, those are the smallest of their
components. All steps are a minimum per node (combined before the shuffle) and a join back, so
a node with very many edges is never gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import last_stays, saved


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _stars(e: DataFrame) -> bool:
    """Whether every node of ``e`` has one edge (u, v), or only edges to it."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        e.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    nodes = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.agg(F.coalesce(F.max((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))), F.lit(False))).first()[0] is False


@last_stays
def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (u long, v long) that has an edge
    to another node; root is the smallest id of its component."""
    tidy = lambda e: e.where("u <> v").distinct()
    e = saved(tidy(edges.where("u is not null and v is not null").select("u", "v")), "cc-0")
    while True:
        e = saved(tidy(_small(_large(e))), "cc")
        if _stars(e):
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
