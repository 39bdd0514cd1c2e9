"""Connected components of a large undirected graph by alternating large-star
and small-star rounds. Every round is two joins and two grouped minima; no
vertex list, edge list or component ever reaches the driver or one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge that is not the smallest of
    its component; ``root`` is that smallest node. Nulls and loops are no
    edges; repeated edges count once; no edges give an empty table.

    A round's tables are written to the shared checkpoint folder, so lineage
    does not grow. Both sides of each join are written tables: a node with
    very many neighbours is a skewed join key, which adaptive execution
    splits. The number of rounds is logarithmic in the number of nodes."""
    e = edges.filter(F.col(a) != F.col(b))
    e = stage_table(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "edges")
        large = stage_table(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .distinct(), "edges")
        low = stage_table(large.groupBy("u").agg(F.min("v").alias("m")), "edges")
        e = stage_table(large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
