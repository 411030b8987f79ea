"""Connected components by alternating large-star and small-star steps on edge tables; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import persisted, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Self edges, repeated edges and edges with a null end are ignored; an empty edge table gives an empty result.
    A star's centre may have any number of neighbours: minima are pre-aggregated, and the joins back are plain
    equi-joins, which adaptive execution splits where skewed.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))
    )
    e = persisted(e.distinct(), "cc")
    seen = _mark(e)
    for _ in range(max_rounds if seen[0] else 0):
        before, e = e, persisted(_small_star(_large_star(e)), "cc")
        mark = _mark(e)
        release(before)
        if mark == seen:
            break
        seen = mark
    else:
        if seen[0]:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _mark(e: DataFrame):
    """Row count and order-free checksum, to see that a round changed nothing."""
    return e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return both.where("v > u").join(m, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours to the smallest of them."""
    m = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(m, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
    return moved.unionByName(m.select("hi", F.col("m").alias("lo"))).distinct()
