"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for each id that has an edge; component_id is the smallest id that it is connected with.

    Alternating large-star and small-star rounds: each round points nodes at the smallest neighbour, first the
    larger ones, then the smaller ones, until nothing changes.  Minima are pre-aggregated before they are shuffled, and a
    node with very many neighbours is the larger side of joins whose other side has it once.
    Edges with a null end and loops are left out; repeated edges count once.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = staged(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u, v).where("u != v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = staged(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        after = staged(small.distinct(), "edges")
        discard(edges)
        discard(large)
        state = _state(after)
        edges = after
        if state == before:
            break
        before = state
    own = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    return own.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()).groupBy("id").agg(F.min("component_id").alias("component_id"))
