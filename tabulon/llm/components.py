"""Connected components of an edge table, as repeated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: So many edges make a partition: small graphs stay in few files and tasks, large ones in as many as the session's shuffles.
PARTITION_EDGES = 50_000
#: Up to so many edges a step's least neighbours, two numbers per node, are broadcast; beyond, both sides are shuffled.
BROADCAST_EDGES = 500_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges`` (u long, v long) with the smallest node it reaches.

    Returns (node, label) for the nodes that occur in an edge. Self loops, repeated and
    reversed edges are fine; rows with a null end are ignored. An empty table gives an
    empty table.

    Alternating large-star and small-star steps keep the edge count from growing and end
    after a logarithmic number of rounds. Each step is an aggregate (with map-side
    combine) and one join; each round is checkpointed. Only two numbers per round, the
    count and a checksum of the edges, reach the driver.
    """
    now = durable(
        edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    count = now.count()
    packed = lambda df: df.coalesce(max(1, -(-count // PARTITION_EDGES)))
    beside = F.broadcast if count <= BROADCAST_EDGES else lambda df: df
    now, before = packed(now), None
    for _ in range(max_rounds):
        now = durable(packed(_small_star(packed(_large_star(now, beside)), beside)))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (key := tuple(seen)) == before:
            break
        before = key
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return found.union(now.select("v", "v").distinct())


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) of several pairs of columns of each row, without reading ``rows`` once for each."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _large_star(edges: DataFrame, beside) -> DataFrame:
    """Each node's larger neighbours are moved to the smallest of its neighbourhood."""
    both = _pairs(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(beside(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, beside) -> DataFrame:
    """Each node and its smaller neighbours are moved to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(edges.join(beside(least), "u"), ("u", "m"), ("v", "m")).filter("u <> v").distinct()
