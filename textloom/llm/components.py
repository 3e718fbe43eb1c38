"""Connected components over links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, with_groups


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    """Link every neighbour of u (the larger ones, or the smaller ones) to the least of u and its neighbours.

    The links of a node with very many are not brought together: its least neighbour is sent to where they are.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("links")), name)
    joined = with_groups(both, least, ["u"], "links")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of ``links`` (u, v); component is the least node reachable.

    Each round is written to the shared folder, so lineage stays short. The number of rounds grows with the logarithm
    of the longest chain; the driver sees only a count and a checksum of each round.
    """
    edges = scratch.table(links.filter("u <> v").select("u", "v").distinct(), "links0")
    seen = None
    for k in range(1, most_rounds + 1):
        wider = scratch.table(_star(edges, True, scratch, "least"), "wider")
        edges = scratch.table(_star(wider, False, scratch, "least"), f"links{k}")
        scratch.drop(f"links{k - 1}", "wider", "least")
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
