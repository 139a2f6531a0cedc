"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Links per task. Links are rows of two ids, so few tasks do; the number
#: follows the links, whatever number of shuffle partitions the session has.
LINKS_PER_TASK = 50_000
LEAST_TASKS = 8


def _state(edges: DataFrame) -> tuple:
    """Number and 128-bit fingerprint of a set of links."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (smallest node of its component) for every node that has a
    link; ``links`` has columns a, b of one orderable type."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .filter("a != b").distinct())
    state = _state(edges)
    tasks = max(LEAST_TASKS, -(-state[0] // LINKS_PER_TASK))
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # each larger neighbour to the smallest one, then all to the smallest of theirs
        large = scratch.save(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = scratch.save(small.select("e.*").filter("a != b").coalesce(tasks).distinct().coalesce(tasks))
        scratch.drop(edges, large)
        edges, before, state = new, state, _state(new)
        if state == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
