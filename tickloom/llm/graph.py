"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``, longs); the component is its smallest node.

    Large star and small star in turn: every node's neighbours are linked to the smallest node known to it, until each
    edge leads from a node to its component's smallest. Neither step gathers a node's neighbours: the minimum is an
    aggregate, which combines before the shuffle, and it returns by a join. Every round is a table in the shared folder,
    so lineage stays short and a lost executor costs one round at most. A table without edges has no nodes.
    """
    now = written(_undirected(edges), f"{name}-edges")
    before = None
    while (mark := _checksum(now)) != before:
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = written(_star(_star(both, larger_only=True), larger_only=False), f"{name}-round")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)


def _checksum(edges: DataFrame) -> tuple:
    """Number of edges and two sums over them: equal tables have equal ones."""
    one, two = F.xxhash64("a", "b"), F.hash("a", "b").cast("long")
    return tuple(edges.agg(F.count("*"), F.bit_xor(one), F.sum(two)).first())


def _undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link each node's neighbours to the smallest among them and the node; the large star only its larger neighbours.

    Edges come back from the larger to the smaller node. The large star takes each edge in both directions, the small
    star from the larger to the smaller node only.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    out = (joined.where("b > a") if larger_only else joined).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()
