"""Distributed union-find: connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a, b), longs; component is the smallest node reachable.

    Each round is two joins on node keys, which Spark may split when one node has many edges, and writes its edges to
    the shared folder. Neither side is broadcast: in memory it is many times the size of its files. The driver sees only
    a count and a checksum a round. Loops (a = b) and repeated edges are harmless; null ends are dropped; no edges give
    no rows.
    """
    start = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    loops = start.where("a = b").select("a").distinct()
    now = materialize(start.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while state[0]:
        after = materialize(_small_star(_large_star(now).distinct()), name)
        new = _state(after)
        discard(now)
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("b").alias("node")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    alone = loops.select(F.col("a").alias("node")).join(out.select("node").hint("merge"), "node", "left_anti")
    return out.union(alone.select("node", F.col("node").alias("component")))
