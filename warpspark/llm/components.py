"""Connected components of an edge table, in rounds of joins on the executors; no edge reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

_MAX_ROUNDS = 60
_ROWS = 100_000  # edges of a checkpoint's file, about


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the edges: alike in two rounds only if nothing changed."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: each larger neighbour of a node goes to the least node around it. Small star: so does each
    smaller neighbour, and the node itself. Only minima are grouped, so a node with any number of neighbours is
    summed before the shuffle, and the join deals out a crowded node's rows anew if need be."""
    if larger:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of an edge can reach. edges: (a long, b long), in any
    order, repeated or not; loops are left out, so ids without another neighbour have no row.

    Alternates large and small stars until nothing changes (a logarithmic number of rounds). Each round is
    written to the checkpoint folder, so lineage stays short and a lost executor costs one round at most.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter(F.col("a") != F.col("b"))
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before, most = None, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(_MAX_ROUNDS):
        state = _state(now)
        if state == before or state[0] == 0:
            break
        before = state
        # The number of edges doesn't rise, so few edges are few files.
        now = _star(_star(now, True), False).coalesce(min(most, 1 + state[0] // _ROWS)).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return found.unionByName(roots)
