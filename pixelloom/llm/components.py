"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import common
from pixelloom.llm.common import settled, staged


def _neighbours_to_least(edges: DataFrame, larger_only: bool, few: bool) -> DataFrame:
    """Links every neighbour of u (only those above u, if so) to the least of u and its neighbours.

    A node with very many neighbours is no hot key: the least ones are broadcast where there are ``few`` edges,
    else they are a table of their own, and the join of two written tables is split where it is skewed.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = F.broadcast(least) if few else staged(least, "least")
    met = edges.join(least, "u")
    if larger_only:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); a component is named by its least node.

    Each round is written to the shared folder, so that plans stay short and lost executors
    cost one round; the round before is removed. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession

    def turn(now: DataFrame, few: bool) -> DataFrame:
        # Few edges, by their count, are one partition, which needs no shuffle.
        held = lambda df, tag: df.coalesce(1) if few else staged(df, tag)
        both = held(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = held(_neighbours_to_least(both, True, few).where("u != v").distinct(), "large")
        now = _neighbours_to_least(large, False, few).where("u != v")
        return (now.coalesce(1) if few else now).distinct()

    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state, count = None, now.count()
    while True:
        # A round never has more links than three times those before.
        now = settled(spark, lambda before=now, few=6 * count <= common.BROADCAST_ROWS: turn(before, few), "edges")
        one = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(one) == state:
            break
        state, count = tuple(one), one[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
