"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, tight

MOST_ROUNDS = 60


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    around = edges.toDF("_v", "_u").unionByName(edges.toDF("_u", "_v"))
    low = around.groupBy("_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_low"))
    return _ordered(around.filter("_v > _u").join(low, "_u").select(F.col("_low").alias("_a"), F.col("_v").alias("_b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of these."""
    low = edges.groupBy("_b").agg(F.min("_a").alias("_low"))
    smaller = edges.join(low, "_b").select(F.col("_low").alias("_a"), F.col("_a").alias("_b"))
    return _ordered(smaller.unionByName(low.select(F.col("_low").alias("_a"), "_b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(_node, _label), the label being the smallest node of the component, for every node with an edge (_a, _b).

    Lineage is cut in every round; the result is settled when a round changes nothing. A round makes no edges beyond
    those it gets, so that all rounds work in as many partitions as the edges need at first.
    """
    now, before = cut(_ordered(edges)), None
    rows = now.count()
    now = tight(now, rows)
    for _ in range(MOST_ROUNDS):
        now = tight(cut(tight(_small_star(tight(cut(tight(_large_star(now), rows)), rows)), rows)), rows)
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("_a", "_b").cast("long"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    centres = now.select(F.col("_a").alias("_node"), F.col("_a").alias("_label")).distinct()
    return cut(now.select(F.col("_b").alias("_node"), F.col("_a").alias("_label")).unionByName(centres))
