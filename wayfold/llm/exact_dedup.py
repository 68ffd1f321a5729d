"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

1. Every text is normalised (each run of white space becomes one space) and digested with SHA-256.
2. A Misra-Gries summary of the digests finds those that may be frequent. Spark's
   ``approx_top_k`` is such a summary (counters that are decremented together once they
   are all in use, merged over tasks); its size is a constant, and all its counters are asked for.
3. The candidates' exact counts and smallest ids are then computed with map-side
   aggregation; the verified winners, at most ``counters`` rows, are broadcast.
   Losers of frequent digests leave in the map task and are never shuffled.
4. What remains (rare digests, and the winner rows) is shuffled by digest. A digest without a counter
   has at most as many copies as the summary's error allows, 3.5 rows / counters, which bounds the largest group.

All of this works on (id, digest); ``keep_first`` then drops the losers from the rows themselves, which stay
where they are if the losers are few enough to be broadcast (``BROADCAST_LOSERS``), and else are shuffled once.

Defined cases: a null text counts as empty; of repeated rows with the same id and text one
stays; null ids come last, so that a row with a null id stays only if its whole group has none.
An empty table gives an empty result; very long texts are digested whole. Columns of the input never clash
with the operator's own: rows travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import SPACE, broadcast_if_small, cut, text_or_empty

#: Counters of the summary that finds frequent digests.
COUNTERS = 8192
#: Pairs of id and digest up to which the rows to drop are broadcast.
BROADCAST_LOSERS = 200_000


def text_digest(text_col: str = "text") -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE, " "), 256)


def _winners(keys: DataFrame, heavy_digests: int | None, counters: int) -> DataFrame:
    """Digest, smallest id and exact count of the frequent digests: at most ``heavy_digests`` rows, all of the summary if None."""
    candidates = (
        keys.agg(F.expr(f"approx_top_k(_digest, {heavy_digests or counters}, {counters})").alias("_top"))
        .select(F.explode("_top").alias("_item"))
        .select(F.col("_item.item").alias("_digest"))
    )
    return (
        keys.join(F.broadcast(candidates), "_digest", "left_semi")
        .groupBy("_digest")
        .agg(F.min("_id").alias("_heavy_keep"), F.count("*").alias("_heavy_size"))
        .filter("_heavy_size > 1")
    )


def _decide(keys: DataFrame, heavy_digests: int | None, counters: int) -> DataFrame:
    """``keys`` (_id, _digest) with _keep, _size and _kept."""
    winners = F.broadcast(cut(_winners(keys, heavy_digests, counters)))
    tagged = keys.join(winners, "_digest", "left")
    lost = F.col("_heavy_size").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_heavy_keep"))
    losers = tagged.filter(lost).select("_id", "_digest", F.col("_heavy_keep").alias("_keep"), F.col("_heavy_size").alias("_size"), F.lit(False).alias("_kept"))
    group = Window.partitionBy("_digest")
    order = group.orderBy(F.col("_id").asc_nulls_last())
    others = (
        tagged.filter(~lost)
        .withColumn("_kept", F.row_number().over(order) == 1)
        .withColumn("_keep", F.first("_id").over(order))
        .withColumn("_size", F.coalesce(F.col("_heavy_size"), F.count("*").over(group)))
        .select("_id", "_digest", "_keep", "_size", "_kept")
    )
    return losers.unionByName(others)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_digests: int | None = None, counters: int = COUNTERS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    keys = cut(docs.select(F.col(id_col).alias("_id"), text_digest(text_col).alias("_digest")))
    return _decide(keys, heavy_digests, counters).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_digests: int | None = None, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    keys = cut(docs.select(F.col(id_col).alias("_id"), text_digest(text_col).alias("_digest")))
    dropped = cut(_decide(keys, heavy_digests, counters).filter("_size > 1").groupBy("_id", "_digest").agg(F.max("_kept").alias("_one_stays"), F.min("_kept").alias("_all_stay")).filter("not _all_stay"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_row_id"), text_digest(text_col).alias("_row_digest"))
    is_dropped = F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_digest") == F.col("_digest"))
    stay = rows.join(broadcast_if_small(dropped, BROADCAST_LOSERS), is_dropped, "left_anti").select("_row")
    repeated = dropped.filter("_one_stays")
    if not repeated.isEmpty():  # rows with equal id and text: one of each, gathered with map-side aggregation
        again = rows.join(broadcast_if_small(repeated, BROADCAST_LOSERS), is_dropped, "left_semi")
        stay = stay.unionByName(again.groupBy("_row_id", "_row_digest").agg(F.first("_row").alias("_row")).select("_row"))
    return stay.select("_row.*")
