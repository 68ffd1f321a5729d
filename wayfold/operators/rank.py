"""Scoring and ranking of candidate cards per query: additive terms, cut-offs, final order and the diversified top five."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.lineage import cut

# Penalties between two cards of one answer.
SAME_CATEGORY, SAME_LEAD, SAME_PROVIDER = 10.0, 7.0, 2.0


def additive_score(terms: list[tuple[Column, float]]) -> Column:
    """Sum of the points of the terms that hold."""
    total = F.lit(0.0)
    for holds, points in terms:
        total = total + F.when(holds, points).otherwise(0.0)
    return total


def distance_points(km: Column, near: Column) -> Column:
    return F.when(near, F.greatest(F.lit(-30.0), 32 - 5 * km)).otherwise(F.greatest(F.lit(0.0), 8 - 0.6 * km))


def fit_ratio(criteria: list[tuple[Column, float]]) -> Column:
    """Share of the weight of the known criteria that hold, as a match of 50 to 99; null if none is known."""
    known = sum((F.when(holds.isNotNull(), w).otherwise(0.0) for holds, w in criteria), F.lit(0.0))
    got = sum((F.when(holds, w).otherwise(0.0) for holds, w in criteria), F.lit(0.0))
    return F.when(known > 0, F.floor(50 + 49 * got / F.nullif(known, F.lit(0.0)) + 0.5).cast("long"))


def final_order(cards: DataFrame, query: str, keep: int) -> DataFrame:
    """The best ``keep`` cards of a query by score, quality, distance (unknown last) and key."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.desc("quality"), F.coalesce("km", F.lit(99.0)), "card")
    return cards.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def diversified(cards: DataFrame, keep: int = 5) -> DataFrame:
    """(query, place, card, gain): greedily the card with the largest score minus penalties against those chosen.

    Every step depends on the steps before, so a query's candidates meet in one group. Cards of equal category, lead and
    provider have equal penalties throughout, so only the best ``keep`` of each such kind can be chosen and go there.
    """
    kind = Window.partitionBy("query", "category", "lead", "provider").orderBy(F.desc("score"), "card")
    cards = cards.withColumn("_n", F.row_number().over(kind)).filter(F.col("_n") <= keep)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = list(pdf.sort_values(["score", "card"], ascending=[False, True]).itertuples(index=False))
        chosen, out = [], []
        while left and len(chosen) < keep:
            def gain(c) -> float:
                return c.score - sum(SAME_CATEGORY * (c.category == o.category) + SAME_LEAD * (c.lead == o.lead) + SAME_PROVIDER * (c.provider == o.provider) for o in chosen)

            best = max(left, key=lambda c: (gain(c), -c.card))
            out.append((best.query, len(chosen) + 1, best.card, float(gain(best))))
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame(out, columns=["query", "place", "card", "gain"])

    return cards.select("query", "card", "score", "category", "lead", "provider").groupBy("query").applyInPandas(choose, "query long, place int, card long, gain double")


def quantile_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, most, one column per share): the value at place floor(n * share) + 1 among a group's values that aren't null.

    Equal values are counted, and the counts dealt by ranges of group and value, so that no group is gathered in a task: sums of
    the ranges, which are few, tell in which range a place is, and only that range is added up row by row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange(group, value).withColumn("_p", F.spark_partition_id()))
    ahead = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(group)
    sums = ranged.groupBy(group, "_p").agg(F.sum("_c").alias("_s"), F.max(value).alias("_most"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(ahead), F.lit(0)), "n": F.sum("_s").over(every), "most": F.max("_most").over(every)})
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.floor(F.col("n") * share) + 1).alias("at")) for name, share in shares.items())))
    aims = sums.withColumn("_a", wanted).filter("_a.at > _before and _a.at <= _before + _s").select(F.col(group).alias("_g"), F.col("_p").alias("_q"), "n", "most", "_before", "_a")
    hit = ranged.join(F.broadcast(aims), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(group, "_p", "_a.name").orderBy(value))
    found = hit.withColumn("_upto", upto).filter("_upto >= _a.at and _upto - _c < _a.at")
    return found.groupBy(group, "n", "most").agg(*(F.max(F.when(F.col("_a.name") == name, F.col(value))).alias(name) for name in shares))
