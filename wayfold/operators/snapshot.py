"""Searching a snapshot of places: categories, token search, nearest rows, and rules of keeping rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.lineage import broadcast_if_small, cut


def nearest_per_group(rows: DataFrame, group: str, order: Column, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the smallest order in each group, ties by key, with their rank."""
    w = Window.partitionBy(group).orderBy(order, key)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def all_tokens(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, key) for the keys that have every token of a query. ``postings``: (token, key), repeats allowed; ``wanted``: (query, token).

    Tokens that no query asks for leave in the scan when the wanted ones are few enough to be broadcast.
    """
    need = F.count("*").over(Window.partitionBy("query"))
    wanted = cut(wanted.distinct().withColumn("need", need))
    hits = postings.join(broadcast_if_small(wanted), "token").groupBy("query", "key", "need").agg(F.countDistinct("token").alias("have"))
    return hits.filter("have = need").select("query", "key")


def first_stage_wins(stages: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of ordered sub-queries; each key stays where it is found first."""
    staged = [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)]
    every = staged[0]
    for s in staged[1:]:
        every = every.unionByName(s)
    w = Window.partitionBy(key).orderBy("stage", order)
    return every.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def last_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_last", F.row_number().over(w)).filter("_last = 1").drop("_last")


def keep_if_enough(rows: DataFrame, group: str, flag: Column, least: int) -> DataFrame:
    """Where at least ``least`` rows of a group satisfy the flag, only those; elsewhere all."""
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    enough = F.sum(F.col("_flag").cast("int")).over(Window.partitionBy(group)) >= least
    return marked.withColumn("_enough", enough).filter("_flag or not _enough").drop("_flag", "_enough")


def within_of_best(rows: DataFrame, group: str, score: str, points: float) -> DataFrame:
    best = F.max(score).over(Window.partitionBy(group))
    return rows.withColumn("best", best).filter(F.col(score) >= F.col("best") - points)


def tag_by_rules(rows: DataFrame, key: str, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, tags): the tags whose pattern occurs in the text, in the order of the rules."""
    tags = F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(tag)) for tag, pattern in rules)))
    return rows.select(key, tags.alias("tags"))
