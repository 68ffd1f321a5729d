"""Requests to search plans: a grammar of cuts, categories, and requests of several stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import dates, pricing
from wayfold.functions.text import squeeze

# The grammar's own word lists. Each rule sees what earlier rules left.
CUTS = (
    ("tonight", r"(^| )(tonight|this evening)( |$)"),
    ("tomorrow", r"(^| )tomorrow( |$)"),
    ("weekend", r"(^| )(on the|this|at the)? ?weekend( |$)"),
    ("cheap", r"(^| )(cheap|budget|inexpensive)( |$)"),
    ("near", r"(^| )(near me|nearby|close by)( |$)"),
    ("kids", r"(^| )(with|for) (kids|children)( |$)"),
    ("indoor", r"(^| )(indoor|inside)( |$)"),
)
CATEGORIES = (("restaurant", "restaurant|dinner|eat"), ("cafe", "cafe|coffee|breakfast"), ("museum", "museum|gallery|exhibition"), ("park", "park|garden"), ("beach", "beach|sea"), ("concert", "concert|live music"), ("bar", "(^| )bars?( |$)|cocktail"))


def cut_intents(requests: DataFrame, text: str) -> DataFrame:
    """One flag per rule and what is left of the text. Rules apply in order, each to the text that the rules before left."""
    now = requests.withColumn("rest", squeeze(F.regexp_replace(F.lower(F.col(text)), r"[^a-z0-9: ]", " ")))
    for name, pattern in CUTS:
        now = now.withColumn(name, F.col("rest").rlike(pattern)).withColumn("rest", squeeze(F.regexp_replace("rest", pattern, " ")))
    return now


def categories(text: Column) -> Column:
    """Categories whose words occur, in the order of the list."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(c)) for c, p in CATEGORIES)))


def search_plan(requests: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, flags, minutes, most_price, categories, stops, rest): the plan of each request, from its whole text."""
    cut = cut_intents(requests, text)
    return cut.select(*keys, *(n for n, _ in CUTS), dates.clock_minutes(F.col(text)).alias("minutes"), pricing.parse_amount(F.col(text)).alias("most_price"), categories(F.col("rest")).alias("categories"), F.size(stops(F.col(text))).alias("stops"), "rest")


def stops(text: Column) -> Column:
    """Parts of a request of several stops (then, after that, ;), only if every part names a category; else the whole."""
    parts = F.transform(F.split(F.lower(text), r" then | after that |;"), lambda p: F.trim(p))
    return F.when(F.forall(parts, lambda p: F.size(categories(p)) > 0) & (F.size(parts) > 1), parts).otherwise(F.array(F.trim(F.lower(text))))
