"""Prices and ratings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends of the price bands 1 to 3.
BANDS = (60.0, 150.0, 350.0)


def price_level(amount: Column, per_two: Column | None = None) -> Column:
    """1 to 4 by the bands; amounts for two are halved."""
    one = amount if per_two is None else F.when(per_two, amount / 2).otherwise(amount)
    level = F.lit(4)
    for k in (3, 2, 1):
        level = F.when(one <= BANDS[k - 1], k).otherwise(level)
    return F.when(amount.isNull() | (amount < 0), F.lit(None)).otherwise(level)


def least_price(prices: Column) -> Column:
    """Smallest positive price, else 0 if there is any, else null."""
    return F.coalesce(F.array_min(F.filter(prices, lambda x: x > 0)), F.when(F.size(prices) > 0, 0.0))


def rating_of_5(rating_of_10: Column) -> Column:
    return F.floor(rating_of_10 / 2 * 10 + 0.5) / 10


def parse_amount(text: Column) -> Column:
    """The number before or after AED in a text; 0 for free; null if there is none."""
    low = F.lower(text)
    number = r"([0-9][0-9,]*(\.[0-9]+)?)"
    got = F.coalesce(F.nullif(F.regexp_extract(low, rf"aed ?{number}", 1), F.lit("")), F.nullif(F.regexp_extract(low, rf"{number} ?aed", 1), F.lit("")))
    return F.coalesce(F.regexp_replace(got, ",", "").try_cast("double"), F.when(low.rlike("(^|[^a-z])free([^a-z]|$)"), 0.0))
