"""Pictures for the cards of a page: each card takes the first free picture of its topics, and a page shows none twice while others are left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.text import hash31
from wayfold.operators.lineage import broadcast_if_small

_PICK = "struct<position:bigint,key:string,url:string>"


def page_picks(cards: DataFrame, pool: DataFrame) -> DataFrame:
    """(page, position, key, url): a greedy choice in the order of positions.

    ``cards``: page, position, card, keys (topics, the closest first); ``pool``: key, number, url. Of each topic's pictures a card looks at those from its
    own hash on, around to the ones before; it takes the first that the page does not show yet, or if all are shown the first of all.
    Cards without a picture for any topic have nulls. A page is folded as one row, as the choice of a card depends on the cards before;
    a page is what one screen shows. Repeated positions are taken by card; a null card counts as empty.
    """
    lists = pool.groupBy("key").agg(F.transform(F.array_sort(F.collect_set(F.struct("number", "url"))), lambda x: x["url"]).alias("urls"))
    card = F.coalesce(F.col("card"), F.lit(""))
    topics = cards.select("page", "position", card.alias("card"), F.posexplode_outer("keys").alias("rank", "key")).join(broadcast_if_small(lists), "key", "left")
    turn = F.pmod(hash31(F.col("card")), F.size("urls")).cast("int")
    rotated = F.concat(F.slice("urls", turn + 1, F.size("urls")), F.slice("urls", F.lit(1), turn))
    offers = F.when(F.size("urls") > 0, F.transform(rotated, lambda u: F.struct(F.col("key").alias("key"), u.alias("url")))).otherwise(F.array().cast("array<struct<key:string,url:string>>"))
    each = topics.select("page", "position", "card", "rank", offers.alias("offers")).groupBy("page", "position", "card").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "offers"))), lambda x: x["offers"])).alias("offers"))

    def take(done: Column, c: Column) -> Column:
        free = F.filter(c["offers"], lambda o: ~F.exists(done, lambda d: d["url"].eqNullSafe(o["url"])))
        pick = F.coalesce(F.get(free, F.lit(0)), F.get(c["offers"], F.lit(0)))
        return F.concat(done, F.array(F.struct(c["position"].cast("long").alias("position"), pick["key"].alias("key"), pick["url"].alias("url"))))

    pages = each.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("position", "card", "offers"))).alias("cards"))
    return pages.select("page", F.inline(F.aggregate("cards", F.array().cast(f"array<{_PICK}>"), take)))
