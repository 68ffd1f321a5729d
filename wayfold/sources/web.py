"""Rows from raw pages by expressions: meta data, anchors, embedded blocks, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.lineage import broadcast_if_small, cut


def strip_markup(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, the five basic entities decoded, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    plain = F.regexp_replace(bare, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def page_meta(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    return pages.select(
        "page_id",
        F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(h, r'<html[^>]* lang="([^"]*)"', 1).alias("lang"),
        F.regexp_count(h, F.lit(r"<a [^>]*href=")).cast("long").alias("links"),
        F.regexp_count(h, F.lit(r"<p>")).cast("long").alias("paragraphs"),
    )


def anchors(pages: DataFrame) -> DataFrame:
    """One row per link: page_id, position, href, label."""
    found = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"[^>]*>[^<]*</a>'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("position", "a"))
    return rows.select("page_id", "position", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)</a>", 1).alias("label"))


def robots_allowed(paths: DataFrame, rules: DataFrame, key: str, path: str) -> DataFrame:
    """(key, allowed): the longest rule that begins the path decides, an allowing one on ties; without a rule it is allowed.

    ``rules``: (prefix, allow). A path is cut to every length that a rule has, so that the join is an equi-join on the prefix.
    """
    rules = cut(rules.groupBy("prefix").agg(F.max("allow").alias("allow")))
    lengths = rules.select(F.length("prefix").alias("n")).distinct().agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    begun = paths.select(key, path).join(F.broadcast(lengths)).select(key, F.explode_outer(F.filter("lengths", lambda n: n <= F.length(path))).alias("n"), path)
    cut_to = begun.select(key, F.substring(path, F.lit(1), F.col("n")).alias("prefix"))
    matched = cut_to.join(broadcast_if_small(rules), "prefix", "left")
    return matched.groupBy(key).agg(F.coalesce(F.max_by("allow", F.when(F.col("allow").isNotNull(), F.length("prefix"))), F.lit(True)).alias("allowed"))


def json_ld(pages: DataFrame, key: str, html: str, schema: str) -> DataFrame:
    """(key, position, node): the page's ld+json blocks that parse as the schema; broken blocks are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select(key, F.posexplode(blocks).alias("position", "block"))
    parsed = rows.select(key, "position", F.from_json("block", schema, {"mode": "PERMISSIVE"}).alias("node"), F.try_parse_json("block").isNotNull().alias("ok"))
    return parsed.filter("ok").drop("ok")
