"""Rows from feeds as text: XML events, sitemaps, JSON lines and arrays, robots files. Broken parts are skipped, the rest is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.lineage import broadcast_if_small, cut

# The named references of XML.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def decoded(x: Column) -> Column:
    """Text of an XML element: what CDATA holds as it is, else with the named references decoded."""
    plain = x
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    inside = F.regexp_extract(x, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    return F.trim(F.when(x.rlike(r"^\s*<!\[CDATA\["), inside).otherwise(plain))


def xml_events(rows: DataFrame, key: str, xml: str, fields: list[str]) -> DataFrame:
    """(key, position, fields): one row for each event element, missing fields null."""
    events = F.regexp_extract_all(xml, F.lit(r"(?is)<event\b[^>]*>(.*?)</event>"), F.lit(1))
    each = rows.select(key, F.posexplode(events).alias("position", "event"))
    field = lambda f: F.nullif(decoded(F.regexp_extract("event", rf"(?is)<{f}\b[^>]*>(.*?)</{f}>", 1)), F.lit(""))
    return each.select(key, "position", *(field(f).alias(f) for f in fields))


def sitemap(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, position, loc) for the addresses of a sitemap."""
    locs = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return rows.select(key, F.posexplode(locs).alias("position", "loc")).select(key, "position", decoded(F.col("loc")).alias("loc"))


def json_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """The rows of the lines that parse as objects of the schema; others are skipped."""
    parsed = lines.filter(F.try_parse_json(line).isNotNull()).select(F.from_json(line, schema).alias("_r"))
    return parsed.filter("_r is not null").select("_r.*")


def json_array(rows: DataFrame, key: str, json: str, schema: str) -> DataFrame:
    """(key, fields of the schema) for the elements of an array; a text that is no array has none."""
    elements = F.from_json(json, f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    return rows.filter(F.try_parse_json(json).isNotNull()).select(key, F.inline(elements))


def robots_rules(files: DataFrame, site: str, robots: str, agent: str) -> DataFrame:
    """(site, prefix, allow): the rules for an agent. Agents named in a row share the rules that follow; empty rules say nothing."""
    lines = files.select(site, F.posexplode(F.split(robots, r"\r?\n")).alias("at", "line"))
    bare = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter(F.col("line").contains(":"))
    told = bare.select(site, "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value")).filter(F.col("name").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy(site).orderBy("at")
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(w), F.lit("")) != "user-agent")
    grouped = told.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(w))
    named = grouped.filter((F.col("name") == "user-agent") & (F.lower("value") == agent.lower())).select(site, "part").distinct()
    rules = grouped.filter("name <> 'user-agent' and value <> ''").join(named, [site, "part"])
    return rules.select(site, F.col("value").alias("prefix"), (F.col("name") == "allow").alias("allow")).distinct()


def robots_decision(paths: DataFrame, rules: DataFrame, key: str, site: str, path: str) -> DataFrame:
    """(key, allowed): the longest rule of the site that begins the path decides, an allowing one on ties; without a rule it is allowed."""
    rules = cut(rules.groupBy(site, "prefix").agg(F.max("allow").alias("allow")))
    lengths = rules.groupBy(site).agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    begun = paths.join(broadcast_if_small(lengths), site, "left").select(key, site, path, F.explode_outer(F.filter("lengths", lambda n: n <= F.length(path))).alias("n"))
    matched = begun.select(key, site, F.substring(path, F.lit(1), F.col("n")).alias("prefix")).join(broadcast_if_small(rules), [site, "prefix"], "left")
    return matched.groupBy(key).agg(F.coalesce(F.max_by("allow", F.when(F.col("allow").isNotNull(), F.length("prefix"))), F.lit(True)).alias("allowed"))
