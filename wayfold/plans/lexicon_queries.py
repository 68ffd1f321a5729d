"""Queries that tag texts by dictionaries: requests for places, and places of public catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import lexicon
from wayfold.operators.lineage import broadcast_if_small, cut
from wayfold.plans import grammar
from wayfold.plans.venue_queries import BRANCHES, NAMES
from wayfold.sources.tables import spread, table

_PLACES = lexicon.entries(lexicon.PLACE_WORDS)
_PHRASES = [p for _, p, _, _ in _PLACES]
_values = lambda rows: ", ".join("(" + ", ".join(str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
_texts = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def place_requests(spark, sf):
    """A request for each order, of two phrases of the dictionary."""
    k, said = F.col("o_orderkey"), F.array(*map(F.lit, _PHRASES))
    pick = lambda n: F.get(said, F.pmod(n, F.lit(len(_PHRASES))).cast("int"))
    text = F.concat(F.when(k % 2 == 0, "Looking for a ").otherwise("Where are good "), pick(k), F.when(k % 2 == 0, ", or some ").otherwise("s & "), F.upper(pick(k * 7)), F.lit(" near the pool?"))
    return table(spark, sf, "orders").select("o_orderkey", text.alias("said"))


def tagged_requests(spark, sf):
    """The tags of all requests, in the order of the dictionary; distinct requests are matched once."""
    rows = place_requests(spark, sf)
    tags = lexicon.tagged(rows.select("said").distinct(), ["said"], "said", lexicon.dictionary(spark, _PLACES))
    return rows.join(tags, "said").select("o_orderkey", F.array_join("tags", ",").alias("tags"), F.size("tags").cast("long").alias("n"))


#: The words of a text, and the tags of padded words, by looking up every phrase.
def _words_sql(x: str) -> str:
    return f"list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN regexp_matches(w, '[a-z]{{2}}[a-rt-z]s$') THEN w[:len(w) - 1] ELSE w END)"


def _padded(x: str) -> str:
    return f"(' ' || array_to_string({_words_sql(x)}, ' ') || ' ')"


def _dictionary_sql(name: str, rows: list) -> str:
    return f"{name} AS (SELECT tag, any_value(priority) AS priority, list({_padded('phrase')}) FILTER (NOT excluded) AS wanted, coalesce(list({_padded('phrase')}) FILTER (excluded), []) AS unwanted FROM (VALUES {_values(rows)}) v(tag, phrase, excluded, priority) GROUP BY tag)"


_hit = lambda text, d: f"len(list_filter({d}.wanted, lambda p: contains(list_reduce(list_prepend({text}, {d}.unwanted), lambda a, u: replace(a, u, ' # ')), p))) > 0"

TAGGED_REQUESTS = f"""
WITH {_dictionary_sql("d", _PLACES)}, p AS (SELECT {_texts(_PHRASES)} AS said), r AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Looking for a ' ELSE 'Where are good ' END || said[o_orderkey % {len(_PHRASES)} + 1] || CASE WHEN o_orderkey % 2 = 0 THEN ', or some ' ELSE 's & ' END
    || upper(said[o_orderkey * 7 % {len(_PHRASES)} + 1]) || ' near the pool?' AS said FROM orders, p
), t AS (SELECT DISTINCT said FROM r), w AS (SELECT said, {_padded("said")} AS padded FROM t
), tags AS (SELECT said, string_agg(tag, ',' ORDER BY priority) AS tags, count(*) AS n FROM w, d WHERE {_hit("padded", "d")} GROUP BY said)
SELECT o_orderkey, coalesce(tags, '') AS tags, coalesce(n, 0) AS n FROM r LEFT JOIN tags USING (said)"""

#: Categories as public catalogs write them.
CATEGORIES = (
    "coffee_shop wine_bar milk_bar juice_bar golf_course golf_equipment_dealer travel_service arts_and_entertainment attraction nail_salon dental_clinic auto_repair shopping_center performing_arts_theater "
    "planetarium virtual_reality_center topic steakhouse food_wholesaler ice_cream_shop fitness_center gas_station botanical_garden pet_store courier_agency hotel museum unknown"
).split()


def catalog_places(spark, sf):
    """A catalog's place for each part: a main category, up to two others, a basic one, and a name of two phrases."""
    k = F.col("p_partkey")
    of = lambda n: F.get(F.array(*map(F.lit, CATEGORIES)), F.pmod(n, F.lit(len(CATEGORIES))).cast("int"))
    said = lambda n: F.get(F.array(*map(F.lit, _PHRASES)), F.pmod(n, F.lit(len(_PHRASES))).cast("int"))
    others = F.slice(F.array(of(k * 3 + 1), of(k * 5 + 2)), F.lit(1), F.pmod(F.floor(k / 28), F.lit(3)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.when(k % 11 != 0, of(k)).alias("category"), others.alias("others"), F.when(k % 2 == 0, of(k * 9 + 4)).alias("basic"), F.concat(F.initcap(said(k * 13)), F.lit(" & "), said(k * 17 + 5)).alias("name"))


def catalog_tags(spark, sf):
    """The tags of all catalog places."""
    told = lexicon.catalog_tags(catalog_places(spark, sf), "p_partkey", "category", "others", "basic", "name", lexicon.dictionary(spark, _PLACES))
    return told.select("p_partkey", F.array_join("tags", ",").alias("tags"))


_OUT = lexicon.entries(f"out: {lexicon.NOT_A_PLACE}")
_SURE = lexicon.entries("\n".join(f"{t}: {w}" for t, w in lexicon.CONFIRMED_BY_NAME.items()))
CATALOG_TAGS = f"""
WITH {_dictionary_sql("d", _PLACES)}, {_dictionary_sql("rules", lexicon.entries(lexicon.CATALOG_WORDS))}, {_dictionary_sql("bad", _OUT)}, {_dictionary_sql("sure", _SURE)},
lists AS (SELECT {_texts(_PHRASES)} AS said, {_texts(CATEGORIES)} AS c), p AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 11 <> 0 THEN c[p_partkey % {len(CATEGORIES)} + 1] END AS category, list_slice([c[(p_partkey * 3 + 1) % {len(CATEGORIES)} + 1], c[(p_partkey * 5 + 2) % {len(CATEGORIES)} + 1]], 1, p_partkey // 28 % 3) AS others,
    CASE WHEN p_partkey % 2 = 0 THEN c[(p_partkey * 9 + 4) % {len(CATEGORIES)} + 1] END AS basic, said[p_partkey * 13 % {len(_PHRASES)} + 1] || ' & ' || said[(p_partkey * 17 + 5) % {len(_PHRASES)} + 1] AS name
  FROM part, lists
), meaning AS (
  SELECT x AS said, EXISTS (SELECT 1 FROM bad WHERE {_hit("padded", "bad")}) AS out, (SELECT arg_min(tag, priority) FROM rules WHERE {_hit("padded", "rules")}) AS tag
  FROM (SELECT x, {_padded("replace(x, '_', ' ')")} AS padded FROM (SELECT unnest(c) AS x FROM lists))
), names AS (
  SELECT name, (SELECT arg_min(tag, priority) FROM d WHERE {_hit("padded", "d")}) AS tag, coalesce((SELECT list(tag) FROM sure WHERE {_hit("padded", "sure")}), []) AS sure FROM (SELECT DISTINCT name, {_padded("name")} AS padded FROM p)
), own AS (
  SELECT k, list(tag ORDER BY pos) AS tags FROM (
    SELECT k, tag, min(pos) AS pos FROM (SELECT k, unnest(list_prepend(category, others)) AS said, unnest(range(len(others) + 1)) AS pos FROM p) JOIN meaning USING (said) WHERE NOT out AND tag IS NOT NULL GROUP BY k, tag) GROUP BY k
), guessed AS (
  SELECT p.k, coalesce(m.out, FALSE) AS out, n.sure, CASE WHEN own.tags IS NOT NULL THEN own.tags WHEN b.tag IS NOT NULL AND NOT b.out THEN [b.tag]
    WHEN p.category IN ({", ".join(f"'{c}'" for c in lexicon.VAGUE_CATEGORIES)}) AND NOT coalesce(b.out, FALSE) AND n.tag IS NOT NULL THEN [n.tag] ELSE [] END AS tags
  FROM p LEFT JOIN own USING (k) LEFT JOIN meaning m ON m.said = p.category LEFT JOIN meaning b ON b.said = p.basic JOIN names n ON n.name = p.name
)
SELECT k AS p_partkey, CASE WHEN out THEN '' ELSE array_to_string(list_slice(list_filter(tags, lambda t: t NOT IN ({", ".join(f"'{c}'" for c in lexicon.CONFIRMED_BY_NAME)}) OR list_contains(sure, t)), 1, {lexicon.MOST_TAGS}), ',') END AS tags FROM guessed"""


#: Parts of a request.
LEADS = ("find me a", "Book a table at", "", "where's")
KINDS = ("sushi restaurant", "rooftop bar", "museum", "", "Palm House Marina", "corner cafe downtown")
TIMES = ("tonight", "at 9:30 p.m.", "tomorrow", "this weekend", "on Friday", "until 2am", "")
PRICES = ("cheap", "under 150 AED", "fancy", "")
GUESTS = ("for eight people", "with the kids", "dog-friendly", "")
TODAY = "2026-05-06"


def request_intents(spark, sf):
    """The plans of requests put together from parts for each order, asked on a Wednesday at all hours."""
    k = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(n), F.lit(len(values))).cast("int"))
    said = F.concat_ws(" ", pick(LEADS, k), pick(PRICES, k / 3), pick(KINDS, k / 2), pick(GUESTS, k / 5), pick(TIMES, k / 7))
    asked = spread(table(spark, sf, "orders").select("o_orderkey")).select("o_orderkey", F.pmod(k, F.lit(24)).cast("int").alias("hour"), said.alias("said"))
    names = spark.createDataFrame([(n + b,) for n in NAMES for b in BRANCHES], "name string")
    # A text at an hour has one plan, whoever asks: each is read once and joined back.
    distinct = spread(cut(asked.select("said", "hour").distinct()))
    told = cut(grammar.plans(distinct, ["said", "hour"], "said", names, lexicon.dictionary(spark, _PLACES), F.lit(TODAY).cast("date"), F.col("hour")))
    return asked.join(broadcast_if_small(told), ["said", "hour"]).select(
        "o_orderkey", "action", F.lower("place").alias("place"), F.array_join("categories", ",").alias("categories"), F.array_join("conditions", ",").alias("conditions"),
        "day_from", "day_to", "minutes", "strict", "price_min", "price_max", "party", "kids",
    )


#: What each part means, put together without reading the text.
REQUEST_INTENTS = f"""
WITH parts AS (
  SELECT o_orderkey, {_texts(LEADS)}[o_orderkey % {len(LEADS)} + 1] AS lead, {_texts(KINDS)}[o_orderkey // 2 % {len(KINDS)} + 1] AS kind, {_texts(PRICES)}[o_orderkey // 3 % {len(PRICES)} + 1] AS price,
         {_texts(GUESTS)}[o_orderkey // 5 % {len(GUESTS)} + 1] AS guests, {_texts(TIMES)}[o_orderkey // 7 % {len(TIMES)} + 1] AS moment FROM orders
), fields AS (
  SELECT *, CASE lead WHEN 'Book a table at' THEN 'book' WHEN 'where''s' THEN 'lookup' END AS action, kind IN ('Palm House Marina', 'corner cafe downtown') AS is_name,
         moment IN ('tonight', 'at 9:30 p.m.', 'until 2am') AS strict, CASE kind WHEN 'sushi restaurant' THEN 'food' WHEN 'rooftop bar' THEN 'bar' WHEN 'museum' THEN 'museum' ELSE '' END AS base FROM parts
), told AS (
  SELECT *, CASE WHEN is_name THEN '' WHEN base <> '' THEN base WHEN price <> '' THEN 'food' WHEN guests = 'dog-friendly' THEN 'coffee,food'
    WHEN moment = 'tonight' THEN 'bar,food,hookah,club' WHEN strict THEN 'food,coffee,bar,sights' ELSE '' END AS categories FROM fields
)
SELECT o_orderkey, action, CASE WHEN is_name THEN lower(kind) END AS place, categories,
       array_to_string(list_filter([CASE WHEN price = 'fancy' AND categories = 'food' THEN 'price=3,price=4' END, CASE WHEN price = 'fancy' AND categories = 'coffee,food' THEN 'price=3,price=4' END, CASE WHEN guests = 'dog-friendly' THEN 'dog=yes' END], lambda x: x IS NOT NULL), ',') AS conditions,
       DATE '{TODAY}' + CASE moment WHEN 'tonight' THEN 0 WHEN 'tomorrow' THEN 1 WHEN 'this weekend' THEN 3 WHEN 'on Friday' THEN 2 END AS day_from,
       DATE '{TODAY}' + CASE moment WHEN 'tonight' THEN 0 WHEN 'tomorrow' THEN 1 WHEN 'this weekend' THEN 4 WHEN 'on Friday' THEN 2 END AS day_to,
       CASE moment WHEN 'tonight' THEN 1200 WHEN 'at 9:30 p.m.' THEN 1290 WHEN 'until 2am' THEN 90 END AS minutes, strict,
       CASE price WHEN 'fancy' THEN 3 END AS price_min, CASE price WHEN 'cheap' THEN 1 WHEN 'under 150 AED' THEN 2 END AS price_max, CASE guests WHEN 'for eight people' THEN 8 END AS party, guests = 'with the kids' AS kids
FROM told"""

WITH_SQL = "tagged_requests catalog_tags request_intents".split()
QUERIES = {n: globals()[n] for n in WITH_SQL}
ORACLE_SQL = {n: globals()[n.upper()] for n in WITH_SQL}
