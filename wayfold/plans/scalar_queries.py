"""Queries of the scalar functions: geometry, scores, text, URLs, dates and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import dates, geo, pricing, text, urls
from wayfold.sources.tables import CENTRE, SQL_SUPPLIERS, sql_km, suppliers, table

LAT0, LON0 = CENTRE
_KM0 = sql_km("lat", "lon", "25.2::DOUBLE", "55.27::DOUBLE")


def geo_distance(spark, sf):
    s = suppliers(spark, sf)
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0))
    return s.select("s_suppkey", F.round(km, 6).alias("km"), geo.travel_minutes(km).alias("minutes"), F.round(geo.planar_order(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0)), 9).alias("planar"))


GEO_DISTANCE = f"""
WITH p AS (SELECT *, {_KM0} AS km FROM ({SQL_SUPPLIERS}))
SELECT s_suppkey, round(km, 6) AS km,
       CASE WHEN km IS NULL THEN 20.0::DOUBLE WHEN km <= 1.2 THEN greatest(3.0::DOUBLE, ceil(km / 4.5::DOUBLE * 60)) ELSE greatest(8.0::DOUBLE, ceil(km / 22.0::DOUBLE * 60 + 5)) END AS minutes,
       round((lat - 25.2::DOUBLE) * (lat - 25.2::DOUBLE) + (lon - 55.27::DOUBLE) * (lon - 55.27::DOUBLE) * round(pow(cos(radians(25.2::DOUBLE)), 2), 2), 9) AS planar
FROM p"""


def geo_box_cells(spark, sf):
    s = suppliers(spark, sf).filter(geo.in_box(F.col("lat"), F.col("lon"), 24.95, 55.0, 25.3, 55.45))
    return s.groupBy(geo.cell(F.col("lat"), 100).alias("cy"), geo.cell(F.col("lon"), 100).alias("cx")).agg(F.count("*").alias("places"), F.min("s_suppkey").alias("first_key"))


GEO_BOX_CELLS = f"""
SELECT floor(lat * 100)::BIGINT AS cy, floor(lon * 100)::BIGINT AS cx, count(*) AS places, min(s_suppkey) AS first_key
FROM ({SQL_SUPPLIERS}) WHERE lat BETWEEN 24.95::DOUBLE AND 25.3::DOUBLE AND lon BETWEEN 55.0::DOUBLE AND 55.45::DOUBLE GROUP BY 1, 2"""


def score_rating(spark, sf):
    p = table(spark, sf, "part")
    rating, reviews = F.lit(3.0) + F.pmod(F.col("p_partkey") * 37, F.lit(21)) / 10.0, F.pmod(F.col("p_partkey") * 53, F.lit(400)).cast("double")
    return p.select("p_partkey", geo.rating_points(rating, reviews).alias("points"), pricing.rating_of_5(rating * 2).alias("of_5"), pricing.price_level(F.col("p_retailprice") - 850, F.pmod("p_partkey", F.lit(2)) == 0).alias("level"))


SCORE_RATING = """
WITH p AS (SELECT *, 3.0::DOUBLE + (p_partkey * 37 % 21) / 10.0::DOUBLE AS r, (p_partkey * 53 % 400)::DOUBLE AS n, p_retailprice - 850 AS amount FROM part),
q AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN amount / 2 ELSE amount END AS one FROM p)
SELECT p_partkey, (CASE WHEN n >= 20 THEN floor((r - 4) * 14 * least(1.0::DOUBLE, n / 150.0::DOUBLE) + 0.5::DOUBLE) ELSE 0 END)::BIGINT AS points,
       floor(r * 2 / 2 * 10 + 0.5::DOUBLE) / 10 AS of_5,
       CASE WHEN amount IS NULL OR amount < 0 THEN NULL WHEN one <= 60 THEN 1 WHEN one <= 150 THEN 2 WHEN one <= 350 THEN 3 ELSE 4 END AS level
FROM q"""


def score_taste(spark, sf):
    taste = F.create_map(F.lit("calm"), F.lit(2.5), F.lit("food"), F.lit(-1.5), F.lit("view"), F.lit(4.0))
    dna = F.create_map(F.lit("calm"), F.pmod(F.col("p_partkey") * 7, F.lit(101)).cast("double"), F.lit("food"), F.pmod(F.col("p_partkey") * 11, F.lit(101)).cast("double"))
    return table(spark, sf, "part").select("p_partkey", F.round(geo.taste_points(taste, dna), 6).alias("taste_points"))


SCORE_TASTE = """
SELECT p_partkey, round(least(45.0::DOUBLE, greatest(-45.0::DOUBLE, 2.5::DOUBLE * ((p_partkey * 7 % 101)::DOUBLE - 50) / 14 + -1.5::DOUBLE * ((p_partkey * 11 % 101)::DOUBLE - 50) / 14)), 6) AS taste_points FROM part"""


def text_normal(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.normal_search(F.col("p_name")).alias("search"), text.normal_rank(F.concat("p_brand", F.lit(" <b>+Big-"), "p_type")).alias("rank"), text.clamp_words(F.col("p_type"), 12).alias("short"))


TEXT_NORMAL = r"""
SELECT p_partkey,
  trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(p_name), '<[^>]*>', ' ', 'g'), 'ё', 'е'), '[^a-zа-я0-9+-]', ' ', 'g'), '\s+', ' ', 'g')) AS search,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' <b>+Big-' || p_type), '<[^>]*>', ' ', 'g'), '[^a-zа-я0-9]', ' ', 'g'), '\s+', ' ', 'g')) AS rank,
  CASE WHEN length(p_type) <= 12 THEN p_type ELSE regexp_replace(substr(p_type, 1, 12), '\s+\S*$', '') || '…' END AS short
FROM part"""


def text_tokens(spark, sf):
    stems = F.transform(text.tokens(text.normal_rank(F.col("text"))), text.stem).alias("stems")
    d = table(spark, sf, "documents").filter("doc_id is not null").select(stems)
    told = lambda words, uses, docs: F.transform(words, lambda s: F.struct(s.alias("stem"), F.lit(uses).alias("uses"), F.lit(docs).alias("docs")))
    rows = d.select(F.inline(F.concat(told(F.col("stems"), 1, 0), told(F.array_distinct("stems"), 0, 1))))
    return rows.groupBy("stem").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs")).filter("docs >= 5")


TEXT_TOKENS = r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), 'ё', 'е'), '[^a-zа-я0-9]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT doc_id, unnest(string_split(t, ' ')) AS word FROM n),
s AS (SELECT doc_id, CASE WHEN length(word) >= 6 AND length(regexp_replace(word, '(ing|ers|er|es|s)$', '')) >= 5 THEN regexp_replace(word, '(ing|ers|er|es|s)$', '') ELSE word END AS stem
      FROM w WHERE word <> '' AND word NOT IN ('a', 'an', 'and', 'at', 'for', 'in', 'near', 'of', 'on', 'or', 'the', 'to', 'with'))
SELECT stem, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM s GROUP BY stem HAVING count(DISTINCT doc_id) >= 5"""


def text_hashes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.hash31(F.col("c_name")).alias("h31"), text.fnv1a(F.col("c_name")).alias("fnv"), F.expr("cast(conv(substr(sha1(c_name), 1, 12), 16, 10) as bigint) % 1000000000000").alias("sha_id"))


TEXT_HASHES = """
SELECT c_custkey, list_reduce(list_concat([0::BIGINT], list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h31,
  list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296) AS fnv,
  ('0x' || substr(sha1(c_name), 1, 12))::BIGINT % 1000000000000 AS sha_id
FROM customer"""


def text_similarity(spark, sf):
    """Pairs of different names of a brand that share a word or contain each other, with the parts that have them as counts."""
    p = table(spark, sf, "part").groupBy("p_brand", F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("a")).agg(F.count("*").alias("a_parts"))
    words = p.select("p_brand", "a", "a_parts", F.explode(F.array_distinct(F.split("a", " "))).alias("word"))
    others = words.select("p_brand", "word", F.col("a").alias("b"), F.col("a_parts").alias("b_parts"))
    pairs = words.join(others, ["p_brand", "word"]).filter("a < b").select("p_brand", "a", "b", "a_parts", "b_parts").distinct()
    return pairs.select("*", F.round(text.name_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


TEXT_SIMILARITY = """
WITH p AS (SELECT p_brand, lower(p_type || ' ' || p_name) AS a, count(*) AS a_parts FROM part GROUP BY ALL), j AS (
  SELECT p_brand, p.a, q.a AS b, p.a_parts, q.a_parts AS b_parts, list_distinct(string_split(p.a, ' ')) AS ta, list_distinct(string_split(q.a, ' ')) AS tb
  FROM p JOIN p q USING (p_brand) WHERE p.a < q.a)
SELECT p_brand, a, b, a_parts, b_parts, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.9::DOUBLE
  ELSE len(list_intersect(ta, tb))::DOUBLE / least(len(ta), len(tb)) * 0.8::DOUBLE END, 6) AS similarity FROM j WHERE len(list_intersect(ta, tb)) > 0"""


def url_parts(spark, sf):
    u = F.col("url")
    ip = F.concat_ws(".", *(F.pmod(F.col("page_id") * k, F.lit(m)).cast("string") for k, m in ((7, 200), (13, 256), (17, 256), (19, 256))))
    return table(spark, sf, "pages").select("page_id", urls.host(u).alias("host"), urls.registrable(urls.host(u)).alias("domain"), urls.own_site(u).alias("site"), urls.is_private_ipv4(ip).alias("private"))


URL_PARTS = r"""
WITH p AS (SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', ''), '') AS host,
  page_id * 7 % 200 AS a, page_id * 13 % 256 AS b FROM pages)
SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid|yclid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS site,
  (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)) AS private
FROM p"""


def date_rules(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.weekday(d).cast("int").alias("weekday"), dates.weekend_start(d).alias("sat"), dates.weekend_end(d).alias("sun"), dates.in_season(d, 1101, 331).alias("winter"), dates.in_season(d, 601, 831).alias("summer"), F.last_day(d).alias("month_end")
    )


DATE_RULES = """
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, dayofweek(o_orderdate) AS w, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)
SELECT o_orderkey, w::INTEGER AS weekday, (CASE WHEN w IN (0, 6) THEN d ELSE d + (6 - w)::INTEGER END)::DATE AS sat, (CASE WHEN w = 0 THEN d ELSE d + (7 - w)::INTEGER END)::DATE AS sun,
  (md >= 1101 OR md <= 331) AS winter, md BETWEEN 601 AND 831 AS summer, last_day(d) AS month_end FROM d"""


def clock_text(spark, sf):
    k = F.col("o_orderkey")
    said = F.concat(F.lit("table at "), F.when(k % 4 == 0, F.concat((k % 12 + 1).cast("string"), F.lit(":30 pm"))).when(k % 4 == 1, F.concat((k % 24).cast("string"), F.lit(":05"))).when(k % 4 == 2, F.lit("noon")).otherwise(F.lit("any time")))
    return table(spark, sf, "orders").select("o_orderkey", dates.clock_minutes(said).alias("minutes"))


CLOCK_TEXT = """
SELECT o_orderkey, (CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 12 + 1) % 12 * 60 + 30 + 720 WHEN 1 THEN o_orderkey % 24 * 60 + 5 WHEN 2 THEN 720 END)::INTEGER AS minutes FROM orders"""


def hours_open(spark, sf):
    k = F.col("s_suppkey")
    shift = F.struct((F.pmod(k * 7, F.lit(12)) * 60 + 360).cast("int").alias("start"), (F.pmod(k * 7, F.lit(12)) * 60 + 360 + 600 + F.pmod(k, F.lit(5)) * 60).cast("int").alias("end"))
    week = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when(F.pmod(k + d, F.lit(7)) == 0, F.array().cast("array<struct<start:int,end:int>>")).when(F.pmod(k + d, F.lit(7)) != 3, F.array(shift).cast("array<struct<start:int,end:int>>")))
    at = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day")
    rows = table(spark, sf, "supplier").select("s_suppkey", week.alias("week"), at)
    return rows.select("s_suppkey", "day", *(dates.open_at(F.col("week"), F.col("day"), F.lit(m)).alias(f"open_{m}") for m in (60, 720, 1380)))


HOURS_OPEN = """
WITH s AS (SELECT s_suppkey, unnest(range(0, 7))::INTEGER AS day, s_suppkey * 7 % 12 * 60 + 360 AS a, s_suppkey * 7 % 12 * 60 + 960 + s_suppkey % 5 * 60 AS b FROM supplier),
k AS (SELECT *, (s_suppkey + day) % 7 AS now, (s_suppkey + (day + 6) % 7) % 7 AS before FROM s), m AS (SELECT *, unnest([60, 720, 1380]) AS m FROM k),
r AS (SELECT *, CASE WHEN now = 3 AND before = 3 THEN NULL ELSE (now NOT IN (0, 3) AND a <= m AND m < b) OR (before NOT IN (0, 3) AND a <= m + 1440 AND m + 1440 < b) END AS o FROM m)
SELECT s_suppkey, day, bool_or(o) FILTER (m = 60) AS open_60, bool_or(o) FILTER (m = 720) AS open_720, bool_or(o) FILTER (m = 1380) AS open_1380 FROM r GROUP BY ALL"""


def price_text(spark, sf):
    k = F.col("p_partkey")
    said = F.when(k % 3 == 0, F.concat(F.lit("from AED "), F.format_number("p_retailprice", 2))).when(k % 3 == 1, F.concat(F.floor("p_retailprice").cast("string"), F.lit(" aed each"))).otherwise(F.when(k % 2 == 0, "Free entry").otherwise("ask"))
    prices = F.array(F.lit(0.0), F.round(F.col("p_retailprice") - 1000, 2), F.pmod(k, F.lit(5)).cast("double"))
    return table(spark, sf, "part").select("p_partkey", pricing.parse_amount(said).alias("amount"), pricing.least_price(prices).alias("least"))


PRICE_TEXT = """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice, 2) WHEN p_partkey % 3 = 1 THEN floor(p_retailprice) WHEN p_partkey % 2 = 0 THEN 0.0::DOUBLE END AS amount,
  coalesce(list_min(list_filter([0.0::DOUBLE, round(p_retailprice - 1000, 2), (p_partkey % 5)::DOUBLE], lambda x: x > 0)), 0.0::DOUBLE) AS least FROM part"""

NAMES = "geo_distance geo_box_cells score_rating score_taste text_normal text_tokens text_hashes text_similarity url_parts date_rules clock_text hours_open price_text".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
