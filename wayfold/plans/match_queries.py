"""Queries that match places: with entities of their sites, with rules, with districts, with doubles, with the coast and buffered regions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wayfold.operators import matching, picks, regions
from wayfold.plans.venue_queries import BRANCHES, NAMES
from wayfold.sources.tables import SQL_CUSTOMERS, customers, sql_km, table

_texts = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_pick = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(n), F.lit(len(values))).cast("int"))


def site_places(spark, sf):
    """A place for each customer, on a chain's site, a site shared by few, or none."""
    k = F.col("c_custkey")
    site = F.when(k % 4 == 0, F.concat(F.lit("chain"), F.pmod(F.floor(k / 4), F.lit(60)).cast("string"))).when(k % 4 != 3, F.concat(F.lit("site"), F.floor(k / 2).cast("string")))
    name = F.concat(_pick(NAMES, F.when(k % 4 == 0, F.pmod(F.floor(k / 4), F.lit(60))).otherwise(F.floor(k / 2))), _pick(BRANCHES, k / 16))
    return customers(spark, sf).select(k.alias("pid"), name.alias("name"), "lat", "lon", site.alias("site"))


def site_entities(places):
    """What the sites say: an entity for each place, near, far off or without a point, and a second one of other hours for every third."""
    k = F.col("pid")
    first = places.filter("site is not null").select(
        "site", (k * 10).alias("eid"), F.when(k % 11 == 0, F.lit("")).when(k % 5 == 0, "Other Place").otherwise(F.col("name")).alias("name"),
        F.when(k % 6 == 0, F.concat(F.lit("1 Road,"), F.substring_index("name", " ", -1))).alias("address"),
        F.when(k % 3 != 1, F.col("lat") + F.pmod(k, F.lit(7)) / 1000.0).alias("lat"), F.when(k % 3 != 1, F.col("lon")).alias("lon"), F.when(k % 2 == 0, "Mo-Su 10:00-20:00").alias("hours"),
    )
    second = places.filter("site is not null and pid % 3 = 1").select("site", (k * 10 + 1).alias("eid"), "name", F.lit(None).cast("string").alias("address"), (F.col("lat") + 0.01).alias("lat"), "lon", F.when(k % 4 == 1, "Mo-Fr 09:00-18:00").alias("hours"))
    return first.unionByName(second)


def site_matches(spark, sf):
    """The entity that speaks of each place on its site."""
    places = site_places(spark, sf)
    return matching.best_entities(places, site_entities(places))


_km_m = sql_km("lat", "lon", "e_lat", "e_lon")
SITE_MATCHES = f"""
WITH p AS (
  SELECT c_custkey AS pid, n[(CASE WHEN c_custkey % 4 = 0 THEN c_custkey // 4 % 60 ELSE c_custkey // 2 END) % {len(NAMES)} + 1] || b[c_custkey // 16 % {len(BRANCHES)} + 1] AS name, lat, lon,
         CASE WHEN c_custkey % 4 = 0 THEN 'chain' || c_custkey // 4 % 60 WHEN c_custkey % 4 <> 3 THEN 'site' || c_custkey // 2 END AS site
  FROM ({SQL_CUSTOMERS}), (SELECT {_texts(NAMES)} AS n, {_texts(BRANCHES)} AS b)
), e AS (
  SELECT site, pid * 10 AS eid, CASE WHEN pid % 11 = 0 THEN '' WHEN pid % 5 = 0 THEN 'other place' ELSE lower(name) END AS e, CASE WHEN pid % 6 = 0 THEN '1 road ' || lower(string_split(name, ' ')[-1]) ELSE '' END AS a,
         CASE WHEN pid % 3 <> 1 THEN lat + pid % 7 / 1000.0::DOUBLE END AS e_lat, CASE WHEN pid % 3 <> 1 THEN lon END AS e_lon, CASE WHEN pid % 2 = 0 THEN 'a' END AS h FROM p WHERE site IS NOT NULL
  UNION ALL SELECT site, pid * 10 + 1, lower(name), '', lat + 0.01::DOUBLE, lon, CASE WHEN pid % 4 = 1 THEN 'b' END FROM p WHERE site IS NOT NULL AND pid % 3 = 1
), q AS (SELECT *, lower(name) AS p, string_split(lower(name), ' ') AS pw FROM p WHERE site IS NOT NULL
), sites AS (SELECT q.site, count(DISTINCT pid) AS users, (SELECT count(DISTINCT e) FROM e WHERE e.site = q.site AND e <> '') AS names FROM q GROUP BY q.site
), brand AS (SELECT site, list(w) AS brand FROM (SELECT site, w, count(DISTINCT pid) AS n FROM (SELECT site, pid, unnest(pw) AS w FROM q) GROUP BY site, w) JOIN sites USING (site) WHERE n = users GROUP BY site
), met AS (
  SELECT *, {_km_m} * 1000 AS d, CASE WHEN h IS NULL THEN 0.0 ELSE 0.3 END AS extra, string_split(e, ' ') AS ew,
         CASE WHEN e = '' THEN 0.0 WHEN p = e THEN 1.0 WHEN contains(p, e) OR contains(e, p) THEN 0.9 ELSE 0.8::DOUBLE * len(list_intersect(list_distinct(pw), list_distinct(string_split(e, ' ')))) / least(len(list_distinct(pw)), len(list_distinct(string_split(e, ' ')))) END AS sim
  FROM q JOIN sites USING (site) LEFT JOIN brand USING (site) JOIN e USING (site)
), scored AS (
  SELECT *, CASE WHEN users >= 3 AND d <= 300 AND (sim >= 0.5 OR e = '') THEN {{'how': 'geo', 'score': 3 - d / 1000 + extra}}
    WHEN users >= 3 AND d IS NULL AND sim >= 0.5 AND len(list_intersect(list_filter(pw, lambda w: NOT list_contains(coalesce(brand, []), w)), string_split(trim(e || ' ' || a), ' '))) > 0 THEN {{'how': 'branch', 'score': 2.0::DOUBLE}}
    WHEN users < 3 AND d <= 500 AND (sim >= 0.5 OR (e = '' AND d <= 150)) THEN {{'how': 'geo', 'score': 3 - d / 1000 + sim + extra}}
    WHEN users < 3 AND sim >= 0.5 AND (d IS NULL OR d <= 1500) THEN {{'how': 'name', 'score': (1 + sim + extra)::DOUBLE}}
    WHEN users < 3 AND sim >= 0.9 AND names <= 1 THEN {{'how': 'name', 'score': (0.8 + extra)::DOUBLE}} END AS s
  FROM met WHERE d IS NULL OR d <= 3000
), told AS (SELECT pid, eid, s.how AS how, round(s.score, 6) AS score, e, e_lat, e_lon, h FROM scored WHERE s IS NOT NULL
), top AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, eid) = 1)
SELECT pid, eid, how, score FROM top t WHERE NOT (how = 'name' AND EXISTS (
  SELECT 1 FROM told r WHERE r.pid = t.pid AND r.how = 'name' AND r.eid <> t.eid AND (r.e <> t.e OR {sql_km("t.e_lat", "t.e_lon", "r.e_lat", "r.e_lon")} * 1000 > 200) AND r.h IS DISTINCT FROM t.h))"""

RULE_COUNT = 1000
CATEGORIES = ("cafe", "museum", "park")


def named_places(spark, sf):
    """Places with a name that ends in a code, and an address, for each customer."""
    k = F.col("c_custkey")
    code = F.substring(F.md5(F.pmod(k, F.lit(1500)).cast("string")), 1, 9)
    address = F.concat(F.lit("Shop "), k.cast("string"), F.lit(", "), _pick([d[0] for d in DISTRICTS] + ["Nowhere"], k / 2), F.lit(" Road"))
    return customers(spark, sf).select(k.alias("pid"), F.concat(_pick(NAMES, k), F.lit(" "), code, F.when(k % 3 == 0, " Annex").otherwise("")).alias("name"), _pick(CATEGORIES, k / 3).alias("category"), "lat", "lon", address.alias("address"))


def rule_places(spark, sf):
    """Places that 1,000 rules name: every fourth rule within a circle, every third for one category."""
    i = F.col("id")
    rules = spark.range(RULE_COUNT).select(
        i.alias("rule"), F.concat(F.lit(r"\b"), F.substring(F.md5(i.cast("string")), 1, 9), F.lit(r"(?: annex)?$")).alias("pattern"), F.when(i % 4 == 0, 25.05).alias("lat"), F.when(i % 4 == 0, 55.2).alias("lon"),
        F.when(i % 4 == 0, 20.0).alias("km"), F.when(i % 3 == 0, _pick(CATEGORIES, i)).alias("category"),
    )
    return matching.rule_matches(named_places(spark, sf), "pid", F.array(F.lower("name")), rules)


RULE_PLACES = f"""
WITH r AS (SELECT range AS rule, md5(range::VARCHAR)[:9] AS code, CASE WHEN range % 3 = 0 THEN {_texts(CATEGORIES)}[range % 3 + 1] END AS category FROM range({RULE_COUNT})
), p AS (SELECT c_custkey AS pid, md5((c_custkey % 1500)::VARCHAR)[:9] AS code, {_texts(CATEGORIES)}[c_custkey // 3 % 3 + 1] AS category, lat, lon FROM ({SQL_CUSTOMERS}))
SELECT pid, rule FROM p JOIN r ON p.code = r.code AND (r.category IS NULL OR r.category = p.category) AND (rule % 4 <> 0 OR {sql_km("lat", "lon", "25.05::DOUBLE", "55.2::DOUBLE")} <= 20)"""

#: District, its pattern, centre and radius.
DISTRICTS = (("Blue Harbour", r"\bblue harbou?r\b", 25.08, 55.14, 9.0), ("Old Quarter", r"\bold quarter\b|\bsouk side\b", 25.26, 55.3, 8.0), ("Garden Hills", r"\bgarden hills?\b", 25.1, 55.24, 10.0), ("West Gate", r"\bwest gate\b", 24.95, 55.0, 12.0))


def address_verdicts(spark, sf):
    """Whether the points of all places agree with the districts in their addresses."""
    districts = spark.createDataFrame([(d[0], *d[1:]) for d in DISTRICTS], "rule string, pattern string, lat double, lon double, km double")
    return matching.place_verdicts(named_places(spark, sf), "pid", "address", districts)


ADDRESS_VERDICTS = f"""
WITH d(name, lat0, lon0, km) AS (VALUES {", ".join(f"('{n}', {y!r}::DOUBLE, {x!r}::DOUBLE, {k!r}::DOUBLE)" for n, _, y, x, k in DISTRICTS)}
), p AS (SELECT c_custkey AS pid, {_texts([d[0] for d in DISTRICTS] + ["Nowhere"])}[c_custkey // 2 % {len(DISTRICTS) + 1} + 1] AS name, lat, lon FROM ({SQL_CUSTOMERS}))
SELECT pid, CASE WHEN d.name IS NULL THEN 'unknown' WHEN {sql_km("lat", "lon", "lat0", "lon0")} <= km THEN 'ok' ELSE 'contra' END AS verdict FROM p LEFT JOIN d USING (name)"""

# Words that hotels share, and words that tell where they are.
HOTEL_WORDS = "and apartment apartments by deluxe grand hotel hotels inn luxury of palace plaza premium residence resort resorts royal spa suite suites the".split()
LOCAL_WORDS = "airport bay beach center centre city creek deira downtown hills lake marina mall palm park road tower towers".split()
BRANDS = ("Azure", "Cedar", "Onyx", "Jade", "Opal", "Ivory")


def _hotels(spark, sf, shift: int):
    k = F.col("c_custkey")
    place = _pick(("Marina", "Deira City Centre", "Downtown", "Palm"), k / 3)
    name = F.concat(F.lit("Hotel "), _pick(BRANDS, k), F.lit(" "), _pick(BRANDS, k / 6), F.lit(" "), place) if not shift else F.concat(F.lit("The "), _pick(BRANDS, k + F.pmod(k, F.lit(2))), F.lit(" "), _pick(BRANDS, k / 6), F.lit(" "), place, F.lit(" Resort & Spa"))
    return customers(spark, sf).select((k * 10 + shift).alias("pid"), name.alias("name"), (F.col("lat") + shift * 0.0004).alias("lat"), (F.col("lon") + F.pmod(k, F.lit(5)) * shift * 0.0008).alias("lon"))


def hotel_doubles(spark, sf):
    """Hotels of one list that stand in another one under a name of mostly the same words."""
    return matching.doubles_by_words(_hotels(spark, sf, 0), _hotels(spark, sf, 1), tuple(HOTEL_WORDS), tuple(LOCAL_WORDS))


_hotel_words = lambda name: f"list_distinct(list_filter(string_split(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) >= 3 AND NOT list_contains({_texts(HOTEL_WORDS)}, w)))"
HOTEL_DOUBLES = f"""
WITH c AS (SELECT *, {_texts(BRANDS)} AS b, {_texts(("Marina", "Deira City Centre", "Downtown", "Palm"))}[c_custkey // 3 % 4 + 1] AS place FROM ({SQL_CUSTOMERS})
), x AS (SELECT c_custkey * 10 AS pid, lat, lon, {_hotel_words("'Hotel ' || b[c_custkey % 6 + 1] || ' ' || b[c_custkey // 6 % 6 + 1] || ' ' || place")} AS w FROM c
), y AS (SELECT c_custkey * 10 + 1 AS double, lat + 0.0004::DOUBLE AS y_lat, lon + c_custkey % 5 * 0.0008::DOUBLE AS y_lon, {_hotel_words("'The ' || b[(c_custkey + c_custkey % 2) % 6 + 1] || ' ' || b[c_custkey // 6 % 6 + 1] || ' ' || place || ' Resort & Spa'")} AS v FROM c)
SELECT pid, max(double) AS double FROM x JOIN y ON abs(lat - y_lat) < 0.005 AND abs(lon - y_lon) < 0.005
WHERE len(list_intersect(w, v)) >= 0.5 * len(list_distinct(list_concat(w, v))) AND len(list_filter(list_intersect(w, v), lambda t: NOT list_contains({_texts(LOCAL_WORDS)}, t))) > 0 AND {sql_km("lat", "lon", "y_lat", "y_lon")} <= 0.25 GROUP BY pid"""

#: A coast of 240 short segments.
COAST_POINTS = 240
COAST = [(24.8 + 0.0022 * i, 55.05 + 0.002 * i + 0.02 * math.sin(i / 9)) for i in range(COAST_POINTS + 1)]


def _line_table(spark, lines):
    rows = [(name, [(*a, *b) for a, b in zip(points, points[1:])]) for name, points in lines.items()]
    return spark.createDataFrame(rows, "line string, edges array<struct<y1:double,x1:double,y2:double,x2:double>>")


def coast_places(spark, sf):
    """Customers at most 500 m from the coast, with the distance in metres."""
    near = matching.near_lines(customers(spark, sf).select("c_custkey", "lat", "lon"), "c_custkey", _line_table(spark, {"coast": COAST}), 500)
    return near.select("c_custkey", F.round("metres", 4).alias("metres"))


_north = "6371000.0::DOUBLE * radians(1.0::DOUBLE)"
_segment_sql = f"""SELECT *, CASE WHEN l = 0 THEN 0 ELSE greatest(0, least(1, -(a * (c - a) + b * (d - b)) / l)) END AS t FROM (
    SELECT *, (c - a) * (c - a) + (d - b) * (d - b) AS l FROM (
      SELECT c_custkey, line, (y1 - lat) * {_north} AS a, (x1 - lon) * cos(radians(lat)) * {_north} AS b, (y2 - lat) * {_north} AS c, (x2 - lon) * cos(radians(lat)) * {_north} AS d FROM ({SQL_CUSTOMERS}) p, s
      WHERE lat BETWEEN least(y1, y2) - 0.01 AND greatest(y1, y2) + 0.01 AND lon BETWEEN least(x1, x2) - 0.01 AND greatest(x1, x2) + 0.01))"""
_segments = lambda line, points: ", ".join(f"('{line}', {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for a, b in zip(points, points[1:]))
COAST_PLACES = f"""
WITH s(line, y1, x1, y2, x2) AS (VALUES {_segments("coast", COAST)}), m AS ({_segment_sql})
SELECT c_custkey, round(min(sqrt((a + t * (c - a)) * (a + t * (c - a)) + (b + t * (d - b)) * (b + t * (d - b)))), 4) AS metres FROM m GROUP BY c_custkey HAVING metres <= 500"""

#: The home region with a hole, and its buffer in metres.
HOME = {"home": (((24.9, 55.0), (25.2, 55.05), (25.25, 55.4), (24.95, 55.35)), ((25.05, 55.15), (25.1, 55.15), (25.1, 55.2), (25.05, 55.2)))}
BUFFER_METRES = 400


def home_places(spark, sf):
    """Customers in the home region or at most 400 m from its edge, the hole's included."""
    points = customers(spark, sf).select("c_custkey", "lat", "lon")
    inside = regions.inside(points, regions.region_table(spark, HOME), "c_custkey").select("c_custkey", F.lit(True).alias("inside"))
    rings = _line_table(spark, {f"{name}{i}": [*ring, ring[0]] for name, parts in HOME.items() for i, ring in enumerate(parts)})
    edge = matching.near_lines(points, "c_custkey", rings, BUFFER_METRES).select("c_custkey").distinct().withColumn("edge", F.lit(True))
    return inside.join(edge, "c_custkey", "full").select("c_custkey", F.col("inside").isNotNull().alias("inside"), F.col("edge").isNotNull().alias("at_edge"))


_ring_segments = ", ".join(_segments(f"home{i}", [*ring, ring[0]]) for i, ring in enumerate(HOME["home"]))
HOME_PLACES = f"""
WITH s(line, y1, x1, y2, x2) AS (VALUES {_ring_segments}), m AS ({_segment_sql.replace("- 0.01 AND", "- 0.02 AND").replace("+ 0.01)", "+ 0.02)")}
), edge AS (SELECT c_custkey FROM m GROUP BY c_custkey HAVING min(sqrt((a + t * (c - a)) * (a + t * (c - a)) + (b + t * (d - b)) * (b + t * (d - b)))) <= {BUFFER_METRES}
), inside AS (SELECT c_custkey FROM ({SQL_CUSTOMERS}), s GROUP BY c_custkey HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1)
SELECT c_custkey, i.c_custkey IS NOT NULL AS inside, e.c_custkey IS NOT NULL AS at_edge FROM customer LEFT JOIN inside i USING (c_custkey) LEFT JOIN edge e USING (c_custkey) WHERE inside OR at_edge"""

TOPICS = ("sushi", "food", "museum", "park", "beach")


def page_pictures(spark, sf):
    """A picture for each order on its customer's page, of up to three topics with one to five pictures each; the first topics have none."""
    k = F.col("o_orderkey")
    topics = F.slice(F.array(_pick(("none", *TOPICS), k), _pick(TOPICS, k / 3), _pick(TOPICS, k / 5)), F.lit(1), F.pmod(k, F.lit(4)).cast("int"))
    cards = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), k.alias("position"), k.cast("string").alias("card"), topics.alias("keys"))
    pool = spark.createDataFrame([(t, i, f"{t}-{i}") for n, t in enumerate(TOPICS) for i in range(n + 1)] + [("food", 9, "sushi-0")], "key string, number int, url string")
    return picks.page_picks(cards, pool)


_POOL = ", ".join(f"('{t}', {i}, '{t}-{i}')" for n, t in enumerate(TOPICS) for i in range(n + 1)) + ", ('food', 9, 'sushi-0')"
PAGE_PICTURES = f"""
WITH RECURSIVE pool AS (SELECT key, list(url ORDER BY number) AS urls FROM (VALUES {_POOL}) v(key, number, url) GROUP BY key
), cards AS (
  SELECT o_custkey AS page, o_orderkey AS position, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
         list_slice([{_texts(("none", *TOPICS))}[o_orderkey % {len(TOPICS) + 1} + 1], {_texts(TOPICS)}[o_orderkey // 3 % {len(TOPICS)} + 1], {_texts(TOPICS)}[o_orderkey // 5 % {len(TOPICS)} + 1]], 1, o_orderkey % 4) AS keys,
         list_reduce(list_prepend(0::BIGINT, list_transform(string_split(o_orderkey::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM orders
), offers AS (
  SELECT page, position, n, list({{'key': key, 'url': url}} ORDER BY rank, i) AS offers
  FROM (SELECT c.page, c.position, c.n, rank, c.keys[rank] AS key, i, urls[(h + i) % len(urls) + 1] AS url FROM cards c, range(1, 4) a(rank), pool, range(0, 6) b(i) WHERE rank <= len(c.keys) AND pool.key = c.keys[rank] AND i < len(urls)) GROUP BY page, position, n
), ready AS (SELECT c.page, c.position, c.n, coalesce(o.offers, []) AS offers FROM cards c LEFT JOIN offers o USING (page, position, n)
), fold AS (
  SELECT page, 0::BIGINT AS n, NULL::BIGINT AS position, []::VARCHAR[] AS used, NULL::STRUCT(key VARCHAR, url VARCHAR) AS pick FROM (SELECT DISTINCT page FROM cards)
  UNION ALL
  SELECT page, n, position, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.url) END, pick
  FROM (SELECT r.page, r.n, r.position, f.used, coalesce(list_filter(r.offers, lambda o: NOT list_contains(f.used, o.url))[1], r.offers[1]) AS pick FROM fold f JOIN ready r ON r.page = f.page AND r.n = f.n + 1)
)
SELECT page, position, pick.key AS key, pick.url AS url FROM fold WHERE n > 0"""

WITH_SQL = "site_matches rule_places address_verdicts hotel_doubles coast_places home_places page_pictures".split()
QUERIES = {n: globals()[n] for n in WITH_SQL}
ORACLE_SQL = {n: globals()[n.upper()] for n in WITH_SQL}
