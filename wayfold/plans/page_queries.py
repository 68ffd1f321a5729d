"""Queries over nested page data, feeds of events, adaptive cells and written hours, all from data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import hours, schedule
from wayfold.operators import event_fold, quad
from wayfold.operators.lineage import broadcast_if_small, cut
from wayfold.sources import linked
from wayfold.sources.tables import HEIGHT, SOUTH, SQL_CUSTOMERS, WEST, WIDTH, customers, spread, table


def event_pages(spark, sf):
    """A page for each order: an event with a sub-event below k % 5 wrappers of two levels, a series, a broken block, one with a comma too many."""
    k = F.col("o_orderkey")
    text, day, m = k.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.pmod(k, F.lit(5)).cast("int")
    sub = F.concat(F.lit('"subEvent":[{"@type":["Thing","https://schema.org/MusicEvent"],"name":"Sub &amp; '), text, F.lit('","startDate":"'), day, F.lit('"}]'))
    node = F.concat(F.lit('{"@type":"Event","name":"Event '), text, F.lit('","startDate":"'), day, F.lit('","offers":[{"price":0},{"price":"'), F.pmod(k, F.lit(90)).cast("string"), F.lit('"}],'), sub, F.lit("}"))
    nested = F.concat(F.repeat(F.lit('{"@graph":['), m), node, F.repeat(F.lit("]}"), m))
    items = F.concat(F.lit('{"itemListElement":[{"item":{"@type":"EventSeries","name":"No","startDate":"x"}},{"item":{"@type":"ComedyEvent","name":["Item"],"startDate":"'), day, F.lit('",}}]}'))
    script = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    html = F.concat(F.lit("<html>"), script(F.lit('{"@type":"Event",')), script(nested), F.when(k % 3 == 0, script(items)).otherwise(""), F.lit("<p>x</p></html>"))
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", html.alias("html"))


def nested_events(spark, sf):
    """Events of the pages of all orders, at depths of at most 6."""
    return linked.events(event_pages(spark, sf), "o_orderkey", "html").select("o_orderkey", "position", "depth", "name", "starts", "price")


#: The walk in recursive SQL, over blocks written by the same rule.
NESTED_EVENTS = """
WITH RECURSIVE b AS (
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 5 AS m FROM orders
), blocks AS (
  SELECT o_orderkey, 0 AS n, (repeat('{"@graph":[', m) || '{"@type":"Event","name":"Event ' || o_orderkey || '","startDate":"' || day || '","offers":[{"price":0},{"price":"' || (o_orderkey % 90)
    || '"}],"subEvent":[{"@type":["Thing","https://schema.org/MusicEvent"],"name":"Sub &amp; ' || o_orderkey || '","startDate":"' || day || '"}]}' || repeat(']}', m))::JSON AS node FROM b
  UNION ALL
  SELECT o_orderkey, 1, ('{"itemListElement":[{"item":{"@type":"EventSeries","name":"No","startDate":"x"}},{"item":{"@type":"ComedyEvent","name":["Item"],"startDate":"' || day || '"}}]}')::JSON FROM b WHERE o_orderkey % 3 = 0
), walk AS (
  SELECT o_orderkey, [n] AS path, 0 AS depth, node FROM blocks
  UNION ALL
  SELECT o_orderkey, list_append(path, i), depth + 1, kids[i + 1]
  FROM (SELECT *, unnest(range(len(kids))) AS i FROM (
    SELECT *, CASE json_type(node) WHEN 'ARRAY' THEN json_extract(node, '$[*]')
      WHEN 'OBJECT' THEN list_filter([json_extract(node, '$."@graph"'), json_extract(node, '$.itemListElement'), CASE WHEN json_type(json_extract(node, '$.item')) = 'OBJECT' THEN json_extract(node, '$.item') END, json_extract(node, '$.subEvent')], lambda x: x IS NOT NULL) END AS kids
    FROM walk WHERE depth < 6))
), told AS (
  SELECT *, CASE json_type(json_extract(node, '$."@type"')) WHEN 'ARRAY' THEN list_transform(json_extract(node, '$."@type"[*]'), lambda x: json_extract_string(x, '$')) ELSE [json_extract_string(node, '$."@type"')] END AS types FROM walk WHERE json_type(node) = 'OBJECT'
), found AS (
  SELECT * FROM told WHERE len(list_filter(types, lambda t: regexp_matches(t, 'Event$'))) > 0 AND json_extract(node, '$.name') IS NOT NULL AND json_extract(node, '$.startDate') IS NOT NULL
), priced AS (
  SELECT *, list_transform(coalesce(json_extract(node, '$.offers[*]'), []), lambda o: TRY_CAST(json_extract_string(o, '$.price') AS DOUBLE)) AS prices FROM found
)
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY path) - 1)::INTEGER AS position, depth::INTEGER AS depth,
       replace(CASE json_type(json_extract(node, '$.name')) WHEN 'ARRAY' THEN json_extract_string(node, '$.name[0]') ELSE json_extract_string(node, '$.name') END, '&amp;', '&') AS name, json_extract_string(node, '$.startDate') AS starts,
       coalesce(list_min(list_filter(prices, lambda p: p > 0)), list_min(list_filter(prices, lambda p: p = 0))) AS price
FROM priced"""


def venue_pages(spark, sf):
    """A page for each supplier: a restaurant below s % 8 wrappers of two levels with a branch beside it, a product, and for every tenth a list of 230 cafes."""
    k = F.col("s_suppkey")
    text, m = k.cast("string"), F.pmod(k, F.lit(8)).cast("int")
    node = F.concat(F.lit('{"@type":["Restaurant"],"name":"House '), text, F.lit('","telephone":"+971'), text, F.lit('","geo":{"latitude":"25.'), text, F.lit('","longitude":55.2},"address":{"streetAddress":"'), text,
                    F.lit(' Road","addressCountry":{"name":"AE"}},"review":{"@type":"Hotel","name":"hidden"},"openingHours":["Mo-Fr 10:00-20:00",7],"department":{"priceRange":"$$"}}'))
    nested = F.concat(F.repeat(F.lit('{"b":['), m), node, F.repeat(F.lit("]}"), m))
    cafes = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(230)), lambda i: F.concat(F.lit('{"@type":"CafeOrCoffeeShop","name":"Cafe '), i.cast("string"), F.lit('"}'))), ",")
    page = F.concat(F.lit('{"a":'), nested, F.lit(',"c":{"@type":"Product","priceRange":"x","name":"p"}'), F.when(k % 10 == 0, F.concat(F.lit(',"z":['), cafes, F.lit("]"))).otherwise(""), F.lit("}"))
    return spread(table(spark, sf, "supplier").select("s_suppkey")).select("s_suppkey", F.concat(F.lit('<script type="application/ld+json"><!--'), page, F.lit("--></script>")).alias("html"))


def nested_venues(spark, sf):
    """The first 200 venues of the pages of all suppliers, at depths of at most 12."""
    found = linked.venues(venue_pages(spark, sf), "s_suppkey", "html")
    return found.select("s_suppkey", "position", "depth", F.array_join("types", ",").alias("types"), "name", "phone", "price_range", "address", F.col("point.lat").alias("lat"), F.array_join("hours", "; ").alias("hours"))


NESTED_VENUES = """
WITH RECURSIVE pages AS (
  SELECT s_suppkey, ('{"a":' || repeat('{"b":[', s_suppkey % 8) || '{"@type":["Restaurant"],"name":"House ' || s_suppkey || '","telephone":"+971' || s_suppkey || '","geo":{"latitude":"25.' || s_suppkey
    || '","longitude":55.2},"address":{"streetAddress":"' || s_suppkey || ' Road","addressCountry":{"name":"AE"}},"review":{"@type":"Hotel","name":"hidden"},"openingHours":["Mo-Fr 10:00-20:00",7],"department":{"priceRange":"$$"}}'
    || repeat(']}', s_suppkey % 8) || ',"c":{"@type":"Product","priceRange":"x","name":"p"}'
    || CASE WHEN s_suppkey % 10 = 0 THEN ',"z":[' || array_to_string(list_transform(range(1, 231), lambda i: '{"@type":"CafeOrCoffeeShop","name":"Cafe ' || i || '"}'), ',') || ']' ELSE '' END || '}')::JSON AS node FROM supplier
), walk AS (
  SELECT s_suppkey, [0] AS path, 0 AS depth, node FROM pages
  UNION ALL
  SELECT s_suppkey, list_append(path, i), depth + 1, kids[i + 1]
  FROM (SELECT *, unnest(range(len(kids))) AS i FROM (
    SELECT *, CASE json_type(node) WHEN 'ARRAY' THEN json_extract(node, '$[*]') WHEN 'OBJECT' THEN list_filter(
      list_transform(list_filter(list_sort(json_keys(node)), lambda k: k NOT IN ('review', 'reviews', 'aggregateRating', 'image', 'logo', 'offers', 'author', 'publisher', 'breadcrumb')), lambda k: json_extract(node, '$."' || k || '"')),
      lambda v: json_type(v) IN ('ARRAY', 'OBJECT')) END AS kids
    FROM walk WHERE depth < 12))
), found AS (
  SELECT *, coalesce(json_extract_string(node, '$."@type"[0]'), json_extract_string(node, '$."@type"')) AS kind FROM walk
  WHERE json_type(node) = 'OBJECT' AND coalesce(json_extract_string(node, '$."@type"[0]'), json_extract_string(node, '$."@type"'), '') <> 'Product' AND (coalesce(json_extract_string(node, '$."@type"[0]'), json_extract_string(node, '$."@type"')) IN ('Restaurant', 'CafeOrCoffeeShop') OR json_extract(node, '$.priceRange') IS NOT NULL)
)
SELECT s_suppkey, (row_number() OVER (PARTITION BY s_suppkey ORDER BY path) - 1)::INTEGER AS position, depth::INTEGER AS depth, coalesce(kind, '') AS types, json_extract_string(node, '$.name') AS name, json_extract_string(node, '$.telephone') AS phone, json_extract_string(node, '$.priceRange') AS price_range,
       (json_extract_string(node, '$.address.streetAddress')) || ', ' || (json_extract_string(node, '$.address.addressCountry.name')) AS address, round(json_extract_string(node, '$.geo.latitude')::DOUBLE, 6) AS lat, coalesce((json_extract_string(node, '$.openingHours[0]')) || '; ' || (json_extract_string(node, '$.openingHours[1]')), '') AS hours
FROM found QUALIFY position < 200"""


def event_feed(spark, sf):
    """An event of three sources for each order, of the customer's act in one of 400 halls; sources write titles, venues and places in their own ways."""
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate")
    kind = F.pmod(F.floor(k / 3), F.lit(3)).cast("int")
    pick = lambda *x: F.get(F.array(*x), kind)
    act, hall = F.concat(F.lit("Artist"), c.cast("string")), F.concat(F.lit("Hall "), F.pmod(c, F.lit(400)).cast("string"), F.lit("x"))
    troupe = F.concat(F.lit("Troupe"), F.pmod(c, F.lit(50)).cast("string"))
    at = lambda factor, low: F.lit(low) + F.pmod(F.pmod(c, F.lit(400)) * factor, F.lit(1000)) / 1000.0 * F.lit(0.4) + F.pmod(k, F.lit(3)) / 10000.0
    none = F.lit(None)
    return table(spark, sf, "orders").select(
        k.alias("key"),
        pick(F.concat(act, F.lit(" & "), troupe, F.lit(" Live")), F.concat(hall, F.lit(": "), act, F.lit(" with "), troupe), F.concat(act, F.lit(" Tour"))).alias("name"),
        pick(F.concat(hall, F.lit(", Dubai")), F.concat(F.lit("The "), hall), none).alias("venue"),
        pick(none, at(379, 25.0), at(379, 25.0)).alias("lat"), pick(none, at(617, 55.0), at(617, 55.0)).alias("lon"),
        day.alias("day_start"), F.date_add(day, (F.pmod(k * 5, F.lit(40)) + 1).cast("int")).alias("day_end"),
        F.when(k % 7 == 0, F.array(day, F.date_add(day, 1))).otherwise(F.array().cast("array<date>")).alias("days"),
        F.array(F.get(F.array(*map(F.lit, event_fold.TAGS)), F.pmod(k, F.lit(8)).cast("int"))).alias("tags"),
        F.when(k % 5 != 0, F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("price"), F.when(k % 2 == 0, "19:30").alias("time"),
        pick(*(F.lit(x) for x in ("venue", "guide", "tickets"))).alias("source"), F.concat(F.lit("https://e.example/"), k.cast("string")).alias("url"),
    )


def folded_events(spark, sf):
    """The feed's events, each row joined to the first listed event that is the same."""
    told = event_fold.dedupe(event_feed(spark, sf))
    return told.select("key", "members", "name", "venue", "day_start", "day_end", "price", "time", F.array_join("tags", ",").alias("tags"), "source", "url", F.size("also").alias("also"))


BOX = (SOUTH, WEST, SOUTH + HEIGHT, WEST + WIDTH)
QUAD_CAP, QUAD_DEPTH = 12, 4


def quad_cells(spark, sf):
    """Cells of the box with fewer than 12 customers of a segment, or of the fourth cut."""
    return quad.quad_cells(customers(spark, sf), BOX, QUAD_CAP, QUAD_DEPTH, ("c_mktsegment",))


QUAD_CELLS = f"""
WITH RECURSIVE p AS (SELECT c_mktsegment, lat, lon FROM ({SQL_CUSTOMERS})
), cells AS (
  SELECT DISTINCT c_mktsegment, '' AS cell, 0 AS level, {BOX[0]!r}::DOUBLE AS south, {BOX[1]!r}::DOUBLE AS west, {BOX[2]!r}::DOUBLE AS north, {BOX[3]!r}::DOUBLE AS east FROM p
  UNION ALL
  SELECT c_mktsegment, cell || q, level + 1, CASE WHEN q < 2 THEN south ELSE (south + north) / 2 END, CASE WHEN q % 2 = 0 THEN west ELSE (west + east) / 2 END,
         CASE WHEN q < 2 THEN (south + north) / 2 ELSE north END, CASE WHEN q % 2 = 0 THEN (west + east) / 2 ELSE east END
  FROM cells c, (VALUES (0), (1), (2), (3)) v(q)
  WHERE level < {QUAD_DEPTH} AND {QUAD_CAP} <= (SELECT count(*) FROM p WHERE p.c_mktsegment = c.c_mktsegment AND p.lat >= c.south AND p.lon >= c.west AND (p.lat < c.north OR c.north = {BOX[2]!r}::DOUBLE) AND (p.lon < c.east OR c.east = {BOX[3]!r}::DOUBLE))
), counted AS (
  SELECT c.*, (SELECT count(*) FROM p WHERE p.c_mktsegment = c.c_mktsegment AND p.lat >= c.south AND p.lon >= c.west AND (p.lat < c.north OR c.north = {BOX[2]!r}::DOUBLE) AND (p.lon < c.east OR c.east = {BOX[3]!r}::DOUBLE)) AS points FROM cells c
)
SELECT c_mktsegment, cell, level::INTEGER AS level, points, points >= {QUAD_CAP} AS "full", round(south, 9) AS south, round(west, 9) AS west, round(north, 9) AS north, round(east, 9) AS east
FROM counted WHERE points < {QUAD_CAP} OR level = {QUAD_DEPTH}"""


def hour_specs(spark, sf):
    """Four specification rows of days and times for each customer, in several ways of writing; every fifth customer's last row is about special days."""
    k = F.col("c_custkey")
    names = F.array(*map(F.lit, ("Monday", "https://schema.org/Tuesday", "We", "thursday", "Fri", "Saturdays", "Su")))
    clock = lambda m: F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))
    spoken = lambda m: F.concat(F.when(F.floor(m / 60) % 12 == 0, 12).otherwise(F.floor(m / 60) % 12).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.when(m >= 720, " pm").otherwise(" a.m."))

    def row(j):
        opens = (k * 7 + j * 5) % 20 * 30 + 360
        closes = opens + ((k * 3 + j) % 16 + 1) * 45
        day = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: (k + j * 3 + d * (j + 1)) % 4 != 0)
        ends = F.when(closes >= 1440, closes - 1440).otherwise(closes)
        dated = F.when((k % 5 == 0) & F.lit(j == 3), "2026-03-01")
        return F.struct(
            F.transform(day, lambda d: F.substring_index(F.get(names, d.cast("int")), "/", -1)).alias("days"),
            (spoken(opens) if j == 1 else F.concat(clock(opens), F.lit(":00+04:00"))).alias("opens"), clock(ends).alias("closes"), dated.alias("valid_from"), F.when(dated.isNotNull(), "2026-04-01").alias("valid_to"),
        )

    return spread(table(spark, sf, "customer").select("c_custkey")).select("c_custkey", F.array(*map(row, range(4))).alias("rows"))


def hours_written(spark, sf):
    """The customers' specifications as opening-hours text, whether it is valid, and its minutes a week as read back."""
    # Specifications are written the same by many: each is turned into text once and joined back, told apart by its JSON.
    specs = hour_specs(spark, sf).withColumn("spec", F.to_json("rows"))
    told = cut(spread(specs.select("spec", "rows").dropDuplicates(["spec"])).select("spec", schedule.write_week(schedule.spec_week(F.col("rows"))).alias("hours")))
    read = told.select("hours").distinct().withColumn("week", hours.week_of(F.col("hours")))
    open_ = F.aggregate(F.flatten("week"), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    minutes = read.select("hours", F.when(F.col("week").isNotNull(), open_).alias("minutes"))
    full = told.join(minutes.filter("hours is not null"), "hours", "left").select("spec", "hours", schedule.valid_hours(F.col("hours")).alias("valid"), "minutes")
    return specs.select("c_custkey", "spec").join(broadcast_if_small(cut(full)), "spec").select("c_custkey", "hours", "valid", "minutes")


HOURS_WRITTEN = """
WITH base AS (
  SELECT c_custkey AS k, j, d, (c_custkey * 7 + j * 5) % 20 * 30 + 360 AS o, (c_custkey * 7 + j * 5) % 20 * 30 + 360 + ((c_custkey * 3 + j) % 16 + 1) * 45 AS e
  FROM customer, range(4) a(j), range(7) b(d) WHERE (c_custkey + j * 3 + d * (j + 1)) % 4 <> 0 AND NOT (c_custkey % 5 = 0 AND j = 3)
), bad AS (SELECT DISTINCT k FROM base WHERE e > 1440 + 720
), swept AS (
  SELECT *, sum(CASE WHEN o <= high THEN 0 ELSE 1 END) OVER (PARTITION BY k, d ORDER BY o, e) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY k, d ORDER BY o, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM base)
), spans AS (SELECT k, d, min(o) AS o, max(e) AS e FROM swept GROUP BY k, d, island
), days AS (
  SELECT k, d, string_agg(printf('%02d:%02d-%02d:%02d', o // 60, o % 60, (CASE WHEN e > 1440 THEN e - 1440 ELSE e END) // 60, e % 60), ',' ORDER BY o) AS said,
         bool_or(e - o >= 1440) OR (count(*) > 1 AND max(e) - 1440 > min(o)) AS wrong, sum(e - o) AS minutes
  FROM spans GROUP BY k, d
), runs AS (
  SELECT k, said, min(d) AS a, max(d) AS z FROM (SELECT *, d - row_number() OVER (PARTITION BY k, said ORDER BY d) AS g FROM days) GROUP BY k, said, g
), named AS (
  SELECT k, said, min(a) AS first_day, string_agg(names[a + 1] || CASE z - a WHEN 0 THEN '' WHEN 1 THEN ',' || names[z + 1] ELSE '-' || names[z + 1] END, ',' ORDER BY a) AS days
  FROM runs, (SELECT ['Mo', 'Tu', 'We', 'Th', 'Fr', 'Sa', 'Su'] AS names) GROUP BY k, said
), texts AS (SELECT k, string_agg(days || ' ' || said, '; ' ORDER BY first_day) AS hours FROM named GROUP BY k
), totals AS (SELECT k, sum(minutes) AS minutes, bool_or(wrong) AS wrong FROM days GROUP BY k)
SELECT c_custkey, CASE WHEN NOT wrong AND bad.k IS NULL THEN hours END AS hours, coalesce(NOT wrong AND bad.k IS NULL, FALSE) AS valid, CASE WHEN NOT wrong AND bad.k IS NULL THEN minutes::INTEGER END AS minutes
FROM customer LEFT JOIN texts t ON t.k = c_custkey LEFT JOIN totals u ON u.k = c_custkey LEFT JOIN bad ON bad.k = c_custkey"""

WITH_SQL = "nested_events nested_venues quad_cells hours_written".split()
#: Without SQL: an order-dependent fold that tests compare with plain Python.
QUERIES = {n: globals()[n] for n in WITH_SQL} | {"folded_events": folded_events}
ORACLE_SQL = {n: globals()[n.upper()] for n in WITH_SQL}
