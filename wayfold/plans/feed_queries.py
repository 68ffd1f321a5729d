"""Queries of feeds and texts as they come in: hours, XML, JSON lines, robots files, dates in words, names, arguments, addresses, points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import dates, geo, guards, hours, text
from wayfold.operators import sinks
from wayfold.sources import feeds
from wayfold.sources.tables import located, table

#: Opening-hours texts with their minutes a week, what a card says on a Monday at 11:00, and whether an eatery may have them.
HOURS = (
    ("Mo-Th 09:30-21:00; Fr-Su 10:00-23:30", 5190, "Open today 09:30–21:00", True),
    ("every day 13:15-20:45", 3150, "Closed now · opens 13:15", True),
    ("weekdays 8am-9:30am", 450, "Closed now · opens tomorrow 08:00", False),
    ("noon - 7:30 pm", 3150, "Closed now · opens 12:00", True),
    ("понедельник-среда 14:00-01:00, воскресенье 15:00-19:00", 2220, "Closed now · opens 14:00", True),
    ("around the clock", 10080, "Open 24 hours", True),
    ("Mo 10:30-24:00; Tu-Su 10:30-02:30", 6570, "Open today 10:30–00:00", True),
    ("Wed-Thu 00:00-11:45", 1410, "Closed now · opens Wed 00:00", False),
    ("11:30-11:30", 10080, "Open now · until 11:30", False),
    ("Mondays closed, Tu-Su 17:45-00:45", 2520, "Closed now · opens tomorrow 17:45", True),
    ("ask at the door", None, None, True),
    ("ежедневно 10:15-18:00; воскресенья выходной", 2790, "Open today 10:15–18:00", True),
)


def hours_cards(spark, sf):
    """Minutes a week, the card's sentence and the sanity of hours, each distinct text read once."""
    said = F.element_at(F.array(*(F.lit(h[0]) for h in HOURS)), (F.pmod(F.col("c_custkey"), F.lit(len(HOURS))) + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", said.alias("said"))
    week, day, minute = F.col("week"), F.lit(1), F.lit(660)
    read = rows.select("said").distinct().withColumn("week", hours.week_of(F.col("said")))
    open_ = F.aggregate(F.flatten("week"), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    told = read.select("said", F.when(week.isNotNull(), open_).alias("minutes"), hours.summary(week, day, minute).alias("card"), hours.sane(F.col("said"), week, F.lit(True)).alias("sane"))
    return rows.join(told, "said").select("c_custkey", "minutes", "card", "sane")


_quoted = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else str(v)
HOURS_CARDS = f"""
WITH h(k, minutes, card, sane) AS (VALUES {", ".join(f"({k}, {_quoted(m)}, {_quoted(c)}, {s})" for k, (_, m, c, s) in enumerate(HOURS))})
SELECT c_custkey, minutes::INTEGER AS minutes, card, sane FROM customer JOIN h ON c_custkey % {len(HOURS)} = k"""


def xml_rows(spark, sf):
    """Orders written as an XML feed of two events each and read back, CDATA and entities decoded."""
    k = F.col("o_orderkey")
    title = F.when(k % 2 == 0, F.concat(F.lit("<![CDATA[Order <"), k.cast("string"), F.lit("> & co]]>"))).otherwise(F.concat(F.lit("Order &lt;"), k.cast("string"), F.lit("&gt; &amp; co")))
    event = lambda kind, price: F.concat(F.lit('<event kind="'), F.lit(kind), F.lit('"><title>'), title, F.lit("</title>\n<start>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</start><price>"), price, F.lit("</price></event>"))
    pages = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("<feed>"), event("first", F.floor("o_totalprice").cast("string")), event("second", F.lit("free")), F.lit("</feed>")).alias("xml"))
    return feeds.xml_events(pages, "o_orderkey", "xml", ["title", "start", "price"]).select("o_orderkey", "position", "title", F.col("start").try_cast("date").alias("start"), F.col("price").try_cast("long").alias("price"))


XML_ROWS = """
SELECT o_orderkey, p.position::INTEGER AS position, 'Order <' || o_orderkey || '> & co' AS title, o_orderdate::DATE AS start, CASE WHEN p.position = 0 THEN floor(o_totalprice)::BIGINT END AS price FROM orders, (VALUES (0), (1)) p(position)"""


def sitemap_locs(spark, sf):
    """The addresses of a sitemap with one entry a page, references decoded and white space trimmed."""
    site = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<urlset><url><loc>\n "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><priority>1</priority></url></urlset>")).alias("xml"))
    return feeds.sitemap(site, "page_id", "xml").select("page_id", "loc")


SITEMAP_LOCS = "SELECT page_id, url AS loc FROM pages"


def json_lines(spark, sf):
    """Events written as JSON lines, every seventh broken: bad lines are skipped, one row a user stays, success preferred, else the last."""
    line = F.to_json(F.struct("user_id", "event_id", (F.col("event_type") != "error").alias("ok")))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 3, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("line"))
    rows = feeds.json_lines(lines, "line", "user_id bigint, event_id bigint, ok boolean")
    return sinks.compact(rows, ["user_id"], F.col("ok"), F.col("event_id")).select("user_id", "event_id", "ok")


JSON_LINES = """
SELECT user_id, event_id, event_type <> 'error' AS ok FROM events WHERE event_id % 7 <> 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'error') DESC, event_id DESC) = 1"""


def json_elements(spark, sf):
    """Elements of a JSON array for each customer; elements without a name or with a bad point are left out."""
    k = F.col("c_custkey")
    array = F.concat(F.lit("[{\"id\":1,\"name\":\""), F.col("c_name"), F.lit("\",\"lat\":25.2},{\"id\":2,\"lat\":25.1},{\"id\":3,\"name\":\"x\",\"lat\":"), (k % 181 - 90).cast("string"), F.lit(".5}]"))
    broken = table(spark, sf, "customer").select("c_custkey", F.when(k % 10 == 9, F.substring(array, 1, 20)).otherwise(array).alias("json"))
    rows = feeds.json_array(broken, "c_custkey", "json", "id bigint, name string, lat double")
    return rows.filter("name is not null and lat between -90 and 90").select("c_custkey", "id", "name", "lat")


JSON_ELEMENTS = """
SELECT c_custkey, e.id::BIGINT AS id, CASE e.id WHEN 1 THEN c_name ELSE 'x' END AS name, CASE e.id WHEN 1 THEN 25.2::DOUBLE ELSE (c_custkey % 181 - 90 || '.5')::DOUBLE END AS lat
FROM customer, (VALUES (1), (3)) e(id) WHERE c_custkey % 10 <> 9 AND (e.id = 1 OR abs((c_custkey % 181 - 90 || '.5')::DOUBLE) <= 90)"""

ROBOTS_FILES = (
    (0, "# all\nUser-agent: *\nDisallow: /en/ # no\nAllow: /en/4\n\nUser-agent: other\nDisallow: /\nSitemap: x"),
    (1, "user-agent: other\nuser-agent: *\nDISALLOW: /de/1\nallow:/de/12\ndisallow:"),
    (2, "User-agent: other\nDisallow: /"),
)


def robots_rules(spark, sf):
    """Pages judged by the robots text of their site (three texts, dealt by id): the group of all agents, the longest rule."""
    rules = feeds.robots_rules(spark.createDataFrame(ROBOTS_FILES, "site long, robots string"), "site", "robots", "*")
    paths = table(spark, sf, "pages").select("page_id", F.pmod("page_id", F.lit(3)).cast("long").alias("site"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?]*)", 1).alias("path"))
    return feeds.robots_decision(paths, rules, "page_id", "site", "path")


ROBOTS_RULES = """
WITH r(site, prefix, allow) AS (VALUES (0, '/en/', false), (0, '/en/4', true), (1, '/de/1', false), (1, '/de/12', true)), p AS (SELECT page_id, page_id % 3 AS site, regexp_extract(url, '^[a-z]+://[^/]+(/[^?]*)', 1) AS path FROM pages)
SELECT page_id, coalesce(first(allow ORDER BY length(prefix) DESC, allow DESC) FILTER (prefix IS NOT NULL), true) AS allowed FROM p LEFT JOIN r ON p.site = r.site AND starts_with(path, prefix) GROUP BY page_id"""


def city_clock(spark, sf):
    """The city's day, weekday and minute of an event, and of the same moment written as a day, without and with a zone."""
    ts = F.col("ts")
    said = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    city = dates.city_time(ts.cast("timestamp"), 4)
    return table(spark, sf, "events").select("event_id", F.to_date(city).alias("day"), dates.weekday(F.to_date(city)).alias("weekday"), (F.hour(city) * 60 + F.minute(city)).alias("minute"), dates.iso_local(said, 4).alias("local"))


CITY_CLOCK = """
WITH e AS (SELECT event_id, ts, ts + INTERVAL 4 HOUR AS c FROM events)
SELECT event_id, c::DATE AS day, dayofweek(c)::INTEGER AS weekday, (hour(c) * 60 + minute(c))::INTEGER AS minute,
  CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE strftime(c, '%Y-%m-%d %H:%M') END AS local FROM e"""


def human_dates(spark, sf):
    """Dates as people write them, read back; nonsense gives null."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 4 == 0, F.date_format(d, "d MMMM yyyy")).when(k % 4 == 1, F.date_format(d, "MMM d, yyyy")).when(k % 4 == 2, F.concat(F.lit("on "), F.date_format(d, "dd MMM yyyy"), F.lit(" at 7"))).otherwise(F.concat(F.lit("32 "), F.date_format(d, "MMMM yyyy")))
    return table(spark, sf, "orders").select("o_orderkey", dates.human_date(said).alias("day"))


HUMAN_DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate::DATE END AS day FROM orders"

PHRASES = ("jazz tonight", "what is on tomorrow", "this weekend please", "next weekend", "anything this week", "next week", "later this month", "next month", "in 10 days", "on friday", "something good", "today")


def event_windows(spark, sf):
    """The days a request asks for, from its words and the day it is made."""
    said = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod("o_orderkey", F.lit(len(PHRASES))) + 1).cast("int"))
    window = dates.asked_window(said, F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", window["since"].alias("since"), window["until"].alias("until"))


EVENT_WINDOWS = """
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 12 AS k FROM orders), w AS (SELECT *, CASE WHEN dayofweek(d) = 0 THEN d ELSE (d + (6 - dayofweek(d))::INTEGER)::DATE END AS sat, CASE WHEN dayofweek(d) = 0 THEN d ELSE (d + (7 - dayofweek(d))::INTEGER)::DATE END AS sun FROM o)
SELECT o_orderkey,
  (CASE k WHEN 1 THEN d + 1 WHEN 2 THEN sat WHEN 3 THEN sat + 7 WHEN 5 THEN sun + 1 WHEN 7 THEN last_day(d) + 1 WHEN 8 THEN d + 10 WHEN 9 THEN d + ((12 - dayofweek(d)) % 7)::INTEGER ELSE d END)::DATE AS since,
  (CASE k WHEN 0 THEN d WHEN 1 THEN d + 1 WHEN 2 THEN sun WHEN 3 THEN sun + 7 WHEN 4 THEN sun WHEN 5 THEN sun + 7 WHEN 6 THEN last_day(d) WHEN 7 THEN last_day(last_day(d) + 1) WHEN 8 THEN d + 10 WHEN 9 THEN d + ((12 - dayofweek(d)) % 7)::INTEGER WHEN 11 THEN d ELSE d + 30 END)::DATE AS until FROM w"""


def name_folds(spark, sf):
    """Names for matching: accents and case folded; without article and city; without stop words, repeats kept."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "The ").otherwise(""), F.lit("Café "), F.col("p_name"), F.lit(" & "), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, " Dubai").otherwise(" Résidence"))
    folded = text.fold(name)
    return table(spark, sf, "part").select("p_partkey", folded.alias("folded"), text.bare_name(folded, "dubai").alias("bare"), F.array_join(text.tokens(folded), " ").alias("words"), F.array_join(text.distinctive(folded, ("cafe", "dubai", "residence")), " ").alias("distinctive"))


NAME_FOLDS = """
WITH n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'the ' ELSE '' END AS the, CASE WHEN p_partkey % 3 = 0 THEN ' dubai' ELSE ' residence' END AS tail FROM part)
SELECT p_partkey, the || 'cafe ' || p_name || ' and ' || p_name || tail AS folded, 'cafe ' || p_name || ' and ' || p_name || CASE WHEN tail = ' dubai' THEN '' ELSE tail END AS bare,
  'cafe ' || p_name || ' ' || p_name || tail AS words, array_to_string(list_filter(string_split(p_name, ' '), lambda x, i: list_position(string_split(p_name, ' '), x) = i), ' ') AS distinctive FROM n"""


def clean_arguments(spark, sf):
    """Arguments of a search made safe: level 1 to 4 or none, distinct sorted ids, a least price above the most is dropped."""
    p = table(spark, sf, "part")
    level = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, "2.0").otherwise("many")
    ids = F.array(F.col("p_name"), F.col("p_brand"), F.lit(""), F.col("p_name"), F.repeat("p_type", F.lit(20)))
    low = F.col("p_size") * 50.0
    return p.select("p_partkey", guards.level(level).alias("level"), F.array_join(guards.ids(ids), "|").alias("ids"), guards.least_price(low, F.col("p_retailprice")).alias("least"))


CLEAN_ARGUMENTS = """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size BETWEEN 1 AND 4 THEN p_size WHEN p_size % 3 = 1 THEN 2 END::INTEGER AS level,
  array_to_string(list_sort(list_distinct(list_filter([p_name, p_brand, repeat(p_type, 20)], lambda x: length(x) BETWEEN 1 AND 80))), '|') AS ids, CASE WHEN p_size * 50.0::DOUBLE <= p_retailprice THEN p_size * 50.0::DOUBLE END AS least FROM part"""

#: Addresses and whether a fetch may follow them.
ADDRESSES = (
    ("https://example.com/a", True), ("http://127.0.0.1/", False), ("http://10.1.2.3:8080/x", False), ("http://172.20.0.1/", False), ("http://172.32.0.1/", True), ("http://[::1]/", False),
    ("http://[fd12:3456::1]/", False), ("http://[fe80::1]/", False), ("http://[2001:db8::1]/", False), ("http://[2606:4700::1111]/", True), ("http://[::ffff:10.0.0.1]/", False), ("http://user:pw@example.com/", False),
    ("ftp://example.com/", False), ("http://2130706433/", False), ("http://0x7f000001/", False), ("http://localhost/", False), ("http://printer.local/", False), ("http://db.internal/", False),
    ("http://100.64.1.1/", False), ("http://169.254.169.254/meta", False), ("nonsense", False), ("http://8.8.8.8/", True),
)


def address_guard(spark, sf):
    """Which addresses may be fetched: no private, local, numeric or credentialed ones."""
    url = F.element_at(F.array(*(F.lit(a) for a, _ in ADDRESSES)), (F.pmod("c_custkey", F.lit(len(ADDRESSES))) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", guards.may_fetch(url).alias("allowed"))


ADDRESS_GUARD = f"""
WITH a(k, allowed) AS (VALUES {", ".join(f"({k}, {ok})" for k, (_, ok) in enumerate(ADDRESSES))}) SELECT c_custkey, allowed FROM customer JOIN a ON c_custkey % {len(ADDRESSES)} = k"""


def point_checks(spark, sf):
    """Placeholder points, the order of two coordinates, and metres from the centre on a flat map."""
    c = located(table(spark, sf, "customer"), "c_custkey").withColumns({"a": F.when(F.col("c_custkey") % 3 == 0, F.col("lon")).otherwise(F.col("lat")), "b": F.when(F.col("c_custkey") % 3 == 0, F.col("lat")).otherwise(F.col("lon"))})
    return c.select("c_custkey", guards.is_placeholder(F.col("lat"), F.col("lon")).alias("placeholder"), geo.is_swapped(F.col("a"), F.col("b"), 25.2, 55.27).alias("swapped"), F.round(geo.flat_metres(F.col("lat"), F.col("lon"), F.lit(25.2), F.lit(55.27)), 3).alias("metres"))


POINT_CHECKS = """
WITH c AS (SELECT c_custkey, 24.79::DOUBLE + (c_custkey * 7919 % 10000) / 10000.0::DOUBLE * 0.57::DOUBLE AS lat, 54.89::DOUBLE + (c_custkey * 104729 % 10000) / 10000.0::DOUBLE * 0.67::DOUBLE AS lon FROM customer)
SELECT c_custkey, abs(lat * 100 - round(lat * 100)) < 1e-9 AND abs(lon * 100 - round(lon * 100)) < 1e-9 OR lat = 0 AND lon = 0 AS placeholder, c_custkey % 3 = 0 AS swapped,
  round(6371000.0::DOUBLE * sqrt(pow(radians(lat - 25.2::DOUBLE), 2) + pow(radians(lon - 55.27::DOUBLE) * cos(radians((lat + 25.2::DOUBLE) / 2)), 2)), 3) AS metres FROM c"""


def photo_checks(spark, sf):
    """Which pictures may stand on a card: wide enough, not too long, no icons, vector or network pictures."""
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://cdn.example.com/"), F.element_at(F.array(*map(F.lit, ("photos/", "logo-", "icons/", "img/sprite", "menu/"))), (k % 5 + 1).cast("int")), k.cast("string"), F.when(k % 7 == 0, ".svg").otherwise(".jpg"))
    return table(spark, sf, "part").select("p_partkey", guards.plausible_photo(url, F.pmod(k * 37, F.lit(1500)).cast("long"), F.pmod(k * 91, F.lit(1000)).cast("long") + 1).alias("plausible"))


PHOTO_CHECKS = """
SELECT p_partkey, p_partkey % 5 IN (0, 4) AND p_partkey % 7 <> 0 AND p_partkey * 37 % 1500 >= 600 AND greatest(p_partkey * 37 % 1500, p_partkey * 91 % 1000 + 1) <= 3 * least(p_partkey * 37 % 1500, p_partkey * 91 % 1000 + 1) AS plausible FROM part"""


def booking_choice(spark, sf):
    """How to book: a messenger before a phone before a site, and the provider of the link."""
    k = F.col("s_suppkey")
    links = F.array_compact(F.array(F.when(k % 2 == 0, F.concat(F.lit("https://www.sevenrooms.com/r/"), k.cast("string"))), F.when(k % 3 == 0, F.concat(F.lit("tel:+971"), k.cast("string"))), F.when(k % 5 == 0, F.concat(F.lit("https://wa.me/971"), k.cast("string")))))
    best = guards.booking(links)
    return table(spark, sf, "supplier").select("s_suppkey", best["url"].alias("url"), best["kind"].alias("kind"))


BOOKING_CHOICE = """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'https://wa.me/971' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'tel:+971' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'https://www.sevenrooms.com/r/' || s_suppkey END AS url,
  CASE WHEN s_suppkey % 5 = 0 THEN 'messenger' WHEN s_suppkey % 3 = 0 THEN 'phone' WHEN s_suppkey % 2 = 0 THEN 'reservation' END AS kind FROM supplier"""


def cache_keys(spark, sf):
    """Keys of cached answers: a version and the digest of the request with sorted keys, empty values left out."""
    request = F.to_json(F.struct(F.nullif("p_brand", F.lit("Brand#1")).alias("brand"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size")))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("v3:"), F.md5(request)).alias("key"))


CACHE_KEYS = """
SELECT p_partkey, 'v3:' || md5('{' || CASE WHEN p_brand <> 'Brand#1' THEN '"brand":"' || p_brand || '",' ELSE '' END || '"name":"' || p_name || '","size":' || p_size || '}') AS key FROM part"""


def source_health(spark, sf):
    """Each source's last state, its run of failures up to now and whether it is disabled (3 or more)."""
    e = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("source"), (F.col("event_type") == "error").alias("failed"))
    last_ok = F.max(F.when(~F.col("failed"), F.struct("ts", "event_id"))).over(Window.partitionBy("source"))
    late = e.withColumn("run", (last_ok.isNull() | (F.struct("ts", "event_id") > last_ok)).cast("long"))
    told = late.groupBy("source").agg(F.max("ts").alias("last_seen"), F.sum("run").alias("failures"), F.count("*").alias("calls"))
    return told.select("source", "last_seen", "calls", "failures", F.when(F.col("failures") >= 3, "disabled").when(F.col("failures") > 0, "degraded").otherwise("ok").alias("state"))


SOURCE_HEALTH = """
WITH e AS (SELECT user_id AS source, ts, event_id, event_type = 'error' AS failed FROM events), l AS (SELECT *, max((ts, event_id)) FILTER (NOT failed) OVER (PARTITION BY source) AS ok FROM e),
t AS (SELECT source, max(ts) AS last_seen, count(*) AS calls, count(*) FILTER (ok IS NULL OR (ts, event_id) > ok) AS failures FROM l GROUP BY source)
SELECT *, CASE WHEN failures >= 3 THEN 'disabled' WHEN failures > 0 THEN 'degraded' ELSE 'ok' END AS state FROM t"""

WITH_SQL = "hours_cards xml_rows sitemap_locs json_lines json_elements robots_rules city_clock human_dates event_windows name_folds clean_arguments address_guard point_checks photo_checks booking_choice cache_keys source_health".split()
QUERIES = {n: globals()[n] for n in WITH_SQL}
ORACLE_SQL = {n: globals()[n.upper()] for n in WITH_SQL}
