"""Queries of tags, opening hours, page records, further calendar and state rules, and plans of several stops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions import geo, hours, tags, text
from wayfold.operators import calendar as cal
from wayfold.operators import resolve, state
from wayfold.plans import evening
from wayfold.sources import web
from wayfold.sources.tables import CENTRE, SQL_CALENDAR, SQL_SUPPLIERS, calendar, located, sql_km, suppliers, table


def _tagged(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.create_map(F.lit("kind"), F.lower("p_type"), F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"), F.lit("opening_date"), F.when(F.col("p_size") % 10 == 0, "2030-01"), F.lit("serves"), F.concat_ws("; ", *(F.when(F.col("p_size") % k == 0, F.lit(f"c{k}")) for k in (2, 3, 5)))).alias("t"))


def tag_predicates(spark, sf):
    t = F.col("t")
    return _tagged(spark, sf).select(
        "p_partkey", tags.predicate(t, "kind=promo & name!~widget").alias("promo"), tags.predicate(t, "name~i RED & colour!=blue").alias("red"), tags.predicate(t, "colour").alias("coloured"),
        tags.multi_value(t, "serves", "c3").alias("threes"), tags.alias(t, "contact:name", "serves", "name").alias("label"), tags.closed(t, F.lit("2026-01-01")).alias("closed"),
    )


TAG_PREDICATES = """
SELECT p_partkey, p_type = 'PROMO' AND NOT contains(p_name, 'widget') AS promo, contains(p_name, 'red') AS red, false AS coloured, p_size % 3 = 0 AS threes,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'c2' END, CASE WHEN p_size % 3 = 0 THEN 'c3' END, CASE WHEN p_size % 5 = 0 THEN 'c5' END], lambda x: x IS NOT NULL), '; '), ''), p_name) AS label,
  p_size % 10 = 0 AS closed FROM part"""


def merged_tags(spark, sf):
    """Union of the tag maps of a brand's rows: for each tag the value of the row with the smallest key."""
    pairs = _tagged(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey").select("p_brand", "p_partkey", F.explode("t").alias("tag", "value")).filter("value is not null")
    return pairs.groupBy("p_brand", "tag").agg(F.min_by("value", "p_partkey").alias("value"), F.countDistinct("value").alias("values"))


MERGED_TAGS = """
WITH t AS (SELECT p_brand, p_partkey, unnest(['kind', 'name', 'size', 'opening_date', 'serves']) AS tag, unnest([lower(p_type), p_name, p_size::VARCHAR, CASE WHEN p_size % 10 = 0 THEN '2030-01' END,
  array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'c2' END, CASE WHEN p_size % 3 = 0 THEN 'c3' END, CASE WHEN p_size % 5 = 0 THEN 'c5' END], lambda x: x IS NOT NULL), '; ')]) AS value FROM part)
SELECT p_brand, tag, arg_min(value, p_partkey) AS value, count(DISTINCT value) AS "values" FROM t WHERE value IS NOT NULL GROUP BY 1, 2"""


def hours_text(spark, sf):
    """Minutes open in a week, from an opening-hours text made of the key; each distinct text is parsed once."""
    k = F.col("s_suppkey")
    hh = lambda x: F.lpad(x.cast("string"), 2, "0")
    said = F.when(k % 4 == 0, "24/7").when(k % 4 == 1, F.concat(F.lit("Mo-Fr "), hh(k % 5 + 7), F.lit(":30-18:00; Sa,Su off"))).when(k % 4 == 2, F.concat(F.lit("Mon to Thu 10am-"), (k % 9 + 1).cast("string"), F.lit(":15 pm; Fr 22:00-02:00; PH off"))).otherwise(F.lit("ask us"))
    rows = table(spark, sf, "supplier").select("s_suppkey", said.alias("said"))
    parsed = rows.select("said").distinct().withColumn("week", hours.week_of(F.col("said")))
    open_ = F.aggregate(F.flatten("week"), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return rows.join(parsed, "said").select("s_suppkey", F.when(F.col("week").isNotNull(), open_).alias("minutes"))


HOURS_TEXT = """
SELECT s_suppkey, (CASE s_suppkey % 4 WHEN 0 THEN 7 * 1440 WHEN 1 THEN 5 * (1080 - (s_suppkey % 5 + 7) * 60 - 30) WHEN 2 THEN 4 * ((s_suppkey % 9 + 1) * 60 + 735 - 600) + 240 END)::INTEGER AS minutes FROM supplier"""


def jsonld_events(spark, sf):
    """Order rows written as pages with JSON-LD and read back; every fifth block is broken and skipped."""
    k = F.col("o_orderkey")
    node = F.to_json(F.struct(F.lit("Event").alias("@type"), F.concat(F.lit("Event "), k.cast("string")).alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("startDate"), F.struct(F.round("o_totalprice", 2).alias("price"), F.lit("AED").alias("priceCurrency")).alias("offers")))
    block = F.concat(F.lit("<html><script type=\"application/ld+json\">"), F.when(k % 5 == 0, F.concat(F.lit("{,"), node)).otherwise(node), F.lit("</script><p>x</p></html>"))
    pages = table(spark, sf, "orders").select("o_orderkey", block.alias("html"))
    got = web.json_ld(pages, "o_orderkey", "html", "`@type` string, name string, startDate string, offers struct<price: double, priceCurrency: string>")
    return got.filter("node.`@type` like '%Event'").select("o_orderkey", F.col("node.name").alias("name"), F.try_to_date("node.startDate").alias("day"), F.col("node.offers.price").alias("price"))


JSONLD_EVENTS = "SELECT o_orderkey, 'Event ' || o_orderkey AS name, o_orderdate::DATE AS day, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 5 <> 0"


def reject_reasons(spark, sf):
    e = calendar(spark, sf)
    reason = F.when(F.col("day_end") < F.lit("1994-01-01").cast("date"), "past").when(F.col("day_start") > F.lit("1996-12-31").cast("date"), "beyond").when(F.datediff("day_end", "day_start") > 5, "long").when(F.col("price") < 20000, "cheap").otherwise("kept")
    return e.groupBy(reason.alias("reason"), F.year("day_start").alias("year")).agg(F.count("*").alias("n"))


REJECT_REASONS = f"""
SELECT CASE WHEN day_end < DATE '1994-01-01' THEN 'past' WHEN day_start > DATE '1996-12-31' THEN 'beyond' WHEN day_end - day_start > 5 THEN 'long' WHEN price < 20000 THEN 'cheap' ELSE 'kept' END AS reason, year(day_start)::INTEGER AS year, count(*) AS n
FROM ({SQL_CALENDAR}) GROUP BY 1, 2"""


def next_events(spark, sf):
    """The 30 first events of every month by day, price (missing last) and key."""
    month = F.trunc("day_start", "month")
    w = Window.partitionBy(month).orderBy("day_start", F.col("price").asc_nulls_last(), "event_key")
    return calendar(spark, sf).withColumns({"month": month, "place": F.row_number().over(w)}).filter("place <= 30").select("month", "place", "event_key")


NEXT_EVENTS = f"""
SELECT date_trunc('month', day_start)::DATE AS month, row_number() OVER (PARTITION BY date_trunc('month', day_start) ORDER BY day_start, price NULLS LAST, event_key) AS place, event_key FROM ({SQL_CALENDAR})
QUALIFY place <= 30"""


def event_dedupe(spark, sf):
    """Events without those that overlap an earlier kept event of the same customer."""
    e = calendar(spark, sf)
    pairs = cal.overlapping_pairs(e, "cust").select(F.col("first").alias("early"), F.col("second").alias("late"))
    return resolve.suppress_later(e, pairs, "event_key").select("event_key", "cust")


def freshness(spark, sf):
    since = F.max("ts").over(Window.partitionBy())
    e = table(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("ts"), F.count_if(F.col("value") > 50).alias("high"), F.count("*").alias("n"))
    return e.withColumn("stale", F.unix_seconds(since.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > 600)


FRESHNESS = """
WITH e AS (SELECT event_type, max(ts) AS ts, count(*) FILTER (value > 50) AS high, count(*) AS n FROM events GROUP BY 1)
SELECT *, floor(epoch(max(ts) OVER ()))::BIGINT - floor(epoch(ts))::BIGINT > 600 AS stale FROM e"""


def trimmed_chats(spark, sf):
    got = state.trim_conversations(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role"), 4)
    return got.select("conv_id", "turn", "role")


TRIMMED_CHATS = """
WITH r AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4),
f AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS first_user FROM r) SELECT conv_id, turn, role FROM f WHERE turn >= first_user"""


def last_values(spark, sf):
    value = F.when(F.col("event_type") == "view", F.round("value", 4))
    return state.last_known(table(spark, sf, "events"), "user_id", "ts", "event_id", value, 12 * 3600).select("event_id", "known")


LAST_VALUES = """
WITH l AS (SELECT event_id, epoch(ts) AS t, last_value(CASE WHEN event_type = 'view' THEN round(value, 4) END IGNORE NULLS) OVER w AS v, max(CASE WHEN event_type = 'view' AND value IS NOT NULL THEN floor(epoch(ts)) END) OVER w AS seen
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN floor(t) - seen <= 43200 THEN v END AS known FROM l"""


def pruned_cache(spark, sf):
    got = state.prune_by_budget(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.abs(F.col("value")), 20, 600.0)
    return got.groupBy("user_id").agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


PRUNED_CACHE = """
WITH s AS (SELECT *, row_number() OVER w AS n, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, count(*) AS kept, min(ts) AS oldest FROM s WHERE n <= 20 AND s <= 600 GROUP BY user_id"""


def fill_forward(spark, sf):
    """Every event under the last purchase of its user before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf, "events").withColumn("header", header).groupBy("user_id", "header").agg(F.count("*").alias("lines"))


FILL_FORWARD = """
WITH h AS (SELECT user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events)
SELECT user_id, header, count(*) AS lines FROM h GROUP BY 1, 2"""


def shown_ids(spark, sf):
    """Distinct ids that an answer's text shows, newest first, at most 6."""
    said = F.concat_ws(" ", *(F.concat(F.lit("id="), F.pmod(F.col("conv_id") * k + F.col("turn"), F.lit(9)).cast("string")) for k in (3, 5, 7, 11)))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(said, F.lit("id=([0-9]+)"), F.lit(1))).alias("id"))
    last = rows.groupBy("conv_id", "id").agg(F.max("turn").alias("turn"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "id")
    return last.withColumn("place", F.row_number().over(w)).filter("place <= 6").select("conv_id", "place", "id")


SHOWN_IDS = """
WITH s AS (SELECT conv_id, turn, ((conv_id * unnest([3, 5, 7, 11]) + turn) % 9)::VARCHAR AS id FROM conversations), l AS (SELECT conv_id, id, max(turn) AS turn FROM s GROUP BY 1, 2)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, id) AS place, id FROM l QUALIFY place <= 6"""


def nearest_centre(spark, sf):
    """The nearest of a few named centres within 12 km, else none."""
    centres = spark.createDataFrame([("old town", 25.26, 55.30), ("marina", 25.08, 55.14), ("desert", 24.95, 55.40)], "centre string, clat double, clon double")
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    named = F.array(*(F.struct(F.lit(c).alias("centre"), F.lit(a).alias("clat"), F.lit(b).alias("clon")) for c, a, b in centres.collect()))
    rows = suppliers(spark, sf).withColumn("c", F.explode(named)).select("s_suppkey", "lat", "lon", "c.*").withColumn("km", km)
    best = rows.groupBy("s_suppkey").agg(F.min(F.struct("km", "centre")).alias("b"))
    return best.select("s_suppkey", F.when(F.col("b.km") <= 12, F.col("b.centre")).alias("centre"), F.round("b.km", 6).alias("km"))


NEAREST_CENTRE = f"""
WITH c(centre, clat, clon) AS (VALUES ('old town', 25.26::DOUBLE, 55.30::DOUBLE), ('marina', 25.08::DOUBLE, 55.14::DOUBLE), ('desert', 24.95::DOUBLE, 55.40::DOUBLE)),
k AS (SELECT s_suppkey, centre, {sql_km("lat", "lon", "clat", "clon")} AS km FROM ({SQL_SUPPLIERS}), c)
SELECT s_suppkey, CASE WHEN min(km) <= 12 THEN arg_min(centre, km) END AS centre, round(min(km), 6) AS km FROM k GROUP BY 1"""


def name_domain(spark, sf):
    """Whether a page's host shares a word of 4 letters or more with its title."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    words = F.filter(F.array_distinct(text.tokens(text.normal_rank(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))), lambda w: F.length(w) >= 4)
    return table(spark, sf, "pages").select("page_id", F.exists(words, lambda w: F.contains(host, w)).alias("same"), F.size(words).alias("words"))


NAME_DOMAIN = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, trim(regexp_replace(regexp_replace(replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 'ё', 'е'), '[^a-zа-я0-9]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
w AS (SELECT *, list_filter(list_distinct(string_split(t, ' ')), lambda x: length(x) >= 4 AND x NOT IN ('near', 'with')) AS words FROM p)
SELECT page_id, len(list_filter(words, lambda x: contains(host, x))) > 0 AS same, len(words)::INTEGER AS words FROM w"""


def seeded_sample(spark, sf):
    """Three rows of each brand by the hash of key and seed; the hash is SHA-1, so that SQL agrees."""
    w = Window.partitionBy("p_brand").orderBy(F.sha1(F.concat(F.col("p_partkey").cast("string"), F.lit(":7"))))
    return table(spark, sf, "part").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("p_brand", "place", "p_partkey")


SEEDED_SAMPLE = "SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha1(p_partkey || ':7')) AS place, p_partkey FROM part QUALIFY place <= 3"


def evening_plans(spark, sf):
    """Three stops from each supplier: part places of three categories, each the nearest to the stop before."""
    places = located(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").alias("place"), F.col("p_type").alias("category"), "lat", "lon")
    requests = suppliers(spark, sf).select(F.col("s_suppkey").alias("request"), "lat", "lon", (F.lit(1080) + F.pmod("s_suppkey", F.lit(60))).alias("start"), F.array(F.lit("PROMO"), F.lit("SMALL"), F.lit("PROMO")).alias("categories"))
    return evening.plan_stops(requests, places, 3).select("request", "stop", "place", F.round("km", 6).alias("km"), "arrive")


WITH_SQL = "tag_predicates merged_tags hours_text jsonld_events reject_reasons next_events freshness trimmed_chats last_values pruned_cache fill_forward shown_ids nearest_centre name_domain seeded_sample".split()
#: Without SQL: greedy results that tests compare with plain Python.
WITHOUT_SQL = "event_dedupe evening_plans".split()
QUERIES = {n: globals()[n] for n in WITH_SQL + WITHOUT_SQL}
ORACLE_SQL = {n: globals()[n.upper()] for n in WITH_SQL}
