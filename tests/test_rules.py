"""Opening hours, tag predicates, greedy plans and edge cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold import catalog
from wayfold.functions import dates, hours, pricing, tags, text, urls
from wayfold.plans import evening, intent
from wayfold.sources.tables import located, suppliers, table

SF = "/root/testdata/sf0.001"


def week(text_):
    got = hours.parse_week(text_)
    return None if got is None else [None if d is None else [(s["start"], s["end"]) for s in d] for d in got]


@pytest.mark.parametrize(
    "said, expected",
    [
        (None, None), ("", None), ("call us", None), ("24/7", [[(0, 1440)]] * 7),
        ("09:00-18:00", [[(540, 1080)]] * 7),
        ("Mo-Fr 09:00-18:00", [[]] + [[(540, 1080)]] * 5 + [[]]),
        ("Mo-Su 10:00-22:00; Fr 14:00-02:00", [[(600, 1320)]] * 5 + [[(840, 1560)]] + [[(600, 1320)]]),
        ("Fr-Mo 8am - 12:30pm", [[(480, 750)]] * 2 + [[]] * 3 + [[(480, 750)]] * 2),
        ("Monday to Wednesday: 10:00-13:00, 15:00-19:00", [[]] + [[(600, 780), (900, 1140)]] * 3 + [[]] * 3),
        ("Sa,Su off; PH off", [[]] * 7),
        ("13pm-15pm", None), ("Mo 25:99-30:00", None),
    ],
)
def test_hours(said, expected):
    assert week(said) == expected


def test_open_at(spark):
    rows = spark.createDataFrame([("Fr 22:00-02:00",), ("09:00-18:00",)], "said string").withColumn("week", hours.week_of(F.col("said")))
    got = rows.select("said", *(dates.open_at(F.col("week"), F.lit(d), F.lit(m)).alias(f"d{d}_{m}") for d, m in ((5, 1330), (6, 60), (6, 130), (0, 600)))).collect()
    assert [tuple(r)[1:] for r in got] == [(True, True, False, False), (False, False, False, True)]
    none = spark.range(1).select(dates.open_at(F.lit(None).cast(hours.WEEK_TYPE), F.lit(1), F.lit(600)).alias("x")).first()
    assert none.x is None


def test_predicates(spark):
    rows = spark.createDataFrame([({"amenity": "bar", "name": "Old Bar"},), ({"disused:shop": "x", "end_date": "2020"},), ({},)], "t map<string,string>")
    t = F.col("t")
    got = rows.select(tags.predicate(t, "amenity=bar & name~i old").alias("a"), tags.predicate(t, "amenity!=bar").alias("b"), tags.predicate(t, "shop").alias("c"), tags.closed(t, F.lit("2026-01-01")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, True, False, True), (False, True, False, False)]


def test_scalar_edges(spark):
    row = spark.range(1).select(
        dates.clock_minutes(F.lit("doors 12 am")).alias("midnight"), dates.clock_minutes(F.lit("no time")).alias("none"), dates.clock_minutes(F.lit("at 12:15pm")).alias("noon"),
        pricing.parse_amount(F.lit("1,250.50 AED")).alias("amount"), pricing.parse_amount(F.lit("free")).alias("free"), pricing.parse_amount(F.lit("freedom")).alias("unknown"),
        pricing.least_price(F.array(F.lit(0.0))).alias("zero"), pricing.least_price(F.array().cast("array<double>")).alias("no_price"),
        text.normal_search(F.lit("<b>Café  ЁЖ</b> C++")).alias("normal"), text.stem(F.lit("gardening")).alias("stem"), text.stem(F.lit("sing")).alias("unstemmed"),
        urls.host(F.lit("nonsense")).alias("host"), urls.is_private_ipv4(F.lit("172.31.0.1")).alias("private"), urls.is_private_ipv4(F.lit("172.32.0.1")).alias("public"), urls.is_private_ipv4(F.lit("10.0.0.1.evil.com")).alias("name"),
        intent.stops(F.lit("Dinner then something")).alias("one"), intent.stops(F.lit("Dinner then a bar")).alias("two"),
    ).first()
    assert tuple(row) == (0, None, 735, 1250.5, 0.0, None, 0.0, None, "caf еж c++", "garden", "sing", None, True, False, False, ["dinner then something"], ["dinner", "a bar"])


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def test_evening_plans_take_the_nearest_unused(spark):
    places = located(table(spark, SF, "part"), "p_partkey").collect()
    got = {}
    for r in catalog.QUERIES["evening_plans"](spark, SF).collect():
        got.setdefault(r.request, {})[r.stop] = r
    for s in suppliers(spark, SF).collect():
        at, used = (s.lat, s.lon), set()
        for stop, category in enumerate(("PROMO", "SMALL", "PROMO"), 1):
            cell = [math.floor(x * 10) for x in at]
            near = [p for p in places if p.p_type == category and p.p_partkey not in used and abs(math.floor(p.lat * 10) - cell[0]) <= 1 and abs(math.floor(p.lon * 10) - cell[1]) <= 1]
            if not near:
                assert stop not in got.get(s.s_suppkey, {})
                continue
            best = min(near, key=lambda p: (km(*at, p.lat, p.lon), p.p_partkey))
            assert got[s.s_suppkey][stop].place == best.p_partkey
            used.add(best.p_partkey)
            at = (best.lat, best.lon)


def test_evening_plans_search_all_places(spark):
    places = [(k, "bar", 25.0 + k % 5 * 0.01, 55.0 + k % 7 * 0.01) for k in range(30)]
    places += [(100, "museum", 25.9, 56.0), (101, "museum", -33.0, 151.0), (102, "museum", 0.05, -179.95), (103, "park", 25.05, 55.199), (104, "park", 25.201, 55.05), (105, "park", 25.151, 55.099)]
    requests = [(1, 25.01, 55.01), (2, 25.0999, 55.0999), (3, -20.0, 140.0), (4, 0.0, 179.9), (5, 25.05, 55.05), (6, 80.0, -100.0), (7, 25.0999, 55.0001)]
    wanted = ["park", "museum", "bar", "museum", "none", "park", "museum", "museum"]
    asked = spark.createDataFrame([(*r, 1080, wanted) for r in requests], "request long, lat double, lon double, start int, categories array<string>")
    table_ = spark.createDataFrame(places, "place long, category string, lat double, lon double")
    got = {(r.request, r.stop): r.place for r in evening.plan_stops(asked, table_, len(wanted)).collect()}
    expected = {}
    for request, *at in requests:
        used = set()
        for stop, category in enumerate(wanted, 1):
            left = [p for p in places if p[1] == category and p[0] not in used]
            if left:
                best = min(left, key=lambda p: (km(*at, p[2], p[3]), p[0]))
                expected[request, stop], at = best[0], best[2:]
                used.add(best[0])
    assert got == expected


def test_event_dedupe_is_greedy(spark):
    from wayfold.sources.tables import calendar

    kept: dict[int, list] = {}
    for e in sorted(calendar(spark, SF).collect(), key=lambda e: e.event_key):
        if not any(e.day_start <= o.day_end and o.day_start <= e.day_end for o in kept.setdefault(e.cust, [])):
            kept[e.cust].append(e)
    assert {r.event_key for r in catalog.QUERIES["event_dedupe"](spark, SF).collect()} == {e.event_key for es in kept.values() for e in es}
