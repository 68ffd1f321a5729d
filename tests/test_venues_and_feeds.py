"""Greedy repeats, regions, feeds, sinks, hours and guards against plain Python and hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import dates, guards, hours, text
from wayfold.operators import regions, resolve, sinks
from wayfold.plans import venue_queries as v
from wayfold.sources import feeds, web

SF = "/root/testdata/sf0.001"


def km(a, b):
    (y1, x1), (y2, x2) = ((math.radians(p) for p in q) for q in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 12742 * math.asin(math.sqrt(h))


def test_repeated_venues_by_plain_python(spark):
    rows = sorted(v.venues(spark, SF).select("pid", "name", "lat", "lon", "rating").collect(), key=lambda r: (-r.rating, r.pid))
    kept = []
    for r in rows:
        if not any(k.name == r.name and km((k.lat, k.lon), (r.lat, r.lon)) <= 0.15 for k in kept):
            kept.append(r)
    assert {r.pid for r in v.repeated_venues(spark, SF).collect()} == {r.pid for r in kept}


def test_region_with_a_hole(spark):
    square = (((0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)), ((1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.0, 3.9), (4, 5.0, 1.0), (5, -0.1, 2.0)], "pid long, lat double, lon double")
    got = regions.inside(points, regions.region_table(spark, {"s": square}), "pid", per_degree=1).collect()
    assert sorted(r.pid for r in got) == [1, 3]


def test_suppress_later_follows_a_chain(spark):
    n = 12
    rows = spark.range(n).select(F.col("id").alias("k"))
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "early long, late long")
    assert sorted(r.k for r in resolve.suppress_later(rows, chain, "k").collect()) == list(range(0, n, 2))


def minutes(said):
    week = hours.parse_week(said)
    return None if week is None else sum(s["end"] - s["start"] for d in week for s in d or [])


@pytest.mark.parametrize(
    "said, expected",
    [
        ("Mo-Th 12:00-24:00, Fr 12:00-02:00, Sa,Su 10:00-02:00", 4 * 720 + 840 + 2 * 960), ("every day 9 am to 5 pm", 7 * 480), ("Open 24 hours", 10080), ("weekends noon till midnight", 2 * 720),
        ("ежедневно с 10:00 до 22:00", 7 * 720), ("будни 9:00-18:00; суббота 10:00-15:00; вс выходной", 5 * 540 + 300), ("Mo-Fr 08:00-12:00,13:00-17:00", 5 * 480), ("PH off", None),
        ("Jan 1 off; Mo-Su 10:00-11:00", 420), ("Sunday closed. Monday–Saturday 6-10pm", 6 * 240), ("11am - 2pm, 6pm - 11pm", 7 * 480), ("Fr-Mo 23:00-01:00", 4 * 120), ("no idea at all", None),
    ],
)
def test_more_hours(said, expected):
    assert minutes(said) == expected


def test_next_opening_and_closing(spark):
    rows = spark.createDataFrame([("Mo-Fr 22:00-02:00",)], "said string").withColumn("w", hours.week_of(F.col("said")))
    at = lambda d, m: (hours.next_opening(F.col("w"), F.lit(d), F.lit(m)), hours.closing(F.col("w"), F.lit(d), F.lit(m)))
    got = rows.select(*(c.alias(f"c{i}") for i, c in enumerate(x for d, m in ((1, 600), (2, 60), (6, 60), (0, 0)) for x in at(d, m)))).first()
    assert tuple(got) == (1320, None, 1320, 120, 1320 + 2 * 1440, 120, 1320 + 1440, None)


def test_feeds_skip_what_is_broken(spark):
    xml = "<feed><event><title>a &amp; b</title></event><event>< broken<title><![CDATA[<x>]]></title><start>2024-01-01</start></event><event>"
    got = feeds.xml_events(spark.createDataFrame([(1, xml), (2, None), (3, "")], "k long, x string"), "k", "x", ["title", "start"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, "a & b", None), (1, 1, "<x>", "2024-01-01")]
    lines = spark.createDataFrame([('{"a": 1}',), ("{",), ("",), (None,), ('{"a": "x"}',)], "line string")
    assert sorted((r.a is None, r.a) for r in feeds.json_lines(lines, "line", "a bigint").collect())[0] == (False, 1)
    files = spark.createDataFrame([(1, "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y\n\nUser-agent: b\nDisallow: /"), (2, None)], "site long, robots string")
    rules = feeds.robots_rules(files, "site", "robots", "*")
    assert sorted(map(tuple, rules.collect())) == [(1, "/x", False), (1, "/x/y", True)]
    paths = spark.createDataFrame([(1, 1, "/x/z"), (2, 1, "/x/y/z"), (3, 1, "/"), (4, 2, "/x"), (5, 1, None)], "k long, site long, path string")
    assert sorted(map(tuple, feeds.robots_decision(paths, rules, "k", "site", "path").collect())) == [(1, False), (2, True), (3, True), (4, True), (5, True)]
    same = web.robots_allowed(paths.filter("site = 1"), rules.select("prefix", "allow"), "k", "path").collect()
    assert sorted(map(tuple, same)) == [(1, False), (2, True), (3, True), (5, True)]


def test_sinks(spark, tmp_path):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, x string, seq long")
    assert sorted(map(tuple, sinks.upsert(now, changes, ["k"], "seq").collect())) == [(1, "a"), (2, "d"), (3, "e")]
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, None)], "k long, seq long, ok boolean")
    assert sorted((r.k, r.seq) for r in sinks.compact(rows, ["k"], F.col("ok"), F.col("seq")).collect()) == [(1, 1), (2, 2)]
    folder = f"{tmp_path}/table"
    assert sinks.current_version(spark, folder) is None
    first = sinks.publish(now, folder)
    assert sinks.current_version(spark, folder) == first
    assert sinks.publish(now.limit(0), folder) is None and sinks.current_version(spark, folder) == first
    second = sinks.publish(now.limit(1), folder)
    assert sinks.current_version(spark, folder) == second != first and spark.read.parquet(second).count() == 1
    assert sinks.may_publish(500, 3, 10) and not sinks.may_publish(499, 0, 10) and not sinks.may_publish(900, 4, 10)
    assert [r.k for r in sinks.unfinished(now, now.limit(1), "k").collect()] == [2]
    sinks.audit(now, now.limit(1), "k", F.lit("late"), f"{tmp_path}/audit")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/audit").collect()] == ["2\tlate"]


def test_words_and_dates(spark):
    one = spark.range(1)
    said = ("On 3rd? no: 5 May 2024", "Feb 30, 2024", "Sept. 9, 2023", "nothing", None)
    got = one.select(*(dates.human_date(F.lit(s).cast("string")).cast("string").alias(f"c{i}") for i, s in enumerate(said))).first()
    assert tuple(got) == ("2024-05-05", None, "2023-09-09", None, None)
    row = one.select(
        text.fold(F.lit("Żółw & Crème-Brûlée")).alias("fold"), text.bare_name(text.fold(F.lit("The Mall, Dubai")), "dubai").alias("bare"), dates.iso_local(F.lit("2024-01-31T22:30:00+01:00"), 4).alias("zoned"), dates.iso_local(F.lit("31.1."), 4).alias("none"),
        dates.asked_window(F.lit("a bar next friday"), F.lit("2024-05-03").cast("date"))["since"].cast("string").alias("friday"), guards.level(F.lit("2.5")).alias("half"), guards.may_fetch(F.lit("http://example.com:99999999/")).alias("port"),
    ).first()
    assert tuple(row) == ("zolw and creme brulee", "mall", "2024-02-01 01:30", None, "2024-05-03", None, True)
    assert all(one.select(guards.may_fetch(F.lit(u)).alias("x")).first().x is ok for u, ok in (("http://[::]/", False), ("http://a.test/", False), ("https://a.co.uk/x?y#z", True), ("", False)))
