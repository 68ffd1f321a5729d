"""Nested page data, event folds, adaptive cells, written hours and publication against plain Python."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import hours, schedule
from wayfold.operators import event_fold, quad, sinks
from wayfold.sources import linked

DAY = datetime.date(2026, 5, 1)


def page(*nodes):
    return "<html>" + "".join(f'<script type="application/ld+json">{n if isinstance(n, str) else json.dumps(n)}</script>' for n in nodes) + "</html>"


def brute_events(nodes):
    """Names of events in the order of a recursive walk."""
    out = []

    def is_event(t):
        return any(isinstance(x, str) and x.endswith("Event") for x in (t if isinstance(t, list) else [t]))

    def walk(n, depth):
        if depth > 6:
            return
        if isinstance(n, list):
            for x in n:
                walk(x, depth + 1)
        elif isinstance(n, dict):
            if is_event(n.get("@type")) and "name" in n and "startDate" in n:
                out.append((depth, n["name"]))
            for f in ("@graph", "itemListElement", "item", "subEvent"):
                if isinstance(n.get(f), dict) or f != "item" and isinstance(n.get(f), list):
                    walk(n[f], depth + 1)

    for n in nodes:
        walk(n, 0)
    return out


def random_node(draw, depth):
    if depth and draw.random() < 0.3:
        return [random_node(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    node = {"@type": draw.choice(["Event", "MusicEvent", ["Thing", "ComedyEvent"], "EventSeries", "Place", None]), "name": f"n{draw.randint(0, 999)}"}
    if draw.random() < 0.8:
        node["startDate"] = "2026-05-01"
    for f in ("@graph", "itemListElement", "item", "subEvent", "about"):
        if depth and draw.random() < 0.4:
            node[f] = random_node(draw, depth - 1)
    return node


def test_events_of_nested_nodes(spark):
    draw = random.Random(5)
    pages = {k: [random_node(draw, 8) for _ in range(draw.randint(0, 3))] for k in range(150)}
    deep = lambda k: {"@type": "Event", "name": "deep", "startDate": "x"} if not k else {"item": deep(k - 1)}
    pages |= {1000: [deep(6)], 1001: [deep(7)]}
    rows = spark.createDataFrame([(k, page(*nodes)) for k, nodes in pages.items()] + [(2000, None), (2001, "")], "k long, html string")
    got = {k: [] for k in pages}
    for r in linked.events(rows, "k", "html").orderBy("k", "position").collect():
        got[r.k].append((r.depth, r.name))
    assert got == {k: brute_events(nodes) for k, nodes in pages.items()}
    assert got[1000] and not got[1001]


def test_broken_blocks_and_prices(spark):
    event = '{"@type":"Event","name":" A &amp; B ","startDate":"d","location":{"name":"Hall"},"offers":%s}'
    html = page("{broken", "<!-- " + event % '[{"price":0},{"lowPrice":"12.5"}]' + " -->", "//<![CDATA[\n" + event % '{"price":"0"}' + "\n//]]>", (event % "[]")[:-1] + ",}")
    out = linked.events(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html").orderBy("position").collect()
    assert [(r.name, r.venue, r.price) for r in out] == [("A & B", "Hall", 12.5), ("A & B", "Hall", 0.0), ("A & B", "Hall", None)]


def test_venues_and_actions(spark):
    hotel = {"@type": "https://schema.org/Hotel", "name": {"@value": "H"}, "geo": {"latitude": 0, "longitude": 0}, "address": ["1 Road"], "openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Monday"], "opens": "9:00", "closes": "17:00"}]}
    nested = lambda k: hotel if not k else {"x": nested(k - 1)}
    order = {"@type": ["OrderAction"], "target": [{"urlTemplate": "https://o"}, "https://p", 5]}
    rows = [(1, page(nested(12))), (2, page(nested(13))), (3, page({"a": [{"priceRange": "$"}] * 250, "review": hotel})), (4, page({"@type": "Product", "priceRange": "$", "potentialAction": order})), (5, page({"l": [1] * 399 + [hotel, hotel]}))]
    pages = spark.createDataFrame(rows, "k long, html string")
    found = linked.venues(pages, "k", "html").collect()
    by = {k: [r for r in found if r.k == k] for k in range(1, 6)}
    assert {k: len(v) for k, v in by.items()} == {1: 1, 2: 0, 3: 200, 4: 0, 5: 1}
    one = by[1][0]
    assert (one["types"], one.name, one.point, one.address, one.depth) == (["Hotel"], "H", None, "1 Road", 12)
    assert [tuple(r) for r in one.hour_rows] == [(["Monday"], "9:00", "17:00", None, None)]
    assert sorted((r.k, r.kind, r.url) for r in linked.actions(pages, "k", "html").collect()) == [(4, "order", "5"), (4, "order", "https://o"), (4, "order", "https://p")]


def event(key, name, venue=None, point=None, first=0, last=0, source="guide", **more):
    row = dict(key=key, name=name, venue=venue, lat=point and point[0], lon=point and point[1], day_start=DAY + datetime.timedelta(first), day_end=DAY + datetime.timedelta(last))
    return row | dict(days=[], tags=[], price=None, time=None, source=source, url=f"u{key}") | more


def told(rows):
    return sorted((r["key"], r["name"], r["venue"], r["lat"], r["day_start"], r["day_end"], tuple(r["days"] or ()), tuple(r["tags"] or ()), r["price"], r["source"], tuple(r["also"]), r["members"]) for r in rows)


def brute_fold(rows, spark):
    """The fold over the whole list, without blocks."""
    frame = spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in event_fold.FIELDS.split(", ")) for r in rows], event_fold.FIELDS)
    full = frame.withColumns({"_words": event_fold.title_words(F.col("name")), "_venue": event_fold.venue_key(F.col("venue")), "_normal": event_fold.normal(F.col("name"))}).orderBy("key").collect()
    return frame, event_fold.fold([r.asDict() | {"_words": frozenset(r._words), "also": [], "members": 1} for r in full])


def test_merged_events_are_compared_with_later_rows(spark):
    rows = [
        event(1, "Jazz Quartet", "Blue Hall", None, 0, 2, "guide", price=50.0, tags=["festival"]),
        event(2, "Jazz Quartet Live", "Blue Hall", (25.0, 55.0), 2, 4, "venue", tags=["concert"]),
        event(3, "Jazz Quartet", None, (25.001, 55.0), 4, 6, "tickets", price=40.0),  # matches only what 1 and 2 have become
        event(4, "Jazz Quartet", "Red Hall", (25.3, 55.0), 4, 6),
        event(5, "Jazz Quartet", "Blue Hall", None, 9, 9),
        event(6, "The Show", "Blue Hall"), event(7, "the SHOW!", "The Blue Hall, Dubai"), event(8, None, "Blue Hall"), event(9, "Alone", None),
        event(10, "Dated", "Old Mill", None, 0, 9, "venue", days=[DAY]), event(11, "Dated", "Old Mill", None, 3, 30, "guide"), event(12, "Dated", "Old Mill", None, 10, 12),
        event(13, "No day", "Old Mill", day_start=None), event(14, "No day", "Old Mill", day_start=None),
    ]
    frame, expected = brute_fold(rows, spark)
    out = {r["key"]: r for r in (x.asDict() for x in event_fold.dedupe(frame).collect())}
    assert told(out.values()) == told(expected)
    assert {k: r["members"] for k, r in out.items()} == {1: 3, 4: 1, 5: 1, 6: 2, 8: 1, 9: 1, 10: 2, 12: 1, 13: 1, 14: 1}
    one = out[1]
    assert (one["name"], one["price"], one["tags"], one["also"]) == ("Jazz Quartet Live", 50.0, ["concert", "festival"], ["u1", "u3"])
    assert (one["day_start"], one["day_end"]) == (DAY, DAY + datetime.timedelta(6))


def test_fold_of_random_feeds(spark):
    draw = random.Random(8)
    words = ["nova", "luna", "orbit", "delta", "echo", "live", "the"]
    rows = []
    for k in range(260):
        first = draw.randint(0, 40)
        point = None if draw.random() < 0.4 else (25 + draw.randint(0, 12) / 400, 55 + draw.randint(0, 6) / 400)
        venue = draw.choice([None, "Hall", "Hall One", "Big Hall One", "Mill", "Old Mill, Dubai", ""])
        name = draw.choice([None, "The", " ".join(draw.sample(words, draw.randint(1, 4)))])
        rows.append(event(k, name, venue, point, first, first + draw.randint(0, 4), draw.choice(["venue", "tickets", "guide", "other"]), days=[DAY] if draw.random() < 0.2 else [], tags=draw.sample(event_fold.TAGS, 2)))
    frame, expected = brute_fold(rows, spark)
    got = [r.asDict() for r in event_fold.dedupe(frame).collect()]
    assert told(got) == told(expected) and len(got) < len(rows)
    assert event_fold.blocks(frame).select("_block").distinct().count() > 20
    assert event_fold.dedupe(frame.limit(0)).collect() == []


def test_points_in_adaptive_cells(spark):
    draw = random.Random(2)
    box = (0.0, 0.0, 8.0, 8.0)
    points = [(draw.choice([0.0, 8.0, 4.0, draw.uniform(0, 8), draw.uniform(0, 1)]), draw.choice([0.0, 8.0, 4.0, draw.uniform(0, 8), draw.uniform(0, 1)])) for _ in range(300)] + [(9.0, 1.0), (-1.0, 1.0)]
    rows = spark.createDataFrame([*points, (None, 1.0)], "lat double, lon double")
    cells = quad.quad_cells(rows, box, 40, 3)
    kept = {r.cell: r for r in cells.collect()}
    assert sum(r.points for r in kept.values()) == 300
    assert all(r.points < 40 or r.level == 3 for r in kept.values()) and all(r.full == (r.points >= 40) for r in kept.values())
    for name in {c[:k] for c in kept for k in range(len(c))}:
        assert sum(r.points for c, r in kept.items() if c.startswith(name)) >= 40
    assert abs(sum(4.0 ** -r.level for r in kept.values()) - 1) < 1e-9
    placed = quad.in_cells(rows, cells, box, 3).collect()
    assert len(placed) == 300
    for p in placed:
        c = kept[p.cell]
        assert c.south <= p.lat <= c.north and c.west <= p.lon <= c.east
    assert [tuple(r)[:3] for r in quad.quad_cells(rows.limit(0), box, 4, 2).collect()] == [("", 0, 0)]


def test_written_weeks_read_back(spark):
    draw = random.Random(6)
    weeks = []
    for _ in range(200):
        day = lambda: [{"start": s, "end": s + draw.choice([60, 90, 300])} for s in draw.sample(range(0, 1080, 30), draw.randint(0, 3))]
        days = [day() for _ in range(3)]
        weeks.append([draw.choice(days) for _ in range(7)])
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(weeks)], f"k long, week {hours.WEEK_TYPE}")
    out = rows.select("k", "week", schedule.write_week(F.col("week")).alias("said")).withColumn("valid", schedule.valid_hours(F.col("said"))).collect()
    for r in out:
        united = []
        for d in r.week:
            busy = sorted({m for s in d for m in range(s.start, s.end)})
            united.append([(a, b) for a, b in zip([m for m in busy if m - 1 not in busy], [m + 1 for m in busy if m + 1 not in busy])])
        touching = [sorted({(s.start, s.end) for s in d}) for d in r.week]
        if not any(touching):
            assert r.said is None and not r.valid
            continue
        assert r.valid and [[(s["start"], s["end"]) for s in d] for d in hours.parse_week(r.said)] == united


@pytest.mark.parametrize(
    "week, said",
    [
        ([[(0, 1440)]] * 7, "24/7"),
        ([[(600, 1440)], *[[(600, 1200)]] * 3, [(600, 1200)], [], [(1080, 1560)]], "Mo-Th 10:00-20:00; Sa 18:00-02:00; Su 10:00-24:00"),
        ([[], [(540, 720), (600, 660), (700, 800)], [(540, 800)], [], [], [], []], "Mo,Tu 09:00-13:20"),
        ([None] * 7, None),
        ([[(0, 1440), (1500, 1600)]] + [[]] * 6, None),
        ([[(60, 120), (1200, 1530)]] + [[]] * 6, None),
    ],
)
def test_weeks_as_text(spark, week, said):
    rows = spark.createDataFrame([([d if d is None else [{"start": a, "end": b} for a, b in d] for d in week],)], f"week {hours.WEEK_TYPE}")
    assert rows.select(schedule.write_week(F.col("week"))).first()[0] == said


def test_specifications(spark):
    times = {"12:00:00+04:00": 720, "9:00": 540, "9.30": 570, "9pm": 1260, "9:15 a.m.": 555, "12 am": 0, "12 noon": 720, "midnight": 0, "24:00": 1440, "24:30": None, "13pm": None, "9": None, "x": None, "9:75": None, "07:30Z": 450}
    rows = spark.createDataFrame([(t,) for t in times], "t string")
    assert {r.t: r.m for r in rows.select("t", schedule.minutes(F.col("t")).alias("m")).collect()} == times
    spec = "array<struct<days:array<string>,opens:string,closes:string,valid_from:string,valid_to:string>>"
    cases = [
        ([(["Monday", "Tue"], "9:00", "17:00", None, None), (["Mo"], "16:00", "23:59", None, None)], "Mo 09:00-24:00; Tu 09:00-17:00"),
        ([(["Sunday"], "18:00", "02:00", None, None), (["PublicHolidays"], "1:00", "2:00", None, None)], "Su 18:00-02:00"),
        ([(["Sunday"], "10:00", "12:00", None, None), (["Monday"], None, None, None, None), (["Friday"], "00:00", "00:00", None, None)], "Su 10:00-12:00"),
        ([(["Sunday"], "10:00", "12:00", "2026-01-01", "2026-02-01")], None),
        ([(["Sunday"], "10:00", "12:00", "2026-01-01", "2026-12-31")], "Su 10:00-12:00"),
        ([(["Someday"], "10:00", "12:00", None, None)], None),
        ([(["Sunday"], "22:00", "14:00", None, None)], None),
        ([(["Sunday"], "10:00", None, None, None)], None),
        ([], None),
    ]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"k long, rows {spec}")
    got = {r.k: r.said for r in rows.select("k", schedule.write_week(schedule.spec_week(F.col("rows"))).alias("said")).collect()}
    assert got == {i: said for i, (_, said) in enumerate(cases)}
    valid = ["24/7", "Mo-We,Fr 10:00-20:00,21:00-24:00; Su off"]
    wrong = ["Mo 10:00-10:00", "Mo 25:00-26:00", "Monday 10:00-20:00", "Mo 10:00-20:00;Tu off", None, "", "Mo " + ",".join(["10:00-20:00"] * 30)]
    checked = spark.createDataFrame([(t,) for t in valid + wrong], "t string").select("t", schedule.valid_hours(F.col("t")).alias("v")).collect()
    assert [r.v for r in checked] == [True] * 2 + [False] * 7


@pytest.mark.parametrize("day", range(7))
def test_all_day_words(day):
    english, (short, stem) = hours.ENGLISH[day], hours.RUSSIAN[day]
    for word in (english, english[:2], english[:3], f"{english}s", english.capitalize(), short, stem, stem + "я", stem + "ам"):
        assert [d for d, spans in enumerate(hours.parse_week(f"{word} 10:00-12:00")) if spans] == [day], word
    assert hours.parse_week("daily 10:00-12:00; воскресенье выходной")[0] == [] and hours.parse_week("воскресенья 25:00-26:00") is None


def test_publication_is_never_without_a_version(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.range(5)
    outcomes = spark.createDataFrame([(True,), (True,), (None,)], "ok boolean")
    assert sinks.publish(rows, folder, outcomes, least_places=6) is None and sinks.current_version(spark, folder) is None
    assert sinks.publish(rows, folder, outcomes, least_places=5, most_failed=0.3) is None
    first = sinks.publish(rows, folder, outcomes, least_places=5, most_failed=0.4)
    seen = [sinks.current_version(spark, folder)]
    for n in range(3):
        sinks.publish(spark.range(n + 1), folder)
        seen.append(sinks.current_version(spark, folder))
    assert seen[0] == first and len(set(seen)) == 4 and spark.read.parquet(seen[-1]).count() == 3
    assert sorted(p.name for p in (tmp_path / "out" / "_pointers").iterdir() if not p.name.startswith(".")) == [f"{n:012d}" for n in range(1, 5)]
