"""Phrase dictionaries and the request grammar against plain Python and requests in our own words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.operators import lexicon
from wayfold.plans import grammar


def brute_tags(text, rows):
    """Tags by trying every phrase at every place."""
    singular = lambda w: re.sub(r"(?<=[a-z]{2}[a-rt-z])s$", "", w)
    split = lambda t: [singular(w) for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    said = split(text)
    spans = [(tag, excluded, i, i + len(split(p))) for tag, p, excluded, _ in rows for i in range(len(said)) if split(p) and said[i : i + len(split(p))] == split(p)]
    hit = {tag for tag, excluded, a, b in spans if not excluded and not any(t == tag and x and c <= a and b <= d for t, x, c, d in spans)}
    return [tag for tag in dict.fromkeys(r[0] for r in rows) if tag in hit]


def test_tags_against_brute_force(spark):
    rows = lexicon.entries(lexicon.PLACE_WORDS)
    assert len({r[0] for r in rows}) >= 80
    draw = random.Random(1)
    phrases = [r[1] for r in rows]
    texts = [" ".join(draw.choice([draw.choice(phrases), draw.choice(phrases) + "s", "near", "the,", "Pool", "TABLE", "car", "park"]) for _ in range(draw.randint(0, 6))) for _ in range(300)] + [None, "", "!!!", "bar " * 20_000]
    frame = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "k long, said string")
    out = {r.k: r.tags for r in lexicon.tagged(frame, ["k"], "said", lexicon.dictionary(spark, rows)).collect()}
    assert out == {(i if i != 7 else None): brute_tags(t, rows) for i, t in enumerate(texts)}


def test_matches_and_empty_dictionary(spark):
    frame = spark.createDataFrame([(1, "pool tables and a pool")], "k long, said string")
    words = lexicon.dictionary(spark, [("pool", "pool", False, 0), ("pool", "pool table", True, 0), ("none", "!", False, 1)])
    assert [tuple(r) for r in lexicon.matches(frame, ["k"], "said", words).collect()] == [(1, "pool", 0, 4, 5)]
    none = lexicon.dictionary(spark, [("none", "!", False, 1)])
    assert [tuple(r) for r in lexicon.tagged(frame, ["k"], "said", none).collect()] == [(1, [])]


def test_catalog_tags(spark):
    rows = [
        (1, "wine_bar", [], None, "X", ["bar"]), (2, "milk_bar", ["cafe"], None, "X", []), (3, None, None, None, None, []), (4, "golf_course", None, None, "Karate school", []),
        (5, "golf_course", None, None, "Dune Golf", ["golf"]), (6, "travel_service", [], None, "Desert Safari", ["tours"]), (7, "unknown", [], "cafe", "Museum", ["coffee"]),
        (8, "hotel", ["spa", "gym", "coffee_shop"], None, "X", ["hotel", "spa", "gym"]), (9, "topic", [], "food_wholesaler", "Sushi Bar", []), (10, "cafe", ["coffee_shop"], "bar", "X", ["coffee"]),
    ]
    frame = spark.createDataFrame([r[:5] for r in rows], "k long, category string, others array<string>, basic string, name string")
    out = {r.k: r.tags for r in lexicon.catalog_tags(frame, "k", "category", "others", "basic", "name", lexicon.dictionary(spark, lexicon.entries(lexicon.PLACE_WORDS))).collect()}
    assert out == {r[0]: r[5] for r in rows}


REQUESTS = [
    ("call me a cab to the airport", dict(action="taxi", categories=[])),
    ("Please reserve a table for four people at Blue Door", dict(action="book", place="Blue Door", party=4)),
    ("book at blue door tomorrow evening", dict(action="book", place="Blue Door", minutes=1200, day_from="2026-05-07")),
    ("how do I get to the Blue Door", dict(action="directions", place="Blue Door")),
    ("what's the menu of Blue Door?", dict(action="lookup", place="Blue Door")),
    ("is Blue Door open now", dict(action="lookup", place="Blue Door", strict=True)),
    ("call my dentist", dict(action="call", categories=["dentist"])),
    ("book shops", dict(action=None, categories=["books"])),
    ("rooftop bar", dict(place=None, categories=["bar"])),  # a kind, though a place has that name
    ("pool table", dict(categories=["billiards"])),
    ("coffee until 2 am", dict(categories=["coffee"], minutes=90, strict=True)),
    ("sushi before 19:30", dict(categories=["food"], minutes=1110)),
    ("pizza after midnight", dict(categories=["food"], minutes=0, strict=True)),
    ("breakfast", dict(categories=["food"], minutes=540, strict=False, meal="breakfast")),
    ("brunch on Sunday", dict(day_from="2026-05-10", day_to="2026-05-10", meal="brunch", minutes=780)),
    ("museums this weekend", dict(categories=["museum"], day_from="2026-05-09", day_to="2026-05-10")),
    ("24/7 pharmacy", dict(categories=["pharmacy"], conditions=["opening_hours=24/7"], strict=True)),
    ("not too expensive dinner", dict(price_max=2, price_min=None)),
    ("cheap but fancy restaurant", dict(price_max=1, price_min=None)),
    ("dinner under 300 dhs", dict(price_max=3, categories=["food"])),
    ("Michelin", dict(categories=["food"], conditions=["michelin=*"])),
    ("fine dining", dict(categories=["food"], price_min=3, conditions=["price=3", "price=4"])),
    ("girls' night", dict(categories=["bar", "hookah", "club", "food"], occasion="girls")),
    ("birthday", dict(categories=["food", "bar", "karaoke"], occasion="birthday")),
    ("birthday with my kids", dict(categories=["family", "themepark", "food"], kids=True)),
    ("business lunch", dict(categories=["food"], occasion="business")),
    ("theme park for ten people", dict(categories=["food"], party=10)),
    ("solo", dict(categories=["sights", "museum", "market", "gallery", "coffee"])),
    ("surprise me", dict(categories=list(grammar.VAGUE_DAY), vague=True)),
    ("things to do with kids", dict(categories=list(grammar.VAGUE_KIDS), vague=True)),
    ("too hot outside", dict(categories=list(grammar.INDOOR), indoor=True)),
    ("beach or cinema, it's raining", dict(categories=["cinema"], indoor=True)),
    ("dinner on a terrace with my dog", dict(categories=["food"], conditions=["outdoor_seating=yes", "dog=yes"])),
    ("live music", dict(categories=["concert"], conditions=["live_music=yes"])),
    ("dinner with a view of the sea near me", dict(view=True, near=True, categories=["food"])),
    ("nearest station", dict(categories=["metro"], conditions=["station=subway", "railway=tram_stop"])),
    ("gas station", dict(categories=["fuel"])),
    ("emergency", dict(categories=["hospital"], conditions=["emergency=yes"])),
    ("dim sum and gluten-free cakes", dict(categories=["pastry"])),
    ("tonight", dict(categories=list(grammar.NIGHT), minutes=1200, strict=True)),
    ("what is open now", dict(categories=list(grammar.DAY), strict=True)),
    ("", dict(categories=[], strict=False)),
    (None, dict(categories=[], action=None)),
]


@pytest.fixture(scope="module")
def answered(spark):
    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(REQUESTS)], "k long, said string")
    names = spark.createDataFrame([("Blue Door",), ("The Rooftop Bar",), (None,)], "name string")
    out = grammar.plans(asked, ["k"], "said", names, lexicon.dictionary(spark, lexicon.entries(lexicon.PLACE_WORDS)), F.lit("2026-05-06").cast("date"), F.lit(15))
    return {r.k: r for r in out.collect()}


def test_every_request_is_answered_once(answered):
    assert sorted(answered) == list(range(len(REQUESTS)))


@pytest.mark.parametrize("number", range(len(REQUESTS)), ids=[str(q)[:40] for q, _ in REQUESTS])
def test_requests(answered, number):
    got, wanted = answered[number].asDict(), REQUESTS[number][1]
    got = {k: str(v) if k.startswith("day_") and v is not None else v for k, v in got.items()}
    assert {k: got[k] for k in wanted} == wanted
