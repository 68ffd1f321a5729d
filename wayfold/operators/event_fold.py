"""Events of several sources folded into one list: in feed order, a row joins the first event of the list that is the same, and the merged
event is what later rows are compared with.

The outcome depends on the order, so the fold itself is sequential; it is made parallel by blocks that can't touch each other.
Two events can only be the same if they share a title word (or, without such words, the whole name), meet in place and overlap in
days. A merged event has its title, its place and its days from events that it is made of, so whatever it meets is connected with one of
them in each of the three. Blocks are therefore components by title words, within them components by place (the same or neighbouring
cells, the same venue or one venue's name in the other's), and within these islands of overlapping days. All three are supersets
of what the comparison accepts; no pairs of rows are made for them, only edges from rows to words, cells and venues.

Blocks are dealt by Spark and folded as sorted streams. A task holds the list of merged events of one block: a calendar in which
one title runs at one place through all days is one block and one task, which is in the nature of the fold.

Defined cases: null names, venues and coordinates match nothing; rows with a null start or end are left as they are; equal keys are
folded in any order; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import resolve
from wayfold.operators.lineage import cut

NEAR_KM, CELLS_PER_DEGREE = 0.4, 200
SHORTER_SHARE, LONGER_SHARE = 0.75, 0.5
#: Days of a stretch by which listed events are found.
STRETCH, _NONE = 32, frozenset()
# Words of titles that tell nothing about the event, tags in the order of display, and trust in sources.
STOP_WORDS = "a an and at by comedy concert dubai feat festival ft in live night of on present presents s show the ticket tickets tour uae vs with x 2026 2027".split()
TAGS = ("concert", "theatre", "comedy", "exhibition", "festival", "club", "kids", "sport")
SOURCE_RANK = {"venue": 3, "tickets": 2, "guide": 1}
FIELDS = "key long, name string, venue string, lat double, lon double, day_start date, day_end date, days array<date>, tags array<string>, price double, time string, source string, url string"
_OUT = f"{FIELDS}, also array<string>, members long"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def title_words(name: Column) -> Column:
    """Distinct words of a title that tell what it is about."""
    return F.array_distinct(F.filter(F.split(normal(name), " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def venue_key(venue: Column) -> Column:
    """The first three telling words before a comma."""
    return F.array_join(F.slice(title_words(F.substring_index(venue, ",", 1)), 1, 3), " ")


def _labelled(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``rows`` with _part, the component of their _block that their _nodes (names, none null) and edges ``more`` (_block, a, b) connect them in; without nodes, their own.

    Rows with the same nodes are one path of edges, so that components are of names, not of rows.
    """
    name = lambda node: F.concat_ws("|", F.col("_block"), node)
    paths = rows.filter("size(_nodes) > 0").select("_block", "_nodes").distinct()
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_nodes") - 2, F.lit(0))), lambda i: F.struct(F.get("_nodes", i).alias("a"), F.coalesce(F.get("_nodes", i + 1), F.get("_nodes", i)).alias("b"))))
    edges = paths.select("_block", steps.alias("s")).select("_block", "s.a", "s.b")
    edges = cut((edges if more is None else edges.unionByName(more)).select(name(F.col("a")).alias("a"), name(F.col("b")).alias("b")).distinct())
    every = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    parts = resolve.components(every, edges.filter("a <> b")).select(F.col("node").alias("_first"), F.concat(F.lit("n|"), "label").alias("_part"))
    first = F.when(F.size("_nodes") > 0, name(F.get("_nodes", F.lit(0))))
    return rows.withColumn("_first", first).join(parts, "_first", "left").withColumn("_part", F.coalesce("_part", F.concat_ws("|", F.lit("r"), "_block", F.col("key").cast("string")))).drop("_first", "_nodes")


def blocks(events: DataFrame) -> DataFrame:
    """``events`` with _block: rows of different blocks never meet in the fold, whatever is merged."""
    rows = events.withColumn("_block", F.lit("0"))
    words = F.when(F.size(title_words(F.col("name"))) > 0, title_words(F.col("name"))).otherwise(F.array(F.concat(F.lit("="), normal(F.col("name")))))
    rows = cut(_labelled(rows.withColumn("_nodes", words)).withColumn("_block", F.sha1("_part")).drop("_part"))

    cell = lambda y, x: F.concat_ws(":", F.lit("cell"), y, x)
    place = rows.select("_block", venue_key(F.col("venue")).alias("venue"), geo.cell(F.col("lat"), CELLS_PER_DEGREE).alias("y"), geo.cell(F.col("lon"), CELLS_PER_DEGREE).alias("x")).distinct()
    place = cut(place)
    venues = place.filter("venue <> ''").select("_block", "venue").distinct()
    cells = place.filter("y is not null and x is not null").select("_block", "y", "x").distinct()
    # Venues contained in others: every part of a venue's name is looked up among the names of its block.
    parts = venues.select("_block", F.col("venue").alias("b"), F.explode(F.sequence(F.lit(1), F.length("venue"))).alias("i"))
    parts = parts.select("_block", "b", F.explode(F.transform(F.sequence(F.lit(1), F.length("b") - F.col("i") + 1), lambda n: F.substring(F.col("b"), F.col("i"), n))).alias("a")).distinct()
    inside = parts.join(venues.select("_block", F.col("venue").alias("a")), ["_block", "a"]).filter("a <> b").select("_block", "a", "b")
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    around = cells.select("_block", "y", "x", steps.alias("s")).select("_block", cell(F.col("y"), F.col("x")).alias("a"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    beside = around.join(cells, ["_block", "y", "x"]).select("_block", "a", cell(F.col("y"), F.col("x")).alias("b"))
    y, x = geo.cell(F.col("lat"), CELLS_PER_DEGREE), geo.cell(F.col("lon"), CELLS_PER_DEGREE)
    nodes = F.array_compact(F.array(F.nullif(venue_key(F.col("venue")), F.lit("")), F.when(y.isNotNull() & x.isNotNull(), cell(y, x))))
    rows = _labelled(rows.withColumn("_nodes", nodes), inside.unionByName(beside)).withColumn("_block", F.sha1("_part")).drop("_part")

    order = Window.partitionBy("_block").orderBy("day_start", "day_end", "key")
    before = F.max("day_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (before < F.col("day_start")), 1).otherwise(0)).over(order)
    return cut(rows.withColumn("_island", island).withColumn("_block", F.concat_ws("/", "_block", F.col("_island").cast("string"))).drop("_island"))


def _same(a: dict, b: dict) -> bool:
    if a["day_start"] != b["day_start"] and (a["day_end"] < b["day_start"] or b["day_end"] < a["day_start"]):
        return False
    if not (a["_venue"] and b["_venue"] and (a["_venue"] in b["_venue"] or b["_venue"] in a["_venue"]) or _near(a, b)):
        return False
    both, sizes = len(a["_words"] & b["_words"]), sorted((len(a["_words"]), len(b["_words"])))
    if not sizes[0]:
        return a["_normal"] == b["_normal"]
    return both >= 1 and (both >= SHORTER_SHARE * sizes[0] or both >= LONGER_SHARE * sizes[1])


def _near(a: dict, b: dict) -> bool:
    if None in (a["lat"], a["lon"], b["lat"], b["lon"]):
        return False
    y1, y2 = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, h))) <= NEAR_KM


def _merged(a: dict, b: dict) -> dict:
    """One event of two: each field of the more trusted source that has it, the listed event's on equal trust."""
    high, low = (b, a) if SOURCE_RANK.get(b["source"], 0) > SOURCE_RANK.get(a["source"], 0) else (a, b)
    out = {k: v if v not in (None, "", []) else low[k] for k, v in high.items()}
    if high["name"] in (None, ""):
        out |= {k: low[k] for k in ("_words", "_normal")}
    else:
        out |= {k: high[k] for k in ("_words", "_normal")}
    point = high if None not in (high["lat"], high["lon"]) else low
    out |= {"lat": point["lat"], "lon": point["lon"], "key": a["key"], "members": a["members"] + b["members"]}
    out["_venue"] = high["_venue"] if high["venue"] not in (None, "") else low["_venue"]
    if not high["days"]:
        out |= {"day_start": min(a["day_start"], b["day_start"]), "day_end": max(a["day_end"], b["day_end"]), "days": low["days"]}
    tags = {*(a["tags"] or ()), *(b["tags"] or ())}
    out["tags"] = [t for t in TAGS if t in tags]
    # The listed event's addresses are kept in one dict that grows: a copy for each row would make long events quadratic.
    links = a["also"] if isinstance(a["also"], dict) else dict.fromkeys(a["also"])
    links.update(dict.fromkeys(u for u in (*b["also"], a["url"], b["url"]) if u and u not in links))
    links.pop(out["url"], None)
    out["also"] = links
    return out


def _places_in_index(event: dict) -> tuple[set, int, int]:
    """The words (the whole name, if it has none) and the first and last stretch of days that an event is found by."""
    first, last = sorted((event["day_start"].toordinal(), event["day_end"].toordinal()))
    return event["_words"] or {"=" + event["_normal"]}, first // STRETCH, last // STRETCH


class _Index:
    """Numbers of listed events by word and stretch of days: whatever is the same as a row is found there."""

    def __init__(self) -> None:
        self.found: dict[str, dict[int, set[int]]] = {}

    def change(self, i: int, event: dict, before: dict | None) -> None:
        words, first, last = _places_in_index(event)
        if before is not None:
            old, low, high = _places_in_index(before)
            for word in old:
                known = self.found[word]
                for day in range(low, high + 1) if word not in words else (*range(low, first), *range(last + 1, high + 1)):
                    if low <= day <= high:
                        known[day].discard(i)
        for word in words:
            known = self.found.setdefault(word, {})
            if before is not None and word in old:
                days = (*range(first, min(low, last + 1)), *range(max(high + 1, first), last + 1))
            else:
                days = range(first, last + 1)
            for day in days:
                known.setdefault(day, set()).add(i)

    def near(self, row: dict) -> list[int]:
        words, first, last = _places_in_index(row)
        some: set[int] = set()
        for known in filter(None, map(self.found.get, words)):
            for day in range(first, last + 1):
                some |= known.get(day, _NONE)
        return sorted(some)


def fold(rows: list[dict]) -> list[dict]:
    """The merged events of rows in order."""
    events: list[dict] = []
    index = _Index()
    for row in rows:
        if None in (row["day_start"], row["day_end"]):
            events.append(row)
            continue
        at = next((i for i in index.near(row) if _same(events[i], row)), None)
        if at is None:
            at, before = len(events), None
            events.append(row)
        else:
            before, events[at] = events[at], _merged(events[at], row)
        index.change(at, events[at], before)
    return [e | {"also": list(e["also"])} for e in events]


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, rows, schema = None, [], None

    def told(events: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{f.name: e[f.name] for f in schema} for e in events], schema=schema)

    for batch in batches:
        if schema is None:
            kept = [f for f in batch.schema if not f.name.startswith("_")]
            schema = pa.schema([*kept, pa.field("also", pa.list_(pa.string())), pa.field("members", pa.int64())])
        for row in batch.to_pylist():
            if row["_block"] != block:
                if rows:
                    yield told(fold(rows))
                block, rows = row["_block"], []
            rows.append(row | {"_words": frozenset(row["_words"]), "also": [], "members": 1})
    if rows:
        yield told(fold(rows))


def dedupe(events: DataFrame) -> DataFrame:
    """The merged events of ``events`` (the columns of ``FIELDS``, key being the feed's order): the same columns, also (other addresses), members."""
    named = [f.split(" ")[0] for f in FIELDS.split(", ")]
    rows = blocks(events.select(*named)).withColumns({"_words": title_words(F.col("name")), "_venue": venue_key(F.col("venue")), "_normal": normal(F.col("name"))})
    return rows.repartition("_block").sortWithinPartitions("_block", "key").mapInArrow(_fold_blocks, _OUT)
