"""Cases of the third review: edges of cells, seconds of sessions, and copies of places, against SQL and plain Python."""

import datetime
import random

import duckdb

from wayfold import catalog
from wayfold.operators import event_fold, matching, quad, resolve
from wayfold.plans import evening, grammar, page_queries
from wayfold.sources import tables

SF = "/root/testdata/sf0.1"


def same_as_sql(spark, name, folder, *tables):
    """Whether the query gives the rows of its SQL, on tables as they are in the folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')")
    said = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    plain = lambda row: tuple(repr(round(x, 6) if isinstance(x, float) else x) for x in row)
    expected = sorted(map(plain, said.fetchall()))
    assert expected and sorted(map(plain, catalog.QUERIES[name](spark, str(folder)).select(*names).collect())) == expected


def test_cells_have_the_edges_that_are_told(spark):
    same_as_sql(spark, "quad_cells", SF, "customer")
    box = (24.79, 54.89, 25.36, 55.56)
    middle = (box[0] + (box[0] + box[2]) / 2) / 2
    rows = spark.createDataFrame([(middle, box[1]), (box[0], box[1])], "lat double, lon double")
    assert [r.c for r in rows.select(quad.cell_name(rows.lat, rows.lon, box, 2).alias("c")).collect()] == ["02", "00"]
    assert rows.select(quad.cell_name(rows.lat, rows.lon, box, 0).alias("c")).first().c == ""


def test_sessions_count_rounded_seconds(spark, tmp_path):
    draw, start, rows = random.Random(3), datetime.datetime(2024, 1, 1), []
    for user in range(60):
        at = draw.random()
        for k in range(12):
            at += draw.choice([7200, 7199, 7201]) + draw.choice([-0.7, -0.5, -0.2, 0.0, 0.2, 0.5, 0.7])
            rows.append((user * 100 + k, start + datetime.timedelta(seconds=round(at, 1)), user))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, "user_sessions", tmp_path, "events")


def customers_at(spark, folder, keys):
    """Customers of one nation; keys that are equal modulo 10,000 stand at one point."""
    rows = [(k, f"c{k}", 1, 0.0, "BUILDING") for k in keys]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")


def test_copies_of_a_place_make_no_pairs(spark, tmp_path, monkeypatch):
    customers_at(spark, tmp_path, [p + 10000 * i for p in (3, 4, 5, 6) for i in range(200)])
    made, suppress, components = [], resolve.suppress_later, resolve.components
    monkeypatch.setattr(resolve, "suppress_later", lambda rows, pairs, key: made.append(pairs.count()) or suppress(rows, pairs, key))
    monkeypatch.setattr(resolve, "components", lambda nodes, edges: made.append(edges.count()) or components(nodes, edges))
    kept = {r.c_custkey for r in catalog.QUERIES["suppressed"](spark, str(tmp_path)).collect()}
    assert kept and kept <= {3, 4, 5, 6}
    same_as_sql(spark, "place_components", tmp_path, "customer")
    assert len(made) == 2 and max(made) <= 6


def orders_at(spark, folder, keys):
    start = datetime.datetime(1996, 6, 1)
    rows = [(k, k % 7, "O", 1000.0, start + datetime.timedelta(days=k // 10000 % 3), "1-URGENT") for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")


def test_copies_of_a_venue_make_no_pairs(spark, tmp_path, monkeypatch):
    orders_at(spark, tmp_path, [p + 420000 * i for p in (3, 4, 5) for i in range(150)])
    made, suppress = [], resolve.suppress_later
    monkeypatch.setattr(resolve, "suppress_later", lambda rows, pairs, key: made.append(pairs.count()) or suppress(rows, pairs, key))
    kept = catalog.QUERIES["repeated_venues"](spark, str(tmp_path)).count()
    assert 1 <= kept <= 3 * 28 and len(made) == 1 and made[0] <= (3 * 28) ** 2 / 2


def paired_rows(monkeypatch):
    """Numbers of rows that the grid joins of later queries get."""
    sizes, pairs = [], resolve.pairs_within
    monkeypatch.setattr(resolve, "pairs_within", lambda left, right, *more: sizes.append((left.count(), right.count())) or pairs(left, right, *more))
    return sizes


def test_copies_of_a_venue_are_matched_once(spark, tmp_path, monkeypatch):
    orders_at(spark, tmp_path, [p + 10000 * i for p in (3, 4, 5, 7) for i in range(300)])
    sizes = paired_rows(monkeypatch)
    same_as_sql(spark, "venue_matches", tmp_path, "orders")
    assert len(sizes) == 1 and max(sizes[0]) <= 4


def test_copies_of_an_event_are_compared_once(spark, tmp_path, monkeypatch):
    orders_at(spark, tmp_path, [p + 10000 * i for p in (2, 4, 7, 9) for i in range(60)])
    sizes = paired_rows(monkeypatch)
    same_as_sql(spark, "event_matches", tmp_path, "orders")
    assert len(sizes) == 1 and sizes[0][1] <= 4 * 5 * 3


def sizes_of(monkeypatch, module, name, of=lambda *args: args[0]):
    """Numbers of rows that a function of a module gets."""
    sizes, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *args: sizes.append(of(*args).count()) or plain(*args))
    return sizes


def test_evening_plans_search_few_copies(spark, monkeypatch):
    spots = [(25.0 + p / 1000, 55.0 + p / 500) for p in range(4)]
    places = spark.createDataFrame([(k, "food", *spots[k % 4]) for k in range(400)], "place long, category string, lat double, lon double")
    requests = spark.createDataFrame([(r, 25.0, 55.0, 600, ["food"] * 5) for r in range(3)], "request long, lat double, lon double, start int, categories array<string>")
    sizes = sizes_of(monkeypatch, evening, "_nearest", lambda asked, places, _: places)
    got = {(r.request, r.stop): r.place for r in evening.plan_stops(requests, places, 5).collect()}
    assert got == {(r, s + 1): 4 * s for r in range(3) for s in range(5)}
    assert max(sizes) <= 4 * 5


def test_copies_on_a_chains_site_are_compared_once(spark, tmp_path, monkeypatch):
    customers_at(spark, tmp_path, [240 * p + 480000 * i for p in (1, 2, 3) for i in range(250)] + [1, 2, 5, 6, 9, 10, 13, 14])
    sizes = sizes_of(monkeypatch, matching, "cut")
    same_as_sql(spark, "site_matches", tmp_path, "customer")
    assert len(sizes) >= 2 and max(sizes) <= 2000


def test_copies_of_hotels_are_compared_once(spark, tmp_path, monkeypatch):
    customers_at(spark, tmp_path, [p + 90000 * i for p in (0, 1, 2, 3) for i in range(200)])
    sizes = sizes_of(monkeypatch, matching, "cut")
    same_as_sql(spark, "hotel_doubles", tmp_path, "customer")
    assert min(sizes) <= 8


def test_requests_of_a_text_and_hour_are_read_once(spark, tmp_path, monkeypatch):
    orders_at(spark, tmp_path, [p + 2520 * i for p in (1, 2, 33) for i in range(100)])
    sizes = sizes_of(monkeypatch, grammar, "marks")
    same_as_sql(spark, "request_intents", tmp_path, "orders")
    assert len(sizes) == 1 and sizes[0] <= 30


def test_equal_specifications_are_written_once(spark, tmp_path, monkeypatch):
    customers_at(spark, tmp_path, range(400))
    sizes = sizes_of(monkeypatch, page_queries, "spread")
    same_as_sql(spark, "hours_written", tmp_path, "customer")
    assert min(sizes) <= 80


def plain_fold(rows):
    """Each row joined to the first listed event that is the same, by trying all of them."""
    events = []
    for row in rows:
        at = None if None in (row["day_start"], row["day_end"]) else next((i for i, e in enumerate(events) if None not in (e["day_start"], e["day_end"]) and event_fold._same(e, row)), None)
        if at is None:
            events.append(row)
        else:
            events[at] = event_fold._merged(events[at], row)
    return [e | {"also": list(e["also"])} for e in events]


def test_fold_tries_few_listed_events(monkeypatch):
    draw, rows, day = random.Random(5), [], datetime.date(2026, 1, 1)
    for k in range(1500):
        first = draw.randint(0, 1500)
        words = frozenset(draw.sample([f"w{n}" for n in range(300)], draw.randint(0, 3)) + ["all"] * (k % 5 == 0))
        days = (None, None) if k % 50 == 0 else (day + datetime.timedelta(first), day + datetime.timedelta(first + draw.choice([0, 5, 90, -3])))
        rows.append({
            "key": k, "name": " ".join(sorted(words)) or None, "venue": "hall", "_venue": "hall", "lat": None, "lon": None, "day_start": days[0], "day_end": days[1], "days": [days[0]] if draw.random() < 0.3 and days[0] else [], "tags": [], "price": None,
            "time": None, "source": draw.choice(["venue", "tickets", "guide"]), "url": draw.choice([None, f"u{k % 40}", f"u{k}"]), "_words": words, "_normal": " ".join(sorted(words)), "also": [], "members": 1,
        })
    expected, tried, same = plain_fold([dict(r) for r in rows]), [0], event_fold._same
    monkeypatch.setattr(event_fold, "_same", lambda a, b: tried.__setitem__(0, tried[0] + 1) or same(a, b))
    assert event_fold.fold([dict(r) for r in rows]) == expected and len(expected) < len(rows)
    assert tried[0] < 20 * len(rows)


def test_narrow_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_OF_A_TASK", 20, raising=False)
    assert tables.spread(spark.range(1000, numPartitions=8)).rdd.getNumPartitions() == 50
