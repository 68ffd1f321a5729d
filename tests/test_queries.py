"""Every query with SQL gives the rows that DuckDB gives on the same tables; the others are compared with plain Python."""

import datetime
import decimal

import duckdb
import pytest

from wayfold import catalog
from wayfold.operators import rank, resolve
from wayfold.plans import table_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 6) + 0.0)
    return repr(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    said = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(got.columns) == sorted(names)
    expected = sorted(tuple(map(plain, row)) for row in said.fetchall())
    assert sorted(tuple(map(plain, row)) for row in got.select(*names).collect()) == expected


def events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").collect()
    by_user = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        by_user.setdefault(r.user_id, []).append(r)
    return by_user


def seconds(ts):
    return int((ts - datetime.datetime(1970, 1, 1)).total_seconds() // 1)


def test_rate_limit(spark):
    expected = {}
    for user, rows in events(spark).items():
        hits, no = [], 0
        for r in rows:
            t = seconds(r.ts)
            if sum(h > t - 86400 for h in hits) < 2:
                hits.append(t)
            else:
                no += 1
        expected[user] = (len(hits), no)
    assert {r.user_id: (r.accepted, r.rejected) for r in catalog.QUERIES["rate_limited"](spark, SF).collect()} == expected


def test_breaker(spark):
    expected = {}
    for user, rows in events(spark).items():
        bad, since, made, cut, opened = 0, None, 0, 0, 0
        for r in rows:
            t = seconds(r.ts)
            if since is not None and t < since + 6 * 3600:
                cut += 1
                continue
            made += 1
            bad = bad + 1 if r.event_type == "error" else 0
            since = t if r.event_type == "error" and bad >= 2 else None
            opened += since is not None
        expected[user] = (made, cut, opened)
    assert {r.user_id: (r.calls_made, r.short_circuited, r.opened) for r in catalog.QUERIES["breaker_states"](spark, SF).collect()} == expected


def test_suppression_is_greedy(spark):
    conflicts = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (2, 6), (4, 7)]
    kept = []
    for k in range(1, 10):
        if not any((e, k) in conflicts for e in kept):
            kept.append(k)
    rows = spark.createDataFrame([(k,) for k in range(1, 10)], "key long")
    got = resolve.suppress_later(rows, spark.createDataFrame(conflicts, "early long, late long"), "key")
    assert sorted(r.key for r in got.collect()) == kept
    assert resolve.suppress_later(rows, spark.createDataFrame([], "early long, late long"), "key").count() == 9


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(k,) for k in range(40)], "node long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    got = {r.node: r.label for r in resolve.components(nodes, edges).collect()}
    assert got == {k: 0 if k <= 30 else k for k in range(40)}


def test_top_five_is_greedy(spark):
    cards = rank.final_order(table_queries._cards(spark, SF), "query", 200).collect()
    got = {(r.query, r.place): r.card for r in catalog.QUERIES["top_five"](spark, SF).collect()}
    for query in {c.query for c in cards}:
        left, chosen = [c for c in cards if c.query == query], []
        for place in range(1, 6):
            def gain(c):
                return c.score - sum(10 * (c.category == o.category) + 7 * (c.lead == o.lead) + 2 * (c.provider == o.provider) for o in chosen)

            best = max(left, key=lambda c: (round(gain(c), 9), -c.card))
            assert got[query, place] == best.card
            chosen.append(best)
            left.remove(best)


def test_top_five_sees_every_card(spark, monkeypatch):
    rows = [(1, k, 1000.0 - k / 1000, "a", "x", "p", 1.0, 1.0) for k in range(250)] + [(1, 900, 990.0, "b", "y", "q", 1.0, 1.0)]
    cards = spark.createDataFrame(rows, "query long, card long, score double, category string, lead string, provider string, quality double, km double")
    monkeypatch.setattr(table_queries, "_cards", lambda *_: cards)
    assert {r.place: r.card for r in catalog.QUERIES["top_five"](spark, SF).collect()} == {1: 0, 2: 900, 3: 1, 4: 2, 5: 3}


def test_quantile_ranks_read_no_group_in_one_task(spark):
    rows = [("a", float(k * 7919 % 1000 // 3)) for k in range(1000)] + [("b", 5.0)] * 40 + [(None, 2.0), (None, 1.0), ("a", None), ("c", None)]
    table_ = spark.createDataFrame(rows, "g string, v double")
    expected = {}
    for g in ("a", "b", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        expected[g] = (len(v), v[len(v) // 2], v[int(len(v) * 0.95)], v[-1])
    ranks = rank.quantile_ranks(table_, "g", "v", {"p50": 0.5, "p95": 0.95})
    assert {r.g: (r.n, r.p50, r.p95, r.most) for r in ranks.collect()} == expected
    plan = catalog.QUERIES["latency_ranks"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_request_plans(spark):
    rows = {r.conv_id % 5: r for r in catalog.QUERIES["request_plans"](spark, SF).collect()}
    assert rows[0].cheap and rows[0].tonight and rows[0].near and rows[0].minutes == 19 * 60 + 30 and "restaurant" in rows[0].categories
    assert rows[1].kids and rows[1].tomorrow and rows[1].most_price == 0 and "museum" in rows[1].categories
    assert rows[2].weekend and rows[2].minutes == 615 and rows[2].stops == 3
    assert rows[3].indoor and rows[3].most_price == 1200 and rows[4].minutes == 720 and rows[4].stops == 1


def test_request_plans_read_whole_user_turns(spark, tmp_path):
    late = "words that say nothing at all about it, " * 3
    rows = [
        (1, 0, "system", "cheap dinner at 7 pm"), (1, 1, "user", late + "cheap dinner at 9:15 pm for AED 80 then a museum"), (1, 2, "assistant", "a bar"), (1, 3, "user", late + "the beach tomorrow; coffee; a park"),
        (2, 0, "user", late + "free concert"), (3, 0, "user", None),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in catalog.QUERIES["request_plans"](spark, str(tmp_path)).collect()}
    assert {k for k in got if k[0] >= 0} == {(1, 1), (1, 3), (2, 0), (3, 0)} and len(got) == 4 + len(table_queries.REQUESTS)
    first, second, third = got[1, 1], got[1, 3], got[2, 0]
    assert first.cheap and (first.minutes, first.most_price, first.stops, first.categories) == (21 * 60 + 15, 80, 2, "restaurant;museum")
    assert second.tomorrow and (second.minutes, second.stops, second.categories) == (None, 3, "cafe;park;beach")
    assert not third.cheap and (third.most_price, third.stops, third.categories) == (0, 1, "concert")


def test_streams_agree_with_batches(spark):
    streamed = {(r.user_id, r.started): r.events for r in catalog.QUERIES["streamed_sessions"](spark, SF).collect()}
    batch = {(r.user_id, r.started): r.events for r in catalog.QUERIES["user_sessions"](spark, SF).collect()}
    assert streamed and set(streamed.items()) <= set(batch.items())
    assert len(batch) - len(streamed) <= len({u for u, _ in batch})
