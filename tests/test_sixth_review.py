"""Cases of the sixth review: queries in a session of their own, and what they hold and write."""

import os
import random
import subprocess
import sys
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from wayfold import catalog
from wayfold.functions import geo
from wayfold.operators import resolve
from wayfold.plans import venue_queries

FIRST_IN_ITS_SESSION = """
import sys, tempfile
from pyspark.sql import SparkSession
from wayfold import catalog

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", tempfile.mkdtemp()).getOrCreate()
print(sorted(map(tuple, catalog.QUERIES[sys.argv[1]](spark, sys.argv[2]).collect())))
"""


def test_address_verdicts_run_first_in_a_session():
    # Only there the columns of the districts have the ids that lambda variables have too.
    sf = "/root/testdata/sf0.01"
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    run = subprocess.run([sys.executable, "-c", FIRST_IN_ITS_SESSION, "address_verdicts", sf], env=env, capture_output=True, text=True, timeout=300)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{sf}/customer.parquet'")
    expected = sorted(con.execute(catalog.ORACLE_SQL["address_verdicts"]).fetchall())
    assert expected and run.stdout.strip() == str(expected), run.stderr[-2000:]


def test_components_keep_their_estimated_size_and_few_rounds(spark, monkeypatch):
    # The estimate of a checkpointed join is a product, and its digits doubled with every round.
    draw, n = random.Random(7), 300
    names = draw.sample(range(n), n)
    side = 15
    grid = [(names[k], names[k + step]) for k in range(n) for step in (1, side) if k + step < n and (step > 1 or (k + 1) % side)]
    nodes = spark.createDataFrame([(k,) for k in range(n + 2)], "node long")
    stored, plain = [], getattr(resolve, "store", None)
    monkeypatch.setattr(resolve, "store", lambda df: stored.append(df) or plain(df), raising=False)
    labels = resolve.components(nodes, spark.createDataFrame(grid, "a long, b long"))
    assert {r.node: r.label for r in labels.collect()} == {k: 0 if k < n else k for k in range(n + 2)}
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1_000_000
    assert len(stored) <= 7


def test_event_matches_shuffle_no_pairs(spark, monkeypatch):
    cuts, plain = [], getattr(venue_queries, "cut", None)
    monkeypatch.setattr(venue_queries, "cut", lambda df: cuts.append(df) or plain(df), raising=False)
    plan = catalog.QUERIES["event_matches"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert not cuts and plan.count("Join ") == 1
    # Only what goes into the join is dealt out.
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("Join ")]


def test_pairs_within_find_all_near_points_with_few_copies(spark):
    draw, points = random.Random(11), []
    for k in range(400):
        lat, lon = draw.choice([25.2, -33.4, 0.0, 68.9]), draw.choice([55.3, -70.0])
        points.append((k, lat + draw.choice([0.0, 0.02, draw.random() / 40]), lon + draw.choice([0.0, 0.02, draw.random() / 40])))
    rows = spark.createDataFrame(points, "k long, lat double, lon double")
    sides = rows.select(F.struct("*").alias("l")).crossJoin(rows.select(F.struct("*").alias("r")))
    apart = geo.haversine_km(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"))
    expected = {(x.a, x.b) for x in sides.filter(apart <= 0.4).select(F.col("l.k").alias("a"), F.col("r.k").alias("b")).collect()}
    got = [(x.l.k, x.r.k) for x in resolve.pairs_within(rows, rows, 0.4, 50).collect()]
    assert len(got) == len(expected) > 400 and set(got) == expected
    copies = rows.select(F.explode(geo.cells_within(F.col("lat"), F.col("lon"), 0.4, 50))).count()
    assert copies < 4 * len(points)
