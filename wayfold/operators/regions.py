"""Points in polygons with holes, by grid cells and edge crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.lineage import broadcast_if_small

Ring = tuple[tuple[float, float], ...]


def region_table(spark: SparkSession, regions: dict[str, tuple[Ring, ...]]) -> DataFrame:
    """(region, edges) from rings of (lat, lon)."""
    rows = [(name, [(*a, *b) for ring in rings for a, b in zip(ring, (*ring[1:], ring[0]))]) for name, rings in regions.items()]
    return spark.createDataFrame(rows, "region string, edges array<struct<y1:double,x1:double,y2:double,x2:double>>")


def inside(points: DataFrame, regions: DataFrame, key: str, per_degree: int = 20) -> DataFrame:
    """(key, region) for the points (key, lat, lon) inside a region: those whose line to the east crosses its edges an odd number of times.

    Regions are copied to the grid cells of their box, so that points meet them by an equi-join on cells.
    """
    ys, xs = F.col("edges.y1"), F.col("edges.x1")
    cells = lambda v: F.sequence(geo.cell(F.array_min(v), per_degree), geo.cell(F.array_max(v), per_degree))
    spread = regions.select("region", "edges", F.explode(cells(ys)).alias("cy"), cells(xs).alias("row")).select("region", "edges", "cy", F.explode("row").alias("cx"))
    celled = points.select(key, "lat", "lon", geo.cell(F.col("lat"), per_degree).alias("cy"), geo.cell(F.col("lon"), per_degree).alias("cx"))
    met = celled.join(broadcast_if_small(spread, 10_000), ["cy", "cx"])
    lat, lon = F.col("lat"), F.col("lon")
    crossed = F.filter("edges", lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return met.filter(F.size(crossed) % 2 == 1).select(key, "region")
