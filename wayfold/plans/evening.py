"""Plans of several stops: each stop's search is anchored at the place before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.lineage import cut

#: Cells grow by this factor until one holds the whole range of degrees.
COARSER = 4
#: Points that a cell holds about at first, and the square of the most cells of a degree.
POINTS_OF_A_CELL, MOST_CELLS = 4, 2000**2


def _km_to_edge(lat: Column, lon: Column, per_degree: float) -> Column:
    """Less than the distance to any place outside the 3 x 3 cells around a point; past 180 degrees east or west counts as outside."""
    y, x = geo.cell(lat, per_degree), geo.cell(lon, per_degree)
    north_south = F.least(lat - (y - 1) / per_degree, (y + 2) / per_degree - lat)
    east_west = F.least(lon - F.greatest((x - 1) / per_degree, F.lit(-180.0)), F.least((x + 2) / per_degree, F.lit(180.0)) - lon)
    to_meridian = F.when(east_west < 90, F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(east_west)))).otherwise(F.radians(90 - F.abs(lat)))
    return F.least(F.radians(north_south), to_meridian) * geo.EARTH_KM * (1 - 1e-9)


def _nearest(asked: DataFrame, places: DataFrame, per_degree: float) -> DataFrame:
    """(request, place, km, lat, lon) for every request (request, category, at_lat, at_lon, used) with an unused place of its category.

    A place found in the 3 x 3 cells around is the answer if it is nearer than their edge; the other requests
    are asked again on coarser cells, at last on cells that leave nothing outside.
    """
    answers, left = None, asked
    lat, lon = F.col("at_lat"), F.col("at_lon")
    while True:
        whole = per_degree * 360 <= 1
        near = left.withColumns({"_c": F.explode(geo.neighbour_cells(lat, lon, per_degree)), "_edge": _km_to_edge(lat, lon, per_degree)}).withColumns({"cy": F.col("_c.y"), "cx": F.col("_c.x")})
        celled = places.withColumns({"cy": geo.cell(F.col("lat"), per_degree), "cx": geo.cell(F.col("lon"), per_degree)})
        found = near.join(celled, ["category", "cy", "cx"]).filter(~F.array_contains("used", F.col("place")))
        apart = geo.haversine_km(lat, lon, F.col("lat"), F.col("lon"))
        best = found.groupBy("request").agg(F.min(F.struct(apart.alias("km"), "place", "lat", "lon")).alias("b"), F.first("_edge").alias("_edge"))
        sure = best if whole else best.filter(F.col("b.km") < F.col("_edge"))
        sure = cut(sure.select("request", "b.place", "b.km", "b.lat", "b.lon"))
        answers = sure if answers is None else answers.unionByName(sure)
        if whole:
            return answers
        left = cut(left.join(sure.select("request"), "request", "left_anti"))
        if left.isEmpty():
            return answers
        per_degree /= COARSER


def _cells_for(places: DataFrame) -> int:
    """Cells of a degree by which the category with most points has about ``POINTS_OF_A_CELL`` in each, if they are spread evenly over their box."""
    box = places.groupBy("category").agg(F.countDistinct("lat", "lon").alias("n"), ((F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon"))).alias("area"))
    most = box.agg(F.max(F.when(F.col("area") > 0, F.col("n") / F.col("area"))).alias("x")).first().x
    return int(min(MOST_CELLS, (most or 0.0) / POINTS_OF_A_CELL) ** 0.5)


def plan_stops(requests: DataFrame, places: DataFrame, stops: int, per_degree: int = 10, minutes_at_stop: int = 75) -> DataFrame:
    """(request, stop, place, km, arrive): for each request the nearest unused place of each stop's category, one stop after the other.

    ``requests``: request, lat, lon, start (minutes), categories (array); ``places``: place, category, lat, lon. All requests
    advance together, by joins on category and grid cell; only a stop whose category has no unused place anywhere is left out.
    """
    now = requests.select("request", "categories", F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon"), F.col("start").cast("double").alias("clock"), F.array().cast("array<bigint>").alias("used"))
    # Of places of a category at one point a stop can only take one of the first ``stops``: no more can be used before it.
    copies = Window.partitionBy("category", "lat", "lon").orderBy("place")
    places = places.select("place", "category", "lat", "lon").filter("lat is not null and lon is not null")
    places = cut(places.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= stops).drop("_n"))
    per_degree = max(per_degree, _cells_for(places))
    answers = None
    for k in range(stops):
        asked = now.withColumn("category", F.get("categories", F.lit(k))).filter("category is not null").join(places.select("category").distinct(), "category", "left_semi")
        best = _nearest(asked.select("request", "category", "at_lat", "at_lon", "used"), places, per_degree).join(now.select("request", "clock"), "request")
        arrive = F.ceil((F.col("clock") + geo.travel_minutes(F.col("km"))) / 5) * 5
        stop = cut(best.select("request", F.lit(k + 1).alias("stop"), "place", "km", arrive.cast("long").alias("arrive"), "lat", "lon"))
        answers = stop if answers is None else answers.unionByName(stop)
        moved = now.join(stop.select("request", "place", "arrive", "lat", "lon"), "request", "left")
        now = cut(moved.select(
            "request", "categories", F.coalesce("lat", "at_lat").alias("at_lat"), F.coalesce("lon", "at_lon").alias("at_lon"),
            F.coalesce(F.col("arrive") + minutes_at_stop, "clock").cast("double").alias("clock"), F.when(F.col("place").isNotNull(), F.array_append("used", F.col("place"))).otherwise(F.col("used")).alias("used"),
        ))
    return answers.select("request", "stop", "place", "km", "arrive")
