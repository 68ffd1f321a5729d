"""Adaptive cells: a box is cut in four as long as a cell has too many points, down to a depth.

Points are counted once, at the deepest cells; counts of all coarser cells are sums of these, so that all levels come from one
aggregation and no level waits for the one above. A cell is kept if every cell around it was cut and it was not: because it has fewer
points than the cap, or because it is at the depth, in which case it may be ``full``.

Cells are named by their quarters from the whole box down: 0 south-west, 1 south-east, 2 north-west, 3 north-east; the box itself
is the empty name. A point on an inner edge is north or east of it; points on the outer edges are inside, points beyond and null
coordinates are in no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.lineage import broadcast_if_small, cut

Box = tuple[float, float, float, float]


_EDGES = ("south", "west", "north", "east")


def _quarter(a: Column, north: Column, east: Column) -> list[Column]:
    """Edges of the quarter of a box (a struct of edges) on its northern and eastern side or not; a box is cut in the middle of its edges."""
    y, x = (a["south"] + a["north"]) / 2, (a["west"] + a["east"]) / 2
    return [
        F.when(north, y).otherwise(a["south"]).alias("south"), F.when(east, x).otherwise(a["west"]).alias("west"),
        F.when(north, a["north"]).otherwise(y).alias("north"), F.when(east, a["east"]).otherwise(x).alias("east"),
    ]


def _whole(box: Box) -> list[Column]:
    return [F.lit(float(at)).alias(name) for name, at in zip(_EDGES, box)]


def cell_name(lat: Column, lon: Column, box: Box, depth: int) -> Column:
    """Name of the point's cell at a depth; null outside of the box (south, west, north, east).

    Every cut compares with the middle of the edges so far, as the cells' edges are told: an edge by another formula may be a last digit off.
    """
    south, west, north, east = box

    def cut_once(a: Column, _: Column) -> Column:
        up, right = lat >= (a["south"] + a["north"]) / 2, lon >= (a["west"] + a["east"]) / 2
        return F.struct(*_quarter(a, up, right), F.concat(a["name"], (up.cast("int") * 2 + right.cast("int")).cast("string")).alias("name"))

    name = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(*_whole(box), F.lit("").alias("name")), cut_once, lambda a: a["name"]) if depth else F.lit("")
    return F.when(lat.between(south, north) & lon.between(west, east), name)


def _edges(cell: Column, box: Box) -> Column:
    """A cell's edges: the box, cut as its name says."""
    return F.aggregate(F.filter(F.split(cell, ""), lambda q: q != ""), F.struct(*_whole(box)), lambda a, q: F.struct(*_quarter(a, q.isin("2", "3"), q.isin("1", "3"))))


def quad_cells(points: DataFrame, box: Box, cap: int, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The kept cells of each group ``by``: cell, level, points, full, south, west, north, east. ``points`` have lat and lon."""
    deepest = points.withColumn("cell", cell_name(F.col("lat"), F.col("lon"), box, depth)).filter("cell is not null").groupBy(*by, "cell").agg(F.count("*").alias("n"))
    every = deepest.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), F.col("cell").alias("c")).select(*by, "n", "level", F.expr("substring(c, 1, level)").alias("cell"))
    counts = cut(every.groupBy(*by, "level", "cell").agg(F.sum("n").alias("points")))
    # A cut cell has four quarters, with points or without.
    cut_cells = counts.filter((F.col("points") >= cap) & (F.col("level") < depth))
    quarters = cut_cells.select(*by, (F.col("level") + 1).alias("level"), F.explode(F.transform(F.array(*map(F.lit, "0123")), lambda q: F.concat("cell", q))).alias("cell"))
    whole = counts.select(*by).distinct().select(*by, F.lit(0).alias("level"), F.lit("").alias("cell")) if by else counts.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("cell"))
    names = [*by, "level", "cell"]
    open_ = quarters.unionByName(whole).join(counts, names, "left").select(*names, F.coalesce("points", F.lit(0)).alias("points"))
    kept = open_.join(cut_cells.select(*names), names, "left_anti")
    told = kept.withColumn("_edges", _edges(F.col("cell"), box))
    return told.select(*by, "cell", "level", "points", (F.col("points") >= cap).alias("full"), *(F.round(f"_edges.{e}", 9).alias(e) for e in _EDGES))


def in_cells(points: DataFrame, cells: DataFrame, box: Box, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with the kept ``cell`` they are in: an equi-join on the names of all levels that kept cells have; points in none are left out."""
    levels = F.array_sort(F.collect_set("level"))
    known = [int(x) for x in cells.agg(levels.alias("x")).first().x]
    named = points.withColumn("_deep", cell_name(F.col("lat"), F.col("lon"), box, depth)).filter("_deep is not null")
    tried = named.withColumn("cell", F.explode(F.array(*(F.substring("_deep", 1, k) for k in known)) if known else F.array().cast("array<string>"))).drop("_deep")
    return tried.join(broadcast_if_small(cells.select(*by, "cell")), [*by, "cell"])
