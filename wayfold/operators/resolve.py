"""Entity resolution: spatial joins on grid cells, stacks of equal points, greedy suppression, components and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.lineage import cut, store


def pairs_within(left: DataFrame, right: DataFrame, km: float, per_degree: int, on: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """Rows (left struct l, right struct r, km) at most ``km`` apart and equal in the columns ``on``; both sides have lat and lon.

    The right side is copied to those of its 3 x 3 cells of 1 / ``per_degree`` degree that are within ``km``, so that the join is an equi-join on
    cells; a cell must be at least ``km`` wide. ``where``: a cheap condition on l and r that is tested before the distance.
    """
    a = left.select(F.struct("*").alias("l"), geo.cell(F.col("lat"), per_degree).alias("cy"), geo.cell(F.col("lon"), per_degree).alias("cx"), *(F.col(c).alias(f"_on_{c}") for c in on))
    b = right.select(F.struct("*").alias("r"), F.explode(geo.cells_within(F.col("lat"), F.col("lon"), km, per_degree)).alias("c"), *(F.col(c).alias(f"_on_{c}") for c in on))
    b = b.select("r", F.col("c.y").alias("cy"), F.col("c.x").alias("cx"), *(f"_on_{c}" for c in on))
    apart = geo.haversine_km(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"))
    met = a.join(b, ["cy", "cx", *(f"_on_{c}" for c in on)])
    met = met if where is None else met.filter(where)
    return met.filter(F.abs(F.col("l.lat") - F.col("r.lat")) <= geo.degrees_north(km)).select("l", "r", apart.alias("km")).filter(F.col("km") <= km)


def _own(key: str, same: tuple[str, ...]) -> Column:
    """The key where one of the columns is null, else null: such rows equal no other."""
    return F.when(F.greatest(*(F.col(c).isNull() for c in same)) if len(same) > 1 else F.col(same[0]).isNull(), F.col(key))


def representatives(rows: DataFrame, key: str, same: tuple[str, ...], *order: Column) -> DataFrame:
    """Rows of the columns ``same`` and key: of rows that are equal in ``same`` the first by ``order``, then key.

    Copies of a place meet the same others, so that pairs need only be made of their representatives. A row in which one of the columns is null
    stands for itself.
    """
    first = F.min_by(key, F.struct(*order, key)) if order else F.min(key)
    return rows.groupBy(*same, _own(key, same).alias("_own")).agg(first.alias("_key")).select(*same, F.col("_key").alias(key))


def with_representatives(rows: DataFrame, key: str, same: tuple[str, ...], first: DataFrame) -> DataFrame:
    """(key, rep): every row with its representative of ``first``, the result of ``representatives``."""
    a = rows.select(F.col(key), *(F.col(c).alias(f"_a_{c}") for c in same), _own(key, same).alias("_a_own"))
    b = first.select(F.col(key).alias("rep"), *(F.col(c).alias(f"_b_{c}") for c in same), _own(key, same).alias("_b_own"))
    whole, alone = a.filter("_a_own is null"), a.filter("_a_own is not null")
    equal = [F.col(f"_a_{c}") == F.col(f"_b_{c}") for c in same]
    return whole.join(b.filter("_b_own is null"), equal).select(key, "rep").unionByName(alone.select(key, F.col(key).alias("rep")))


def first_match(pairs: DataFrame, key: Column, order: Column) -> DataFrame:
    """For each left row the first matching right row in scan order."""
    return pairs.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(order))).filter("_n = 1").drop("_k", "_n")


def stacks(rows: DataFrame, digits: int, least: int, label: str) -> DataFrame:
    """Points shared by at least ``least`` rows, with the most common label and its share; ties go to the smaller label."""
    point = [F.bround(F.col(c), digits).alias(f"p_{c}") for c in ("lat", "lon")]
    counts = rows.select(*point, label).groupBy("p_lat", "p_lon", label).agg(F.count("*").alias("n"))
    return (
        counts.groupBy("p_lat", "p_lon")
        .agg(F.sum("n").alias("places"), F.max_by(label, F.struct("n", (-F.col(label)).alias("l"))).alias("main_label"), F.max("n").alias("main_n"))
        .filter(F.col("places") >= least)
        .withColumn("main_share", F.round(F.col("main_n") / F.col("places"), 6))
    )


def suppress_later(rows: DataFrame, conflicts: DataFrame, key: str) -> DataFrame:
    """Greedy suppression in key order: a row is kept unless an earlier kept row conflicts with it.

    ``conflicts``: (early, late) pairs of keys with early < late. The greedy result is unique and is reached in
    parallel rounds: rows without an undecided or kept earlier conflict are kept, their later conflicts dropped.
    """
    # Keys of undecided rows may be many: they are shuffled, not broadcast through the driver.
    left = cut(conflicts.distinct())
    dropped = None
    while True:
        kept = left.select("early").distinct().join(left.select(F.col("late").alias("early")).distinct().hint("merge"), "early", "left_anti")
        lost = cut(left.join(kept.hint("merge"), "early", "left_semi").select("late").distinct())
        dropped = lost if dropped is None else dropped.unionByName(lost)
        left = cut(left.join(lost.hint("merge"), "late", "left_anti").join(lost.select(F.col("late").alias("early")).hint("merge"), "early", "left_anti").select("early", "late"))
        if left.isEmpty():
            return rows.join(dropped.distinct().hint("merge"), rows[key] == F.col("late"), "left_anti")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component: all nodes of a label take the smallest label around any of them, then jump to their label's label."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = store(nodes.select("node", F.col("node").alias("label")))
    while True:
        # Labels are as many as nodes: they are shuffled, not broadcast through the driver.
        around = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        beside = labels.join(around.hint("merge"), labels["node"] == around["a"], "left").groupBy("label").agg(F.least("label", F.min("low")).alias("next"))
        hooked = labels.join(beside.hint("merge"), "label").select("node", "label", "next")
        up = hooked.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        moved = store(hooked.join(up.hint("merge"), "next").select("node", "label", F.least("next", "jump").alias("next")))
        changed = moved.filter("next <> label").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def merge_fields(rows: DataFrame, group: str, order: list[Column], fields: list[str]) -> DataFrame:
    """One row per group: each field's first value that is not null, in the order given."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = [F.first(f, ignorenulls=True).over(w).alias(f) for f in fields]
    return rows.select(group, F.count("*").over(Window.partitionBy(group)).alias("rows"), *filled).distinct()
