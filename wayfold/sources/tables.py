"""The tables of a directory, and the place, catalog and calendar views that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOUTH, WEST, HEIGHT, WIDTH = 24.79, 54.89, 0.57, 0.67
CENTRE = (25.2, 55.27)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of an expensive expression gets at most.
ROWS_OF_A_TASK = 20_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, and over so many tasks that none has much more than ``ROWS_OF_A_TASK``; narrow rows before expensive expressions."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_OF_A_TASK))
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def located(rows: DataFrame, key: str) -> DataFrame:
    """Adds lat and lon, spread over the box by the key."""
    spread = lambda factor, low, size: F.lit(low) + F.pmod(F.col(key) * factor, F.lit(10000)) / 10000.0 * F.lit(size)
    return rows.withColumns({"lat": spread(7919, SOUTH, HEIGHT), "lon": spread(104729, WEST, WIDTH)})


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(table(spark, sf_dir, "supplier"), "s_suppkey")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(table(spark, sf_dir, "customer"), "c_custkey")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_key, cust, day_start, day_end): an interval of 0 to 6 days for each order."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_key"), F.col("o_custkey").alias("cust"), day.alias("day_start"), F.date_add(day, F.pmod("o_orderkey", F.lit(7)).cast("int")).alias("day_end"), F.col("o_totalprice").alias("price")
    )


#: The same views in SQL.
SQL_SUPPLIERS = "SELECT *, 24.79::DOUBLE + (s_suppkey * 7919 % 10000) / 10000.0::DOUBLE * 0.57::DOUBLE AS lat, 54.89::DOUBLE + (s_suppkey * 104729 % 10000) / 10000.0::DOUBLE * 0.67::DOUBLE AS lon FROM supplier"
SQL_CUSTOMERS = "SELECT *, 24.79::DOUBLE + (c_custkey * 7919 % 10000) / 10000.0::DOUBLE * 0.57::DOUBLE AS lat, 54.89::DOUBLE + (c_custkey * 104729 % 10000) / 10000.0::DOUBLE * 0.67::DOUBLE AS lon FROM customer"
SQL_CALENDAR = "SELECT o_orderkey AS event_key, o_custkey AS cust, o_orderdate::DATE AS day_start, (o_orderdate::DATE + (o_orderkey % 7)::INTEGER)::DATE AS day_end, o_totalprice AS price FROM orders"


def sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The haversine distance in SQL."""
    half = lambda a, b: f"sin((radians({b}) - radians({a})) / 2)"
    return f"(12742.0::DOUBLE * asin(sqrt({half(lat1, lat2)} * {half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)} * {half(lon1, lon2)})))"
