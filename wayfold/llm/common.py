"""Small helpers that the operators share: tables, cut lineage, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and text contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table whose size has been counted is broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a folder of the warehouse, which executors share too."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves that it has at most ``rows`` rows, else as it is.

    ``df`` should be cheap to count: a checkpointed or aggregated table.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tight(df: DataFrame, rows: int, rows_per_part: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, of at most ``rows`` rows, in as many partitions as these need, or as it has if that is fewer.

    A bounded table in one partition needs no exchange to be grouped or joined, and a small one leaves few files behind.
    """
    return df.coalesce(rows // rows_per_part + 1)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def store(df: DataFrame) -> DataFrame:
    """Like ``cut`` for wide or long tables: written as compressed Parquet below the same folder and read again."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
