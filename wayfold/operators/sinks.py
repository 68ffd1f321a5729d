"""Writing results: upserts and compaction by key, publication of a whole table, gates, and audit of dropped rows."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the pointers below a published folder, and attempts to add one among other publishers.
POINTERS, MOST_PUBLISHERS = "_pointers", 20


def compact(rows: DataFrame, keys: list[str], success: Column, order: Column) -> DataFrame:
    """One row per key: the last successful one, else the last; aggregated before rows are shuffled."""
    whole = F.struct(*rows.columns)
    rank = F.struct(F.coalesce(success, F.lit(False)).cast("int").alias("s"), order.alias("o"))
    return rows.groupBy(*keys).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the last change of every key in place of its row, new keys added; both have the same columns but for ``order``."""
    last = compact(changes, keys, F.lit(True), F.col(order)).drop(order)
    return current.join(last.select(keys), keys, "left_anti").unionByName(last)


def may_publish(places: int, failed: int, targets: int, least_places: int = 500, most_failed: float = 0.3) -> bool:
    """Whether a build is good enough: enough places, and not too many targets that failed."""
    return places >= least_places and failed <= most_failed * max(targets, 1)


def _files(spark: SparkSession, folder: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTERS}")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _published(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions; a pointer appears by a rename, so that every one is whole."""
    path, files = _files(spark, folder)
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The path of the published version, None before the first: the pointer with the highest number counts."""
    numbers = _published(spark, folder)
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{folder}/{POINTERS}/{numbers[-1]:012d}").first()[0])["path"]


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Adds a pointer to a version: written aside, then renamed to the next number, which fails if another publisher took it, and is tried again."""
    jvm, (path, files) = spark._jvm, _files(spark, folder)
    files.mkdirs(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTERS}/new-{uuid.uuid4().hex}")
    out = files.create(aside)
    out.write(bytearray(json.dumps({"path": version}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    for _ in range(MOST_PUBLISHERS):
        number = max([0, *_published(spark, folder)]) + 1
        try:
            return context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTERS}/{number:012d}"), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
    raise RuntimeError(f"no free pointer in {folder} after {MOST_PUBLISHERS} attempts")


def publish(rows: DataFrame, folder: str, outcomes: DataFrame | None = None, **limits) -> str | None:
    """Writes ``rows`` aside as a new version, then adds a pointer to it; readers see the version before or this one, at any moment.

    Rows without any content never replace a published version, and with ``outcomes`` (ok: whether a target of the build came through)
    the build must pass ``may_publish``, over what was written and how many targets failed: else None is returned and nothing changes.
    """
    spark = rows.sparkSession
    version = f"{folder}/version-{uuid.uuid4().hex}"
    rows.write.parquet(version)
    places = spark.read.schema(rows.schema).parquet(version).count()
    if not places:
        return None
    if outcomes is not None:
        told = outcomes.agg(F.count("*").alias("targets"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed")).first()
        if not may_publish(places, told.failed, told.targets, **limits):
            return None
    _point(spark, folder, version)
    return version


def unfinished(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The targets that a resumed build still has to do."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def audit(before: DataFrame, after: DataFrame, key: str, reason: Column, path: str) -> DataFrame:
    """Writes a tab-separated line (key, reason) for every row that is not in ``after``, and returns the lines."""
    lost = before.join(after.select(key), key, "left_anti").select(F.col(key).cast("string").alias("key"), reason.alias("reason"))
    lost.write.option("sep", "\t").mode("append").csv(path)
    return lost
