"""Per-key folds in event order: learning, rate limits, breakers, caches and sessions. Batch forms of what a service keeps as state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def learn(events: DataFrame, key: str, order: list[str], step: Column) -> DataFrame:
    """Adds up each key's steps in order, clamped to 5 either way and rounded to 2 decimals after every event."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, step.alias("step"))))
    fold = F.aggregate(ordered, F.lit(0.0), lambda a, e: F.round(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), a + e["step"])), 2))
    return events.groupBy(key).agg(fold.alias("taste"), F.count("*").alias("events"))


def rate_limit(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """(key, accepted, rejected): a hit is accepted if fewer than ``most`` accepted hits lie in the window before it; rejected hits are not recorded."""
    ordered = F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o"))))
    start = F.struct(F.array().cast("array<bigint>").alias("hits"), F.lit(0).cast("long").alias("ok"), F.lit(0).cast("long").alias("no"))

    def hit(a: Column, e: Column) -> Column:
        live = F.filter(a["hits"], lambda t: t > e["t"] - seconds)
        free = F.size(live) < most
        return F.struct(F.when(free, F.array_append(live, e["t"])).otherwise(live).alias("hits"), (a["ok"] + free.cast("long")).alias("ok"), (a["no"] + (~free).cast("long")).alias("no"))

    return events.groupBy(key).agg(F.aggregate(ordered, start, hit).alias("s")).select(key, F.col("s.ok").alias("accepted"), F.col("s.no").alias("rejected"))


def breaker(calls: DataFrame, key: str, ts: str, order: str, failed: Column, failures: int, cooldown: int) -> DataFrame:
    """(key, calls_made, short_circuited, opened): opens after consecutive failures; after the cooldown one probe is let through."""
    ordered = F.array_sort(F.collect_list(F.struct(F.unix_seconds(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o"), failed.alias("f"))))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("bad"), F.lit(None).cast("long").alias("since"), zero.alias("made"), zero.alias("cut"), zero.alias("opened"))

    def call(a: Column, e: Column) -> Column:
        blocked = a["since"].isNotNull() & (e["t"] < a["since"] + cooldown)
        bad = F.when(e["f"], a["bad"] + 1).otherwise(zero)
        opens = e["f"] & (bad >= failures)
        tried = F.struct(bad.alias("bad"), F.when(opens, e["t"]).alias("since"), (a["made"] + 1).alias("made"), a["cut"].alias("cut"), (a["opened"] + opens.cast("long")).alias("opened"))
        skipped = F.struct(a["bad"].alias("bad"), a["since"].alias("since"), a["made"].alias("made"), (a["cut"] + 1).alias("cut"), a["opened"].alias("opened"))
        return F.when(blocked, skipped).otherwise(tried)

    return calls.groupBy(key).agg(F.aggregate(ordered, start, call).alias("s")).select(key, F.col("s.made").alias("calls_made"), F.col("s.cut").alias("short_circuited"), F.col("s.opened").alias("opened"))


def sessions(events: DataFrame, key: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """Runs of a key's events with gaps of at most ``gap_seconds``, between times rounded to seconds, halves to the even one."""
    w = Window.partitionBy(key).orderBy(ts, order)
    t = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("long")
    new = F.when(t - F.lag(t).over(w) <= gap_seconds, 0).otherwise(1)
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def cached_answers(events: DataFrame, key: str, ts: str, order: str, success: Column, fresh: int, stale: int) -> DataFrame:
    """Each event with the state of the key's last success before it: fresh, stale or miss by its age in seconds."""
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    age = t - F.max(F.when(success, t)).over(w)
    state = F.when(age <= fresh, "fresh").when(age <= stale, "stale").otherwise("miss")
    return events.withColumns({"age": age, "state": state})


def trim_conversations(turns: DataFrame, key: str, turn: str, role: Column, most: int) -> DataFrame:
    """At most the last ``most`` turns of a conversation, cut so that they begin with a user's turn."""
    back = Window.partitionBy(key).orderBy(F.desc(turn))
    recent = turns.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= most).drop("_r")
    first_user = F.min(F.when(role == "user", F.col(turn))).over(Window.partitionBy(key))
    return recent.withColumn("_f", first_user).filter(F.col(turn) >= F.col("_f")).drop("_f")


def last_known(rows: DataFrame, key: str, ts: str, order: str, value: Column, seconds: int) -> DataFrame:
    """Each row with the key's last value that is not null, up to itself, if it is at most ``seconds`` old."""
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    last = F.last(F.when(value.isNotNull(), F.struct(value.alias("v"), t.alias("t"))), ignorenulls=True).over(w)
    return rows.withColumn("_l", last).withColumn("known", F.when(t - F.col("_l.t") <= seconds, F.col("_l.v"))).drop("_l")


def prune_by_budget(rows: DataFrame, group: str, newest: list[Column], size: Column, most_rows: int, most_size: float) -> DataFrame:
    """What a bounded cache keeps: the newest rows while their number and summed size fit."""
    w = Window.partitionBy(group).orderBy(*newest)
    kept = rows.withColumns({"_n": F.row_number().over(w), "_s": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return kept.filter((F.col("_n") <= most_rows) & (F.col("_s") <= most_size)).drop("_n", "_s")
