"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history: dated entries (domain, day, action), where the action ``remove`` takes the
domain off the list. Of several entries for a domain on a day the one with the largest entry id
counts. Entries become validity intervals [valid_from, valid_to); a capture is judged by the
interval that holds its host, or else the nearest parent domain, on the day it was fetched.

Captures are first reduced to the distinct (host, day) pairs and those to the (domain, day) pairs
to look up, both with map-side aggregation; the as-of join is one window over entries and lookups
of a domain, ordered by day. It sees at most two rows for each domain and day, however many captures
a domain has. The verdicts of listed pairs are broadcast to the captures, which then stay where they are, if a count
shows them to be few (``BROADCAST_VERDICTS``); else each is copied ``SALTS`` times and joined on (host, day, salt), so that
the captures of a hot host on one day are dealt over as many tasks.

Defined cases: a null url, or one without a host, is not listed; a null fetch day is judged as not
listed; entries with a null domain or day are never active; empty lists and tables work; repeated
captures are all returned; an IPv4 address has no parent domains; very long URLs are parsed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut

#: Listed pairs of host and day up to which they are broadcast, and copies of each beyond it.
BROADCAST_VERDICTS = 200_000
SALTS = 16


def url_host(url: str) -> Column:
    """Lowercase host of an absolute URL, without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$", ""))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def domain_chain(host: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(parents)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, valid_from, valid_to) from (domain, day, action, entry_id); valid_to is exclusive, null while open."""
    daily = entries.filter("domain is not null and day is not null").groupBy("domain", "day").agg(F.max_by("action", "entry_id").alias("action"))
    following = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    return daily.select("domain", "action", F.col("day").alias("valid_from"), following.alias("valid_to"))


def judge_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """All rows and columns of ``captures`` inside the struct ``capture``, with host, listed_domain, action, valid_from, valid_to, blocked."""
    rows = captures.select(F.struct("*").alias("capture"), url_host(url_col).alias("host"), F.col(day_col).alias("day"))
    pairs = rows.filter("host is not null and day is not null").select("host", "day").distinct()
    chains = pairs.select("host", "day", F.posexplode(domain_chain(F.col("host"))).alias("steps_up", "domain"))
    lookups = chains.select("domain", "day").distinct()

    entry = F.struct("action", "valid_from", "valid_to")
    timeline = (
        validity_intervals(entries)
        .select("domain", F.col("valid_from").alias("day"), entry.alias("entry"), F.lit(0).alias("is_lookup"))
        .unionByName(lookups.withColumn("is_lookup", F.lit(1)), allowMissingColumns=True)
    )
    so_far = Window.partitionBy("domain").orderBy("day", "is_lookup").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = (
        timeline.withColumn("entry", F.last("entry", ignorenulls=True).over(so_far))
        .filter("is_lookup = 1 and entry.action <> 'remove'")
        .select("domain", "day", "entry")
    )
    nearest = (
        chains.join(active, ["domain", "day"])
        .groupBy("host", "day")
        .agg(F.min_by(F.struct("domain", "entry"), "steps_up").alias("hit"))
    )
    listed, on = cut(nearest), ["host", "day"]
    if listed.limit(BROADCAST_VERDICTS + 1).count() <= BROADCAST_VERDICTS:
        listed = F.broadcast(listed)
    else:
        listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows, on = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), [*on, "salt"]
    verdict = F.coalesce(F.col("hit.entry.action") == "block", F.lit(False))
    return rows.join(listed, on, "left").select(
        "capture",
        "host",
        F.col("hit.domain").alias("listed_domain"),
        F.col("hit.entry.action").alias("action"),
        F.col("hit.entry.valid_from").alias("valid_from"),
        F.col("hit.entry.valid_to").alias("valid_to"),
        verdict.alias("blocked"),
    )
