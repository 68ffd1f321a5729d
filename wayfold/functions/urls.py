"""URL parts as column expressions; a bad URL gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|yclid)"


def host(url: Column) -> Column:
    got = F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(got, r"^www\.", ""), F.lit(""))


def registrable(host_: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host_, ".", -2)


def own_site(url: Column) -> Column:
    """The URL without tracking parameters, fragment and final slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    fewer = F.regexp_replace(bare, rf"([?&]){TRACKING}=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(fewer, "&+", "&"), r"\?&", "?"), "[?&/]+$", "")


def is_private_ipv4(host_: Column) -> Column:
    """Loopback, link-local and private ranges, by the number of the address."""
    parts = F.transform(F.split(host_, r"\."), lambda p: p.try_cast("int"))
    valid = host_.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.between(0, 255))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    ranges = ((0, 8), (10, 8), (127, 8), (169 * 256 + 254, 16), (172 * 16 + 1, 12), (192 * 256 + 168, 16))
    inside = F.lit(False)
    for prefix, bits in ranges:
        inside = inside | (F.floor(number / F.lit(2 ** (32 - bits))) == prefix)
    return F.when(valid, inside).otherwise(False)
