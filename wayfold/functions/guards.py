"""Checks of what comes from outside, as column expressions: arguments, addresses, points, pictures and booking links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.urls import is_private_ipv4

# Suffixes of hosts that never leave a network, first groups of IPv6 ranges that are not public, and words of links.
LOCAL_SUFFIXES = ("localhost", "local", "internal", "lan", "home", "corp", "test", "example", "invalid")
PRIVATE_V6 = r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:0?db8:|64:ff9b:|::ffff:)"
NO_PHOTO = r"(logo|icon|sprite|avatar|placeholder|favicon|banner)"
MESSENGERS, RESERVATIONS = r"^https?://(wa\.me|t\.me|api\.whatsapp\.com|m\.me)/", r"^https?://([a-z0-9-]+\.)*(sevenrooms|opentable|quandoo|resy|thefork)\.[a-z.]+/"


def level(x: Column) -> Column:
    """A whole number from 1 to 4, else null."""
    number = x.try_cast("double")
    return F.when((number == F.floor(number)) & number.between(1, 4), number.cast("int"))


def ids(x: Column, longest: int = 80) -> Column:
    """Distinct ids of 1 to ``longest`` characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(x, lambda i: F.length(i).between(1, longest))))


def least_price(low: Column, high: Column) -> Column:
    """The least price, dropped if it is above the highest."""
    return F.when(high.isNull() | (low <= high), low)


def may_fetch(url: Column) -> Column:
    """Whether an address is http or https, without credentials, and its host is a public name or address, not a bare number."""
    authority = F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))
    v6 = F.regexp_extract(authority, r"^\[([0-9a-f:.]+)\](:[0-9]+)?$", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r":[0-9]*$", ""), r"\.$", "")
    shared = host.rlike(r"^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.")
    v4 = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    name = host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z][a-z0-9-]*$") & ~F.substring_index(host, ".", -1).isin(*LOCAL_SUFFIXES)
    named = F.when(v4, ~is_private_ipv4(host) & ~shared).otherwise(name)
    return F.coalesce((authority != "") & ~F.contains(authority, F.lit("@")) & F.when(v6 != "", ~v6.rlike(PRIVATE_V6)).otherwise(named), F.lit(False))


def is_placeholder(lat: Column, lon: Column) -> Column:
    """Whether a point is the origin or has at most two decimals in both coordinates."""
    short = lambda x: F.abs(x * 100 - F.round(x * 100)) < 1e-9
    return (short(lat) & short(lon)) | ((lat == 0) & (lon == 0))


def plausible_photo(url: Column, width: Column, height: Column) -> Column:
    """Whether a picture may be a photo: 600 pixels wide or more, sides at most 3 to 1, no vector file, no word of icons in its path."""
    odd = F.lower(url).rlike(NO_PHOTO) | F.lower(url).rlike(r"\.svg([?#]|$)")
    return ~odd & (width >= 600) & (F.greatest(width, height) <= 3 * F.least(width, height))


def booking(links: Column) -> Column:
    """{url, kind} of the best link: messenger, then phone, then reservation, then any site."""
    kind = lambda u: F.when(u.rlike(MESSENGERS), "messenger").when(u.startswith("tel:"), "phone").when(u.rlike(RESERVATIONS), "reservation").when(u.rlike("^https?://"), "site")
    rank = lambda u: F.array_position(F.array(*map(F.lit, ("messenger", "phone", "reservation", "site"))), kind(u))
    known = F.filter(links, lambda u: kind(u).isNotNull())
    ranked = F.array_sort(F.transform(known, lambda u: F.struct(rank(u).alias("rank"), u.alias("url"), kind(u).alias("kind"))))
    return F.get(ranked, F.lit(0))
