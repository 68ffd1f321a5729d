"""Text normalisers, tokens, similarity and hashes as column expressions. Similar is not equal: each normaliser is its own function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Articles and linking words that carry no meaning in a name.
FILLERS = ("a", "an", "and", "at", "for", "in", "near", "of", "on", "or", "the", "to", "with")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normal_search(x: Column) -> Column:
    """Lower case; markup removed; only letters of Latin and Cyrillic, digits, + and - stay."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), "<[^>]*>", " "), "ё", "е"), "[^a-zа-я0-9+-]", " "))


def normal_rank(x: Column) -> Column:
    """As for search, without + and -."""
    return squeeze(F.regexp_replace(normal_search(x), "[+-]", " "))


def tokens(x: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """Words of a normalised text without fillers, repeats kept."""
    return F.filter(F.split(x, " "), lambda w: (w != "") & ~w.isin(*fillers))


def stem(word: Column) -> Column:
    """Drops ing, ers, er, es or s from words of 6 letters or more if 5 or more are left."""
    cut = F.regexp_replace(word, "(ing|ers|er|es|s)$", "")
    return F.when((F.length(word) >= 6) & (F.length(cut) >= 5), cut).otherwise(word)


def clamp_words(x: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word, with an ellipsis."""
    cut = F.regexp_replace(F.substring(x, 1, most), r"\s+\S*$", "")
    return F.when(F.length(x) <= most, x).otherwise(F.concat(cut, F.lit("…")))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.9 if one contains the other, else 0.8 times the share of common words among the shorter name's."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(ta, tb)) / F.least(F.size(ta), F.size(tb))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(shared * 0.8)


def _codes(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("long")), lambda c: c > 0)


def hash31(x: Column) -> Column:
    """The 31-polynomial hash modulo 2^32 of the characters' code points."""
    return F.aggregate(_codes(x), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296)


def fnv1a(x: Column) -> Column:
    """FNV-1a over the characters' code points, modulo 2^32."""
    return F.aggregate(_codes(x), F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c) * 16777619 % 4294967296)


# Latin letters with marks and the letters without them.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśşšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorssstuuuzzz"


def fold(x: Column) -> Column:
    """For comparing names: lower case, marks of Latin letters dropped, & as and, only Latin letters and digits."""
    return squeeze(F.regexp_replace(F.replace(F.translate(F.lower(x), ACCENTED, PLAIN), F.lit("&"), F.lit(" and ")), "[^a-z0-9]", " "))


def bare_name(folded: Column, city: str) -> Column:
    """A folded name without a leading article and the city at its end."""
    return F.regexp_replace(F.regexp_replace(folded, "^(the|a|an) ", ""), rf" {city}$", "")


def distinctive(folded: Column, common: tuple[str, ...]) -> Column:
    """The distinct words of a folded name that are neither fillers nor common ones."""
    return F.array_distinct(F.filter(tokens(folded), lambda w: ~w.isin(*common)))
