"""Tag maps: predicates, aliases, structural categories and lifecycle, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONDITION = re.compile(r"^\s*([a-z0-9_:]+)\s*(!=|!~|~i|~|=)?\s*(.*?)\s*$")


def predicate(tags: Column, text: str) -> Column:
    """Conditions joined by ``&``: key, key=value, key!=value, key~pattern, key!~pattern, key~i pattern. A missing key fails = and ~, satisfies != and !~."""
    holds = F.lit(True)
    for part in text.split("&"):
        key, operator, value = _CONDITION.match(part).groups()
        got = F.element_at(tags, key) if not isinstance(tags, dict) else tags[key]
        test = {
            None: got.isNotNull(),
            "=": F.coalesce(got == value, F.lit(False)),
            "!=": F.coalesce(got != value, F.lit(True)),
            "~": F.coalesce(got.rlike(value or "."), F.lit(False)),
            "~i": F.coalesce(got.rlike("(?i)" + (value or ".")), F.lit(False)),
            "!~": F.coalesce(~got.rlike(value or "."), F.lit(True)),
        }[operator]
        holds = holds & test
    return holds


def alias(tags: Column, *keys: str) -> Column:
    """The first value under any of the keys that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.element_at(tags, k), F.lit("")) for k in keys))


def multi_value(tags: Column, key: str, value: str) -> Column:
    """Whether one of the values of a key that may hold several, separated by ;, is the value."""
    return F.coalesce(F.exists(F.split(F.element_at(tags, key), r"\s*;\s*"), lambda v: v == value), F.lit(False))


def closed(tags: Column, today: Column) -> Column:
    """Closed for good: a lifecycle prefix or flag, an opening day to come or an end day gone (dates compared as text prefixes)."""
    prefix = F.exists(F.map_keys(tags), lambda k: k.rlike("^(disused|abandoned|was|removed|demolished):"))
    later = lambda k: F.coalesce(F.element_at(tags, k) > today, F.lit(False))
    ended = F.coalesce(F.element_at(tags, "end_date") < F.left(today, F.length(F.element_at(tags, "end_date"))), F.lit(False))
    return prefix | F.coalesce(F.element_at(tags, "closed") == "yes", F.lit(False)) | later("opening_date") | ended
