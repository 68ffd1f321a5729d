"""Week schedules written as opening-hours text, and read from structured specifications.

A week is 7 lists of spans from Sunday, as of ``wayfold.functions.hours``: null unknown, an empty list closed, ends beyond 1440 after
midnight. All functions are column expressions over one row's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.hours import WEEK_TYPE

#: Two-letter names from Monday, as opening-hours texts count.
NAMES = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
ALL_DAY = 1440
#: Latest end of a span over midnight, and days from which a dated specification counts as the usual week.
LATEST_END, USUAL_DAYS = 720, 300
MOST_CHARS = 255
DAY_FORM = r"^(su(n(days?)?)?|mo(n(days?)?)?|tu(e(s(days?)?)?)?|we(d(nesdays?)?)?|th(u(rs?(days?)?)?)?|fr(i(days?)?)?|sa(t(urdays?)?)?)$"

_SPANS = "array<struct<start:int,end:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def minutes(text: Column) -> Column:
    """Minutes from midnight of ``9:00``, ``09.30``, ``12:00:00+04:00``, ``9 pm``, ``noon``; null if there is no half of the day and no minute."""
    form = r"^(\d{1,2})(?:[:.](\d{2}))?(?::(\d{2}))?\s*([ap])?\.?(?:m\.?)?$"
    clean = F.regexp_replace(F.lower(F.trim(text)), r"(?<=\d)\s*(?:[+-]\d{2}:?\d{2}|z)$", "")
    part = lambda said, k: F.nullif(F.regexp_extract(said, form, k), F.lit(""))

    def of_parts(p: Column) -> Column:
        noon = F.when(p["half"] == "p", 12).otherwise(0)
        hour = F.when(p["half"].isNotNull(), F.when(p["hour"].between(1, 12), p["hour"] % 12 + noon)).when(p["minute"].isNotNull() & (p["hour"] <= 24), p["hour"])
        return F.when(F.coalesce(p["minute"], F.lit(0)) < 60, hour * 60 + F.coalesce(p["minute"], F.lit(0)))

    def read(said: Column) -> Column:
        parts = F.struct(part(said, 1).cast("int").alias("hour"), part(said, 2).cast("int").alias("minute"), part(said, 4).alias("half"))
        worded = F.when(said.isin("noon", "midday", "12 noon", "12noon"), 720).when(said == "midnight", 0)
        return F.coalesce(worded, _let(_let(parts, of_parts), lambda at: F.when(at <= ALL_DAY, at)))

    return _let(clean, read)


def span(opens: Column, closes: Column) -> Column:
    """The span between two minutes; an end at midnight, or a minute before, is the day's end; null for spans of no length or that end past the next noon."""

    def made(s: Column) -> Column:
        wrong = (s["start"] == s["end"]) | (s["start"] == ALL_DAY) | ((s["end"] < s["start"]) & (s["end"] > LATEST_END))
        return F.when(~wrong, _span(s["start"], F.when(s["end"] < s["start"], s["end"] + ALL_DAY).otherwise(s["end"])))

    ends = _let(closes, lambda c: F.when(c.isin(0, ALL_DAY - 1), ALL_DAY).otherwise(c))
    return _let(_span(opens, ends), made)


def union(spans: Column) -> Column:
    """Spans in order, those that touch or overlap as one: a sweep over their starts."""

    def sweep(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_span(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), sweep))


def _clock(minute: Column) -> Column:
    return F.concat_ws(":", F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lpad((minute % 60).cast("string"), 2, "0"))


def _day_text(spans: Column) -> Column:
    """``10:00-14:00,18:00-02:00`` of a day's united spans, ``off`` without any, null if they contradict each other."""
    long = F.exists(spans, lambda s: (s["end"] - s["start"] > ALL_DAY) | ((s["end"] - s["start"] == ALL_DAY) & ((s["start"] != 0) | (F.size(spans) > 1))))
    last, first = F.get(spans, F.size(spans) - 1), F.get(spans, F.lit(0))
    around = (F.size(spans) > 1) & (last["end"] - ALL_DAY > first["start"])
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws("-", _clock(s["start"]), _clock(F.when(s["end"] > ALL_DAY, s["end"] - ALL_DAY).otherwise(s["end"])))), ",")
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, "off").when(~long & ~around, text)


def _runs(days: Column) -> Column:
    """``Mo-We,Fr,Su`` of ascending day numbers; two days in a row stand apart."""
    names = F.array(*map(F.lit, NAMES))
    starts = F.filter(days, lambda d: ~F.array_contains(days, d - 1))
    end = lambda d: F.array_min(F.filter(days, lambda e: (e >= d) & ~F.array_contains(days, e + 1)))
    run = lambda d: F.concat(F.get(names, d), F.when(end(d) == d, "").when(end(d) == d + 1, F.concat(F.lit(","), F.get(names, end(d)))).otherwise(F.concat(F.lit("-"), F.get(names, end(d)))))
    return F.array_join(F.transform(starts, run), ",")


def write_week(week: Column) -> Column:
    """The shortest text of a week: days with equal hours in one rule, rules by their first day; days without a rule are closed.

    Null if nothing is known, if the place never opens, or if a day's spans contradict each other. A week of whole days is ``24/7``.
    """
    day_text = lambda d: F.coalesce(_let(union(d), _day_text), F.lit("bad"))
    from_monday = _let(week.cast(WEEK_TYPE), lambda w: F.when(F.size(w) == 7, F.transform(F.concat(F.slice(w, 2, 6), F.slice(w, 1, 1)), day_text)))

    def rules(texts: Column) -> Column:
        rule = lambda t: F.concat_ws(" ", _let(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: F.get(texts, d) == t), _runs), t)
        said = F.nullif(F.array_join(F.transform(F.filter(F.array_distinct(texts), lambda t: t != "off"), rule), "; "), F.lit(""))
        return F.when(F.array_contains(texts, "bad"), None).when(F.forall(texts, lambda t: t == "00:00-24:00"), "24/7").otherwise(said)

    return _let(from_monday, rules)


def spec_week(rows: Column) -> Column:
    """The usual week of an array of (days, opens, closes, valid_from, valid_to) texts; null if a row can't be read.

    Rows with dates less than ``USUAL_DAYS`` apart are about special days and left out, as are public holidays; without both times, or from
    midnight to midnight, a row says closed; days that no row names are closed.
    """
    usual = F.filter(rows, lambda r: (r["valid_from"].isNull() & r["valid_to"].isNull()) | F.coalesce(F.datediff(F.try_to_date(r["valid_to"]), F.try_to_date(r["valid_from"])) >= USUAL_DAYS, F.lit(False)))
    first_two = F.array(*map(F.lit, ("su", "mo", "tu", "we", "th", "fr", "sa")))
    number = lambda d: F.when(d.rlike(DAY_FORM), F.array_position(first_two, F.substring(d, 1, 2)).cast("int") - 1)

    def read(r: Column) -> Column:
        days = F.transform(F.filter(F.transform(r["days"], F.lower), lambda d: d != "publicholidays"), number)
        return F.struct(days.alias("days"), minutes(r["opens"]).alias("opens"), minutes(r["closes"]).alias("closes"), (r["opens"].isNull() & r["closes"].isNull()).alias("untimed"))

    def spans(r: Column) -> Column:
        off = r["untimed"] | F.coalesce((r["opens"] == 0) & (r["closes"] == 0), F.lit(False))
        return F.struct(r["days"].alias("days"), off.alias("off"), span(r["opens"], r["closes"]).alias("span"))

    def week(told: Column) -> Column:
        wrong = F.exists(told, lambda r: F.exists(r["days"], lambda d: d.isNull()) | (~r["off"] & r["span"].isNull()))
        of = lambda d: F.transform(F.filter(told, lambda r: ~r["off"] & F.array_contains(r["days"], d)), lambda r: r["span"])
        return F.when(~wrong & (F.size(told) > 0), F.transform(F.sequence(F.lit(0), F.lit(6)), of))

    return _let(F.filter(F.transform(F.transform(usual, read), spans), lambda r: F.size(r["days"]) > 0), week)


def valid_hours(text: Column) -> Column:
    """Whether a text is of the form that ``write_week`` writes, with no span of no length."""
    day, time = "(?:Mo|Tu|We|Th|Fr|Sa|Su)", r"(?:[01]\d|2[0-3]):[0-5]\d"
    days, spans = rf"{day}(?:-{day})?(?:,{day}(?:-{day})?)*", rf"{time}-(?:{time}|24:00)"
    rule = rf"(?:{days} )?(?:{spans}(?:,{spans})*|off)"
    return F.coalesce((F.length(text) <= MOST_CHARS) & text.rlike(rf"^(?:24/7|{rule}(?:; {rule})*)$") & ~text.rlike(r"(\d\d:\d\d)-\1"), F.lit(False))
