"""Dates, seasons, clocks and week schedules as column expressions. A week is 7 lists of {start, end} minutes from Sunday; null means unknown, [] closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(day: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(day) - 1


def weekend_start(day: Column) -> Column:
    """Saturday of the weekend that is on or comes next; on a Sunday, that day."""
    return F.when(weekday(day) == 0, day).when(weekday(day) == 6, day).otherwise(F.next_day(day, "Sat"))


def weekend_end(day: Column) -> Column:
    return F.when(weekday(day) == 0, day).otherwise(F.next_day(day, "Sun"))


def overlaps(start: Column, end: Column, since: Column, until: Column) -> Column:
    return (start <= until) & (end >= since)


def in_season(day: Column, first: int, last: int) -> Column:
    """Whether the day's month and day, as MMDD, are in a season that may wrap the new year."""
    now = F.month(day) * 100 + F.dayofmonth(day)
    return now.between(first, last) if first <= last else (now >= first) | (now <= last)


def clock_minutes(text: Column) -> Column:
    """Minutes of the first time of day in a text: 7pm, 7:30 pm, 19:05, noon or midnight; null if there is none."""
    low = F.lower(text)
    of = lambda pattern, k: F.nullif(F.regexp_extract(low, pattern, k), F.lit("")).try_cast("int")
    half = r"(^|[^0-9:])(1[0-2]|0?[1-9])(:([0-5][0-9]))? ?(am|pm)([^a-z]|$)"
    full = r"(^|[^0-9:])([01]?[0-9]|2[0-3]):([0-5][0-9])([^0-9]|$)"
    twelve = of(half, 2) % 12 * 60 + F.coalesce(of(half, 4), F.lit(0)) + F.when(F.regexp_extract(low, half, 5) == "pm", 720).otherwise(0)
    return F.coalesce(twelve, of(full, 2) * 60 + of(full, 3), F.when(low.rlike("(^|[^a-z])noon([^a-z]|$)"), 720), F.when(low.rlike("(^|[^a-z])midnight([^a-z]|$)"), 0))


def open_at(week: Column, day: Column, minute: Column) -> Column:
    """Whether a schedule is open at a minute of a weekday, counting what spills over from the day before; null if both days are unknown."""
    today, before = F.get(week, day), F.get(week, F.pmod(day + 6, F.lit(7)))
    now = F.exists(today, lambda s: (s["start"] <= minute) & (minute < s["end"]))
    spill = F.exists(before, lambda s: (s["start"] <= minute + 1440) & (minute + 1440 < s["end"]))
    return F.when(today.isNull() & before.isNull(), F.lit(None)).otherwise(F.coalesce(now, F.lit(False)) | F.coalesce(spill, F.lit(False)))


def city_time(moment: Column, hours: int) -> Column:
    """A moment as the city's clock shows it, ``hours`` ahead of UTC in a session in UTC."""
    return F.timestamp_seconds(F.unix_seconds(moment) + hours * 3600)


def iso_local(text: Column, hours: int) -> Column:
    """An ISO text as the city writes it: a day as it is, a time without zone as it is, one with a zone moved to the city's; null if it is none."""
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})$", 1)
    naive = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(:\d{2}(\.\d+)?)?$", 1)
    zoned = F.when(text.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.when(day != "", day).when(naive != "", F.replace(naive, F.lit("T"), F.lit(" "))).otherwise(F.date_format(city_time(zoned, hours), "yyyy-MM-dd HH:mm"))


# The first three letters of the months.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def human_date(text: Column) -> Column:
    """The first date in a text: "10 October 2026", "3 Oct 2026" or "Oct 3, 2026"; null if there is none or the day does not exist."""
    low, names = F.lower(text), "(" + "|".join(MONTHS) + ")[a-z]*"
    forms = ((rf"(?:^|[^0-9])([0-9]{{1,2}})\s+{names}\.?,?\s+([0-9]{{4}})", (1, 2, 3)), (rf"{names}\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})", (2, 1, 3)))
    found = []
    for pattern, (d, m, y) in forms:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, pattern, m))
        iso = F.concat_ws("-", F.regexp_extract(low, pattern, y), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, pattern, d), 2, "0"))
        found.append(iso.try_cast("date"))
    return F.coalesce(*found)


def asked_window(text: Column, today: Column, days: int = 30) -> Column:
    """{since, until} that a request asks for, from its words; without any, the next ``days`` days."""
    low = F.lower(text)
    says = lambda words: low.rlike(rf"(^|[^a-z])({words})([^a-z]|$)")
    span = lambda a, b: F.struct(a.cast("date").alias("since"), b.cast("date").alias("until"))
    sunday = weekend_end(today)
    first_next = F.date_add(F.last_day(today), 1)
    ahead = F.regexp_extract(low, r"(?:^|[^a-z])in ([0-9]{1,3}) days?([^a-z]|$)", 1).try_cast("int")
    cases = [(says("tonight|today"), span(today, today)), (says("tomorrow"), span(F.date_add(today, 1), F.date_add(today, 1)))]
    cases += [(says("next weekend"), span(F.date_add(weekend_start(today), 7), F.date_add(sunday, 7))), (says("weekend"), span(weekend_start(today), sunday))]
    cases += [(says("next week"), span(F.date_add(sunday, 1), F.date_add(sunday, 7))), (says("this week"), span(today, sunday))]
    cases += [(says("next month"), span(first_next, F.last_day(first_next))), (says("this month"), span(today, F.last_day(today)))]
    cases += [(ahead.isNotNull(), span(F.date_add(today, ahead), F.date_add(today, ahead)))]
    for k, name in enumerate(("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")):
        day = F.date_add(today, F.pmod(F.lit(k) - weekday(today), F.lit(7)))
        cases.append((says(name), span(day, day)))
    window = F.when(*cases[0])
    for condition, value in cases[1:]:
        window = window.when(condition, value)
    return window.otherwise(span(today, F.date_add(today, days)))
