"""Opening-hours texts to week schedules: 7 lists of [start, end] minutes from Sunday, end beyond 1440 after midnight.

A text is read as a stream of marks: days, sets of days, times, dashes, "closed", "all day", holidays and separators; other
words are skipped. A rule is a run of marks with at most one block of days: it ends at a semicolon, or where days or a holiday
follow a time or "closed". So "Sa,Su 11:00-23:00" is one rule, and "Mo-Fr 10:00-22:00, Sa,Su 11:00-23:00" are two. Later rules
override the days of earlier ones; a rule about holidays that names no weekday is left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Day names and Russian abbreviations from Sunday, as in CLDR; Russian names stand without their ending, as they are
# inflected. Words of states and sets of days are those that listings of both languages use.
ENGLISH = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
RUSSIAN = (("вс", "воскресень"), ("пн", "понедельник"), ("вт", "вторник"), ("ср", "сред"), ("чт", "четверг"), ("пт", "пятниц"), ("сб", "суббот"))
WORDS = (
    ("always", r"24\s*/\s*7|(?:open )?24 ?(?:hours|h)|around the clock|круглосуточно|24 часа"),
    ("every", r"daily|every ?day|all week|ежедневно|каждый день|без выходных"),
    ("work", r"weekdays|working days|будни|по будням|рабочие дни"),
    ("rest", r"weekends?|по выходным|выходные"),
    ("off", r"off|closed|закрыто|выходной|не работает"),
    ("holiday", r"ph|sh|easter|public holidays?|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|праздни[а-я]*"),
    ("clock", r"noon|midnight|полдень|полночь"),
    ("dash", r"to|till|until|до"),
)


def _day_words(day: int) -> str:
    """An English name or its first two letters or more, with a plural s; a Russian abbreviation, or a stem with any ending of up to three letters."""
    name, (short, stem) = ENGLISH[day], RUSSIAN[day]
    return "|".join([*(name[:n] for n in range(len(name), 1, -1)), f"{name}s", short, rf"{stem}[а-я]{{0,3}}"])


WEEK_TYPE = "array<array<struct<start:int,end:int>>>"
_MARK = re.compile(
    "|".join(rf"(?P<{kind}>(?<![^\W\d_])(?:{words})(?![^\W\d_]))" for kind, words in (*((f"day{d}", _day_words(d)) for d in range(7)), *WORDS))
    + r"|(?P<time>\d{1,2})(?:[:.](?P<minute>\d{2}))?\s*(?P<half>[ap]\.?m\b\.?)?|(?P<line>-)|(?P<end>;)|(?P<comma>,)"
)
_EVERY, _WORK, _REST = tuple(range(7)), (1, 2, 3, 4, 5), (6, 0)


@dataclass
class _Rule:
    days: list[int] = field(default_factory=list)
    spans: list[dict[str, int]] = field(default_factory=list)
    times: list[tuple[int, int, str]] = field(default_factory=list)  # hour, minute, half of the times not yet paired
    off: bool = False
    always: bool = False
    holiday: bool = False

    @property
    def done(self) -> bool:
        return bool(self.spans) or self.off or self.always


def _marks(text: str) -> list[tuple[str, object]]:
    """(kind, value) of the marks in order; a day's value is its number, a time's (hour, minute, half)."""
    found: list[tuple[str, object]] = []
    for m in _MARK.finditer(re.sub("[–—−]", "-", text.lower().replace("ё", "е"))):
        kind = m.lastgroup if m["time"] is None else "time"
        if kind == "time":
            found.append(("time", (int(m["time"]), int(m["minute"] or 0), (m["half"] or "")[:1], m["minute"] is not None)))
        elif kind == "clock":
            found.append(("time", ((12, 0, "", True) if m[0] in ("noon", "полдень") else (0, 0, "", True))))
        elif kind.startswith("day"):
            found.append(("day", int(kind[3:])))
        else:
            found.append(("dash" if kind == "line" else kind, None))
    return found


def _minutes(hour: int, minute: int, half: str) -> int | None:
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half == "p")
    return hour * 60 + minute if hour * 60 + minute <= 1440 and minute < 60 else None


def _span(first: tuple, last: tuple) -> dict[str, int] | None:
    """The span between two times; a first time without am or pm is in the last one's half of the day if it then comes before it."""
    end = _minutes(*last[:3])
    start = _minutes(*first[:3])
    if last[2] and not first[2] and end is not None:
        same = _minutes(first[0], first[1], last[2])
        other = _minutes(first[0], first[1], "a" if last[2] == "p" else "p")
        start = same if same is not None and same < end else other
    if start is None or end is None:
        return None
    return {"start": start, "end": end if end > start else end + 1440}


def _rules(text: str) -> list[_Rule]:
    rules, rule = [], _Rule()
    marks = _marks(text)
    k = 0
    while k < len(marks):
        kind, value = marks[k]
        if kind == "end" or kind in ("day", "every", "work", "rest", "holiday") and rule.done:
            rules.append(rule)
            rule = _Rule()
        follows = [m[0] for m in marks[k + 1 : k + 3]]
        if kind == "day":
            if follows == ["dash", "day"]:
                last = marks[k + 2][1]
                rule.days += [(value + step) % 7 for step in range((last - value) % 7 + 1)]
                k += 2
            else:
                rule.days.append(value)
        elif kind in ("every", "work", "rest"):
            rule.days += {"every": _EVERY, "work": _WORK, "rest": _REST}[kind]
        elif kind == "time" and follows == ["dash", "time"]:
            if span := _span(value, marks[k + 2][1]):
                rule.spans.append(span)
            k += 2
        elif kind in ("off", "always", "holiday"):
            setattr(rule, kind, True)
        k += 1
    return [*rules, rule]


def parse_week(text: str | None) -> list[list[dict[str, int]] | None] | None:
    """None if nothing is understood. Later rules override days of earlier ones; days that no rule names are closed if any rule names days."""
    week: list[list[dict[str, int]] | None] = [None] * 7
    named = understood = False
    for rule in _rules(text or ""):
        if not rule.done or rule.holiday and not rule.days:
            continue
        understood = True
        named |= bool(rule.days)
        spans = rule.spans or ([{"start": 0, "end": 1440}] if rule.always else [])
        for day in rule.days or _EVERY:
            week[day] = spans
    if not understood:
        return None
    return [(d if d is not None else []) if named else d for d in week]


def week_of(text: Column) -> Column:
    """The schedule of an opening-hours text; distinct texts are few, parse them before joining back to many rows."""

    @F.pandas_udf(WEEK_TYPE)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(parse_week)

    return parse(text)


def is_always(week: Column) -> Column:
    """Whether every day is open from midnight to midnight."""
    return F.forall(week, lambda d: d.isNotNull() & (F.size(d) == 1) & F.exists(d, lambda s: (s["start"] == 0) & (s["end"] == 1440)))


def next_opening(week: Column, day: Column, minute: Column) -> Column:
    """Minutes from the day's midnight to the next opening after ``minute`` within 7 days; null if there is none."""
    of = lambda i: F.filter(F.get(week, F.pmod(day + i, F.lit(7))), lambda s: (i > 0) | (s["start"] > minute))
    starts = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.transform(F.coalesce(of(i), F.array().cast("array<struct<start:int,end:int>>")), lambda s: s["start"] + i * 1440))
    return F.array_min(F.flatten(starts))


def closing(week: Column, day: Column, minute: Column) -> Column:
    """Minute of the day at which the span that is open now ends (beyond 1440 after midnight); null if closed."""
    today = F.filter(F.get(week, day), lambda s: (s["start"] <= minute) & (minute < s["end"]))
    spill = F.filter(F.get(week, F.pmod(day + 6, F.lit(7))), lambda s: (s["end"] > 1440) & (minute < s["end"] - 1440))
    return F.coalesce(F.get(spill, F.lit(0))["end"] - 1440, F.get(today, F.lit(0))["end"])


def clock(minute: Column) -> Column:
    inside = F.pmod(minute, F.lit(1440))
    return F.concat_ws(":", F.lpad(F.floor(inside / 60).cast("string"), 2, "0"), F.lpad((inside % 60).cast("string"), 2, "0"))


def sane(text: Column, week: Column, eatery: Column) -> Column:
    """False for windows of no length, and for eateries that open at midnight only, or close by 12:30 all week: slips of the pen."""
    no_length = text.rlike(r"(?<![0-9])(\d{1,2}[:.]\d{2})\s*[-–—]\s*\1(?![0-9])")
    open_days = F.filter(week, lambda d: d.isNotNull() & (F.size(d) > 0))
    at_midnight = F.exists(open_days, lambda d: (F.size(d) == 1) & F.exists(d, lambda s: (s["start"] == 0) & (s["end"] < 900)))
    early = (F.size(open_days) > 0) & F.forall(F.flatten(open_days), lambda s: s["end"] <= 750)
    return ~(F.coalesce(no_length, F.lit(False)) | F.coalesce(eatery & (at_midnight | early), F.lit(False)))


def summary(week: Column, day: Column, minute: Column) -> Column:
    """What a card says about the hours now; null if they are unknown.

    The sentence is a state and its detail. Open: the span of today that holds the minute, or else the end of yesterday's that does.
    Closed: the next opening with its day, if there is one within a week.
    """
    today = F.get(week, day)
    span = F.get(F.filter(today, lambda s: (s["start"] <= minute) & (minute < s["end"])), F.lit(0))
    opens = next_opening(week, day, minute)
    ahead = F.floor(opens / 1440).cast("int")
    name = F.get(F.array(*(F.lit(n[:3].capitalize()) for n in ENGLISH)), F.pmod(day + ahead, F.lit(7)))
    when = F.concat_ws(" ", F.when(ahead == 1, "tomorrow").when(ahead > 1, name), clock(opens))
    whole_day = (span["start"] == 0) & (span["end"] >= 1440)
    open_today = F.when(whole_day, "Open 24 hours today").otherwise(F.concat(F.lit("Open today "), clock(span["start"]), F.lit("–"), clock(span["end"])))
    ends = closing(week, day, minute)
    open_since_yesterday = F.when(ends.isNotNull(), F.concat(F.lit("Open now · until "), clock(ends)))
    closed = F.when(today.isNotNull(), F.concat_ws(" · opens ", F.lit("Closed now"), F.when(opens.isNotNull(), when)))
    return F.when(is_always(week), "Open 24 hours").otherwise(F.coalesce(F.when(span.isNotNull(), open_today), open_since_yesterday, closed))
