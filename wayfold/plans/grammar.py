"""Requests for places as search plans: a table of rules that read and cut a text in turn, and a table of decisions on what was read.

Reading: every rule looks for its words in what the rules before have left, notes what they mean and takes them out, so that a word of
time, price or occasion is no place's name or category any more. The rules are data; the fold over them is one column
expression a rule. What is left is tagged with the dictionary of places by an equi-join, and looked up among the known names.

Deciding: ``DECISIONS`` change the categories by what was read; each sees what the ones before decided.

Defined cases: null and empty requests have no marks and no categories; contradicting words count by the order of the rules; a
request may have any length; a null key is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators import lexicon
from wayfold.operators.lineage import broadcast_if_small, cut

_PLACE = r"(?:table|spot|seat|reservation|booking)s?"
_NUMBERS = "two three four five six seven eight nine ten eleven twelve".split()
_COUNT = rf"(\d{{1,2}}|{'|'.join(_NUMBERS)})"
_PEOPLE = "(?:people|persons|guests|adults|friends|of us|pax)"
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
_TIME_WORD = "(?:at|around|after|past|from|before|by|till|until)"


@dataclass(frozen=True)
class Rule:
    """``when`` is looked for; if ``unless`` is not, ``sets`` is noted and ``cut`` (``when`` itself if None) is taken out, or only ``keeps``, a group, left."""

    when: str
    sets: dict[str, Any] = field(default_factory=dict)
    unless: str = ""
    cut: str | None = None
    keeps: int = 0


def _words(*phrases: str) -> str:
    return rf"\b(?:{'|'.join(phrases)})\b"


#: Multi-word ideas as one word, before anything is read.
FUSED = (("gluten free", "glutenfree"), ("dairy free", "dairyfree"), ("sugar free", "sugarfree"), ("low carb", "lowcarb"), ("plant based", "vegan"), ("dim sum", "dimsum"), ("jet ski", "jetski"), ("zip line", "zipline"), ("paddle board", "paddleboard"), ("laser tag", "lasertag"), ("south indian", "southindian"))

RULES = (
    # What to do with a place. The rest of the text is its name or kind.
    Rule(rf"(?:{_words('call', 'get', 'book', 'order', 'need', 'find', 'hail')}.{{0,6}} (?:an? )?|^(?:an? )?){_words('taxi', 'cab', 'ride home')}.*", {"action": "taxi"}, cut=".*"),
    Rule(rf"^(?:please |can you |i (?:want|need) to |help me )?(?:book|reserve|get|make)(?: me| us)?(?: an?)? {_PLACE}(.*)$", {"action": "book"}, keeps=1),
    Rule(r"^(?:please )?(?:book|reserve)(?: me| us)? (?:at|in) (.+)$", {"action": "book"}, keeps=1),
    Rule(r"^(?:please |can you )?(?:call|dial) (?!me\b|us\b)(.+)$", {"action": "call"}, keeps=1),
    Rule(r"^(?:please )?(?:directions to|route to|navigate to|take me to|how (?:do|can) (?:i|we) get to|how to get to|(?:show me )?the way to) (.+)$", {"action": "directions"}, keeps=1),
    Rule(r"^(?:whats |what is )?(?:the )?(?:phone number|menu|opening hours|address|reviews|location|prices) (?:of|for|at) (.+)$", {"action": "lookup"}, keeps=1),
    Rule(r"^(?:tell me about|where ?i?s|info on|what about) (.+)$", {"action": "lookup"}, keeps=1),
    Rule(r"^is (.+?) open(?: right)?(?: now| today| tonight| late)?$", {"action": "lookup", "open_now": True}, keeps=1),
    Rule(r"^(?:please )?(?:find|show|recommend|suggest|get|book|reserve)(?: me| us)?\b", unless=r"^(?:please )?book (?:shop|store|club|fair|cafe)"),
    # When.
    Rule(_words("late ?night", "open late", "(?:till|until) late", "after hours", "(?:after|past) midnight", "night owl"), {"late": True}),
    Rule(rf"(?:{_TIME_WORD} )?\b\d{{1,2}}(?: \d{{2}})? ?(?:am|pm|a m|p m)\b|{_TIME_WORD} (?:noon|midnight)\b|(?:{_TIME_WORD} )?\b(?:[01]?\d|2[0-3]) [0-5]\d\b", {"timed": True}),
    Rule(_words("24 ?(?:h|hours?)", "24 ?7", "(?:a?)round the clock", "all night", "nonstop"), {"all_night": True}),
    Rule(_words("open (?:right )?now", "right now", "currently open", "still open", "open at the moment", "now"), {"open_now": True}),
    Rule(_words("open"), {}),
    Rule(_words("tonights?", "this evening", "this night"), {"tonight": True}),
    Rule(_words("tomorrow (?:night|evening)"), {"tomorrow": True, "evening": True}),
    Rule(_words("tomorrow(?: morning| afternoon)?"), {"tomorrow": True}),
    Rule(_words("today"), {"today": True}),
    Rule(_words("(?:(?:on|for|at) )?(?:(?:this|next|the) )?weekends?"), {"weekend": True}),
    *(Rule(_words(rf"(?:(?:on|this|next) )?{name}s?"), {"weekday": number}) for number, name in enumerate(WEEKDAYS)),
    Rule(_words("breakfast"), {"meal": "breakfast"}, cut=""),
    Rule(_words("brunch"), {"meal": "brunch"}, cut=""),
    Rule(_words("lunch"), {"meal": "lunch"}, cut=""),
    # What it may cost.
    Rule(_words("michelin(?: guide)?(?: (?:star|starred|rated|recommended|listed))?", "bib gourmand"), {"michelin": True}),
    Rule(_words("(?:not|less|not too) expensive", "inexpensive", "affordable", "value for money", "cheaper"), {"cheap": True, "price_max": 2}),
    Rule(_words("cheap", "cheapest", "(?:on a )?budget", "low cost", "bargain"), {"cheap": True, "price_max": 1}),
    Rule(_words("fine dining", "upscale", "luxur(?:y|ious)", "fancy", "high end", "gourmet", "elegant", "posh", "expensive", "exclusive", "classy"), {"upscale": True, "price_min": 3}, cut=_words("upscale", "luxur(?:y|ious)", "fancy", "high end", "elegant", "posh", "expensive", "exclusive", "classy")),
    Rule(r"\b(?:(?:under|below|less than|up to|max|maximum|within) )?(?:(?:aed|dhs?|dirhams?) ?\d{2,4}|\d{2,4} ?(?:aed|dhs?|dirhams?))\b", {"budgeted": True}),
    # Why, and with whom.
    Rule(_words("(?:girls|ladies) ?(?:night|day|trip)(?: out)?", "bachelorette(?: party)?", "hen (?:party|night)"), {"occasion": "girls"}),
    Rule(_words("night out", "going out", "go out"), {"occasion": "nightout"}),
    Rule(_words("birthdays?", "bday"), {"occasion": "birthday"}),
    Rule(_words("(?:business|client|corporate|working)(?= (?:lunch|dinner|meeting|breakfast))", "lunch meeting", "(?:impress|meet) (?:my |a )?clients?"), {"occasion": "business"}),
    Rule(_words("solo", "alone", "by myself", "on my own"), {"occasion": "solo"}),
    Rule(rf"\b(?:(?:for|with|of|party of|group of|table for) )?{_COUNT} {_PEOPLE}\b|\b(?:party of|group of|table for) {_COUNT}\b", {"grouped": True}),
    Rule(_words("(?:with|for) (?:my |the |our )?(?:kids?|children|toddlers?)"), {"kids": True}),
    # What it should be like.
    Rule(_words("surprise me", "(?:i ?a?m )?bored", "something (?:fun|different|new|cool|interesting|to do)", "(?:things|what) to do", "what (?:should|can) (?:i|we) do", "any ideas"), {"vague": True}),
    Rule(_words("indoors?", "inside", "air con(?:ditioned)?", "(?:its )?(?:so|too|very) hot", "(?:escape|beat) the heat", "raining", "rainy"), {"indoor": True}),
    Rule(_words("outdoor(?: (?:seating|terrace|tables?|area))?", "terrace", "al ?fresco", "patio", "sit outside", "open air"), {"outdoor": True}, unless=_words("outdoor (?:sports?|pool|cinema|activit(?:y|ies))")),
    Rule(_words("(?:pet|dog|cat)s? friendly", "with (?:my|a|our) (?:dog|puppy|pet)", "dogs? (?:allowed|welcome)"), {"pet": True}),
    Rule(_words("live (?:music|bands?|jazz|dj)", "jazz (?:bar|club|night)"), {"live_music": True}, cut=""),
    Rule(_words("(?:with|great|nice|amazing) views?(?: (?:of|over|on))?(?: the)?", "views? (?:of|over|on)(?: the)?", "views?", "overlooking(?: the)?"), {"view": True}),
    Rule(_words("emergency(?: room)?", "urgent care", "ambulance"), {"emergency": True}),
    Rule(_words("(?:metro|subway|tram)(?: (?:station|stop)s?)?", "(?:nearest|closest) stations?"), {"metro": True}, unless=_words("(?:gas|petrol|police|fire|bus|charging) stations?")),
    Rule(_words("near me", "nearby", "close by", "nearest", "closest", "walking distance", "around here"), {"near": True}),
)
# Words of a request that name nothing.
STOP = "a an and any anywhere at best can do for get go good great here i in is it like looking me my nice of on or our please some somewhere that the there to us want we where with would you".split()
_TYPES = {name: "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "int" for rule in RULES for name, v in rule.sets.items()}


def normal(text: Column) -> Column:
    """Lower case, apostrophes closed up, other marks as spaces, fused ideas as one word."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['’`]", "")
    out = F.trim(F.regexp_replace(plain, "[^a-z0-9а-яё]+", " "))
    for phrase, word in FUSED:
        out = F.regexp_replace(out, rf"\b{phrase.replace(' ', '[ -]?')}s?\b", word)
    return out


def clock(text: Column) -> Column:
    """(minutes, kind) of the first time with am or pm, a colon, or a word for noon or midnight; kind is at, after, until or before."""
    said = F.lower(F.coalesce(text, F.lit("")))
    word = r"(?:\b(at|around|after|past|from|before|by|till|until) )?"
    half, exact, named = rf"{word}\b(\d{{1,2}})(?:[:.](\d{{2}}))? ?([ap])\.? ?m\b", rf"{word}\b([01]?\d|2[0-3]):([0-5]\d)\b", r"\b(at|around|after|past|from|before|by|till|until) (noon|midnight)\b"
    part = lambda form, k: F.regexp_extract(said, form, k)
    number = lambda form, k: F.coalesce(F.nullif(part(form, k), F.lit("")).cast("int"), F.lit(0))
    kind = lambda w: F.when(w.isin("till", "until", "by"), "until").when(w.isin("after", "past", "from"), "after").when(w == "before", "before").otherwise("at")
    at_half = number(half, 2) % 12 * 60 + F.when(part(half, 4) == "p", 720).otherwise(0) + number(half, 3)
    told = lambda minutes, w: F.struct(minutes.cast("int").alias("minutes"), kind(w).alias("kind"))
    return (
        F.when(said.rlike(half) & number(half, 2).between(1, 12) & (number(half, 3) < 60), told(at_half, part(half, 1)))
        .when(said.rlike(exact), told(number(exact, 2) * 60 + number(exact, 3), part(exact, 1)))
        .when(said.rlike(named), told(F.when(part(named, 2) == "noon", 720).otherwise(0), part(named, 1)))
    )


def marks(requests: DataFrame, text: str) -> DataFrame:
    """``requests`` with a column for everything the rules note, and ``rest``. Of several rules that set a mark the first counts."""
    now = requests.withColumns({"rest": normal(F.col(text)), **{name: F.lit(None).cast(kind) for name, kind in _TYPES.items()}})
    count = rf"{_COUNT} {_PEOPLE}\b|\b(?:party of|group of|table for) {_COUNT}\b"
    said = F.concat_ws("", F.regexp_extract("rest", count, 1), F.regexp_extract("rest", count, 2))
    party = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, _NUMBERS)), said) + 1, F.lit(1)).cast("int"), F.expr("try_cast(nullif(_party, '') as int)"))
    budget = F.regexp_extract(F.lower(F.col(text)), r"(?:aed|dhs?|dirhams?) ?(\d{2,4})|(\d{2,4}) ?(?:aed|dhs?|dirhams?)\b", 0)
    now = now.withColumn("_party", said).withColumn("party", party).drop("_party")
    now = now.withColumns({"clock": clock(F.col(text)), "budget": F.nullif(F.regexp_extract(budget, r"\d+", 0), F.lit("")).cast("int")})
    for rule in RULES:
        hit = F.col("rest").rlike(rule.when) & (~F.col("rest").rlike(rule.unless) if rule.unless else F.lit(True))
        noted = {name: F.coalesce(F.col(name), F.when(F.col("_hit"), F.lit(value))) for name, value in rule.sets.items()}
        left = F.regexp_replace("rest", rule.when, f"${rule.keeps}") if rule.keeps else F.regexp_replace("rest", rule.when if rule.cut is None else rule.cut, " ") if rule.cut != "" else F.col("rest")
        squeezed = F.trim(F.regexp_replace(left, " +", " "))
        now = now.withColumn("_hit", hit).withColumns({**noted, "rest": F.when(F.col("_hit"), squeezed).otherwise(F.col("rest"))})
    return now.drop("_hit", "timed", "grouped", "budgeted")


# Categories that stand in where an occasion, a wish or an hour names none, and those that don't go with some.
INDOOR = ("mall", "museum", "cinema", "themepark", "zoo", "bowling", "icerink", "quest", "gallery", "karting", "climbing", "vr")
OUTDOOR = ("beach", "park", "tours", "boat", "golf")
VAGUE_DAY = ("sights", "museum", "themepark", "zoo", "gallery", "beach", "bowling", "quest")
VAGUE_NIGHT = ("bar", "hookah", "club", "karaoke", "sights", "bowling", "cinema", "food")
VAGUE_KIDS = ("themepark", "zoo", "aquapark", "family", "park", "museum")
NIGHT, DAY = ("bar", "food", "hookah", "club"), ("food", "coffee", "bar", "sights")

_c = F.col
_list = lambda names: F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
_without = lambda names: F.array_except("categories", _list(names))
_none = lambda: F.size("categories") == 0
_or = lambda kept, names: F.when(F.size(kept) > 0, kept).otherwise(_list(names))
_is = lambda name: F.coalesce(F.col(name), F.lit(False))
_occasion = lambda *names: F.coalesce(F.col("occasion").isin(*names), F.lit(False))


def _decisions(hour: Column) -> list[tuple[Column, Column]]:
    """(condition, categories) in order; each sees the categories that the ones before left."""
    kids, big = _is("kids"), F.coalesce(_c("party") >= 6, F.lit(False))
    night = (hour >= 18) | (hour < 4)
    open_only = _is("open_now") | _is("tonight") | _is("late") | _is("all_night") | (_c("clock").isNotNull() & _c("meal").isNull())
    return [
        (_occasion("birthday"), F.when(kids, _or(_without(("birthday",)), ("family", "themepark", "food"))).otherwise(_or(_without(("birthday", "family", "themepark")), ("food", "bar", "karaoke")))),
        (_occasion("girls", "nightout"), _or(_without(("beauty", "nails", "cosmetology", "barber", "clothes")), ("bar", "hookah", "club", "food"))),
        (_occasion("business"), F.array_union(_or(_without(("work",)), ("food",)), _list(("food",)))),
        (big & ~kids & F.arrays_overlap("categories", _list(("family", "themepark", "food", "birthday"))), _or(_without(("family", "themepark")), ("food",))),
        (_is("michelin") & ~F.array_contains("categories", "food"), F.concat(_list(("food",)), _without(("coffee",)))),
        ((_is("upscale") | _is("cheap") | _c("budget").isNotNull()) & _none(), _list(("food",))),
        (_is("outdoor") & _none(), _list(("food", "coffee"))),
        (_is("pet"), _or(_without(("petshop", "vet")), ("coffee", "food"))),
        (_is("live_music") & _none(), _list(("bar", "concert"))),
        (_occasion("solo") & _none(), _list(("sights", "museum", "market", "gallery", "coffee"))),
        (_is("vague") & (_none() | (kids & (F.size(_without(("family",))) == 0))), F.when(_is("indoor"), _list(INDOOR)).when(kids, _list(VAGUE_KIDS)).when(night, _list(VAGUE_NIGHT)).otherwise(_list(VAGUE_DAY))),
        (_is("indoor"), F.when(_none(), _list(INDOOR)).otherwise(_or(_without(OUTDOOR), ()))),
        (_none() & open_only, F.when(_is("late") | _is("tonight"), _list(NIGHT)).otherwise(_list(DAY))),
    ]


def _bare(text: Column) -> Column:
    """A text without words at its ends that name nothing."""
    stop = rf"(?:{'|'.join(STOP)})"
    return F.regexp_replace(F.regexp_replace(text, rf"^(?:{stop}(?: |$))+", ""), rf"(?:(?:^| ){stop})+$", "")


def plans(requests: DataFrame, keys: list[str], text: str, names: DataFrame, words: DataFrame, today: Column, hour: Column) -> DataFrame:
    """The search plan of every request: marks, categories, tag conditions, days, time, prices, and the place it names.

    ``names`` (name): names of known places; a request whose rest is one of them, and holds a word that is no category, asks for that place.
    ``words``: the dictionary of places, as of ``lexicon.dictionary``.
    """
    # Written once, as what is left of the texts is read again for tags, for single words and for names.
    read = cut(marks(requests.select(*keys, F.col(text).alias("_text")), "_text"))
    tags = lexicon.tagged(read.select("rest").distinct(), ["rest"], "rest", words)
    # A word of the rest is plain if it is in no phrase of the dictionary that matches there.
    rests = read.select("rest").distinct()
    covered = lexicon.matches(rests, ["rest"], "rest", words).groupBy("rest").agg(F.flatten(F.collect_set(F.sequence("start", F.col("end") - 1))).alias("_covered"))
    said = rests.join(covered, "rest", "left").withColumn("_words", lexicon.words(F.col("rest")))
    is_plain = F.exists(F.transform("_words", lambda w, i: ~w.isin(*STOP) & ~F.coalesce(F.array_contains("_covered", i), F.lit(False))), lambda x: x)
    plain = said.select("rest", is_plain.alias("_plain"))
    known = names.select(_bare(normal(F.col("name"))).alias("_bare"), F.col("name").alias("_name")).filter("_bare <> ''").groupBy("_bare").agg(F.min("_name").alias("_name"))
    full = read.join(tags, "rest").join(plain, "rest", "left").withColumn("_bare", _bare(F.col("rest"))).join(broadcast_if_small(known), "_bare", "left")
    named = F.when(F.col("_plain"), F.col("_name"))
    now = full.withColumns({"place": named, "categories": F.when(named.isNotNull(), _list(())).otherwise(F.col("tags"))})
    kind = F.when(_c("action") == "taxi", _list(())).when(_is("metro"), _list(("metro",))).when(_is("emergency"), _list(("hospital",)))
    for condition, categories in _decisions(hour):
        now = now.withColumn("categories", F.when(condition & _c("place").isNull(), categories).otherwise(_c("categories")))
    now = now.withColumn("categories", F.when(_c("place").isNull(), F.coalesce(kind, _c("categories"))).otherwise(_c("categories")))
    number = F.dayofweek(today) - 1
    saturday = F.date_add(today, F.pmod(F.lit(6) - number, F.lit(7)).cast("int"))
    ahead = F.date_add(today, F.pmod(_c("weekday") - number, F.lit(7)).cast("int"))
    first = F.when(_is("tonight") | _is("today"), today).when(_is("tomorrow"), F.date_add(today, 1)).when(_is("weekend"), F.when(number == 0, today).otherwise(saturday)).when(_c("weekday").isNotNull(), ahead)
    last = F.when(_is("weekend") & ~(_is("tonight") | _is("today") | _is("tomorrow")), F.when(number == 0, today).otherwise(F.date_add(saturday, 1))).otherwise(first)
    exact = _c("clock.minutes") - F.when(_c("clock.kind") == "until", 30).when(_c("clock.kind") == "before", 60).otherwise(0)
    soft = F.when(_is("late"), 30).when(_is("evening") | _is("tonight"), 1200).when(_c("meal") == "breakfast", 540).when(_c("meal").isNotNull(), 780)
    by_budget = F.when(_c("budget") <= 60, 1).when(_c("budget") <= 150, 2).when(_c("budget") <= 350, 3).when(_c("budget").isNotNull(), 4)
    ask = lambda name, *said: F.when(_is(name), _list(said)).otherwise(_list(()))
    return now.select(
        *keys, "action", "place", "categories", "rest",
        F.concat(ask("michelin", "michelin=*"), F.when(_is("upscale") & F.array_contains("categories", "food"), _list(("price=3", "price=4"))).otherwise(_list(())), ask("outdoor", "outdoor_seating=yes"), ask("pet", "dog=yes"),
                 ask("live_music", "live_music=yes"), ask("metro", "station=subway", "railway=tram_stop"), ask("emergency", "emergency=yes"), ask("all_night", "opening_hours=24/7")).alias("conditions"),
        first.alias("day_from"), last.alias("day_to"), F.pmod(F.coalesce(exact, soft), F.lit(1440)).alias("minutes"),
        (_is("open_now") | _is("tonight") | _is("late") | _is("all_night") | (_c("clock").isNotNull() & _c("meal").isNull())).alias("strict"),
        F.when(~_is("cheap"), _c("price_min")).alias("price_min"), F.coalesce(by_budget, _c("price_max")).alias("price_max"),
        "occasion", "party", "meal", *(_is(x).alias(x) for x in ("kids", "vague", "indoor", "view", "near")),
    )
