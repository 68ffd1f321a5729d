"""Cards from the payloads of catalogs and event services: one projection for each shape of payload, one set of columns for all.

A card has id, name, cat, area, hours, rating, reviews, level, closed, site, phone, booking_url, booking_kind, lat, lon; what a
payload does not tell is null, never a filler. An event record has id, name, venue, first_day, last_day, times, price, free, open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats of the payloads.
RUBRICS = "id string, name string, address_name string, rubrics array<struct<name:string>>, schedule struct<comment:string>, reviews struct<general_rating:double,general_review_count:bigint>, is_deleted boolean, flags struct<status:string>, contacts array<struct<type:string,value:string,url:string>>, point struct<lat:double,lon:double>"
FEATURE = "properties struct<CompanyMetaData:struct<id:string,name:string,address:string,url:string,Categories:array<struct<name:string>>,Phones:array<struct<formatted:string>>,Hours:struct<text:string>>>, geometry struct<coordinates:array<double>>"
TENS = "fsq_place_id string, name string, categories array<struct<name:string>>, location struct<formatted_address:string>, tel string, website string, latitude double, longitude double, hours struct<display:string>, price int, rating double, stats struct<total_ratings:bigint>, date_closed string"
ENUMS = "id string, displayName struct<text:string>, primaryTypeDisplayName struct<text:string>, types array<string>, formattedAddress string, internationalPhoneNumber string, websiteUri string, location struct<latitude:double,longitude:double>, regularOpeningHours struct<weekdayDescriptions:array<string>>, priceLevel string, rating double, userRatingCount bigint, businessStatus string"
EVENT = "id bigint, title string, is_free boolean, price string, dates array<struct<start:bigint,end:bigint>>, place struct<title:string,is_closed:boolean>"
TICKETS = "id bigint, name string, organization struct<name:string>, starts_at string, ends_at string, registration_data struct<price_min:double,is_registration_open:boolean>, ticket_types array<struct<price:double>>"
SCHEMA_ORG = "name string, eventStatus string, startDate string, endDate string, location struct<name:string>, isAccessibleForFree boolean, offers array<struct<price:string,priceCurrency:string>>"
LEVELS = {"PRICE_LEVEL_INEXPENSIVE": 1, "PRICE_LEVEL_MODERATE": 2, "PRICE_LEVEL_EXPENSIVE": 3, "PRICE_LEVEL_VERY_EXPENSIVE": 4}
CLOSED_WORDS = r"(?i)closed|закрыт|не работает|ликвидирован"


def _filled(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _site(x: Column) -> Column:
    return F.when(x.rlike("^https?://"), x)


def _tenths(x: Column) -> Column:
    """One decimal, halves up; nothing for 0 and below."""
    return F.when(x > 0, F.floor(F.round(x * 10, 6) + 0.5) / 10)


def _card(id_: Column, name: Column, cats: Column, area: Column, hours: Column, rating: Column, reviews: Column, level: Column, closed: Column, site: Column, phone: Column, lat: Column, lon: Column) -> list[Column]:
    digits = F.regexp_replace(phone, r"[^0-9+]", "")
    url = F.when(F.length(digits) > 0, F.concat(F.lit("tel:"), digits)).otherwise(site)
    kind = F.when(F.length(digits) > 0, "phone").when(site.isNotNull(), "site")
    none = lambda x, kind_: F.lit(None).cast(kind_) if x is None else x.cast(kind_)
    known = lat.isNotNull() & lon.isNotNull()
    return [
        id_.alias("id"), _filled(name).alias("name"), F.get(cats, F.lit(0)).alias("cat"), _filled(area).alias("area"), _filled(hours).alias("hours"), none(rating, "double").alias("rating"), F.coalesce(none(reviews, "bigint"), F.lit(0)).cast("bigint").alias("reviews"),
        none(level, "int").alias("level"), F.coalesce(closed, F.lit(False)).alias("closed"), site.alias("site"), phone.alias("phone"), url.alias("booking_url"), kind.alias("booking_kind"), F.when(known, lat).alias("lat"), F.when(known, lon).alias("lon"),
    ]


def _of(rows: DataFrame, json: str, schema: str, *keep: str) -> DataFrame:
    return rows.select(*keep, F.from_json(json, schema).alias("x")).filter("x is not null")


def from_rubrics(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """A catalog with rubrics and contacts: the first rubric is the category; closed by flags or words of the schedule."""
    x = F.col("x")
    contact = lambda kind, field: F.get(F.filter(x["contacts"], lambda c: (F.lower(c["type"]) == kind) & c[field].isNotNull()), F.lit(0))[field]
    closed = F.coalesce(x["is_deleted"], F.lit(False)) | F.concat_ws(" ", F.col("x.schedule.comment"), F.col("x.flags.status")).rlike(CLOSED_WORDS)
    card = _card(F.concat(F.lit("rubrics:"), x["id"]), x["name"], F.col("x.rubrics.name"), x["address_name"], F.col("x.schedule.comment"), F.nullif(F.col("x.reviews.general_rating"), F.lit(0.0)), F.col("x.reviews.general_review_count"), None, closed, _site(contact("website", "url")), contact("phone", "value"), F.col("x.point.lat"), F.col("x.point.lon"))
    return _of(rows, json, RUBRICS, *keep).select(*keep, *card)


def from_feature(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """A geo feature whose coordinates are longitude, latitude; it tells no rating."""
    x, m = F.col("x"), F.col("x.properties.CompanyMetaData")
    phone = F.get(F.filter(F.col("x.properties.CompanyMetaData.Phones.formatted"), lambda p: F.length(p) > 0), F.lit(0))
    at = F.col("x.geometry.coordinates")
    card = _card(F.concat(F.lit("feature:"), m["id"]), m["name"], F.col("x.properties.CompanyMetaData.Categories.name"), m["address"], F.col("x.properties.CompanyMetaData.Hours.text"), None, None, None, F.lit(False), _site(m["url"]), phone, F.get(at, F.lit(1)), F.get(at, F.lit(0)))
    return _of(rows, json, FEATURE, *keep).select(*keep, *card)


def from_tens(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """A catalog that rates out of 10 and tells a price tier of 1 to 4."""
    x = F.col("x")
    level = F.when(x["price"].between(1, 4), x["price"])
    card = _card(F.concat(F.lit("tens:"), x["fsq_place_id"]), x["name"], F.col("x.categories.name"), F.col("x.location.formatted_address"), F.col("x.hours.display"), _tenths(x["rating"] / 2), F.col("x.stats.total_ratings"), level, x["date_closed"].isNotNull(), _site(x["website"]), _filled(x["tel"]), x["latitude"], x["longitude"])
    return _of(rows, json, TENS, *keep).select(*keep, *card)


def from_enums(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """A catalog with enumerated price levels and states, machine names of types and a list of hours."""
    x = F.col("x")
    types = F.filter(F.transform(x["types"], lambda t: F.replace(t, F.lit("_"), F.lit(" "))), lambda t: ~t.rlike("point of interest|establishment"))
    cats = F.array_distinct(F.array_compact(F.concat(F.array(F.col("x.primaryTypeDisplayName.text")), F.coalesce(types, F.array().cast("array<string>")))))
    level = F.coalesce(*(F.when(x["priceLevel"] == name, n) for name, n in LEVELS.items()))
    closed = x["businessStatus"].rlike("CLOSED_(PERMANENTLY|TEMPORARILY)")
    card = _card(F.concat(F.lit("enums:"), x["id"]), F.col("x.displayName.text"), cats, x["formattedAddress"], F.array_join(F.col("x.regularOpeningHours.weekdayDescriptions"), "; "), _tenths(x["rating"]), x["userRatingCount"], level, closed, _site(x["websiteUri"]), _filled(x["internationalPhoneNumber"]), F.col("x.location.latitude"), F.col("x.location.longitude"))
    return _of(rows, json, ENUMS, *keep).select(*keep, *card)


def event_session(rows: DataFrame, json: str, day: Column, *keep: str) -> DataFrame:
    """An event of a service with epoch dates: the session within a day of ``day``, else the next one, else the last one."""
    x = F.col("x")
    start, dates = F.unix_seconds(day.cast("timestamp")), x["dates"]
    near = F.filter(dates, lambda d: d["start"].isNull() | d["start"].between(start - 86400, start + 2 * 86400 - 1))
    later = F.filter(dates, lambda d: d["start"] >= start - 86400)
    chosen = F.coalesce(F.get(near, F.lit(0)), F.get(later, F.lit(0)), F.element_at(F.when(F.size(dates) > 0, dates), -1))
    day_of = lambda s: F.to_date(F.timestamp_seconds(s))
    free = F.coalesce(x["is_free"], F.lit(False))
    amount = F.regexp_extract(F.replace(x["price"], F.lit(","), F.lit("")), r"([0-9]+(\.[0-9]+)?)", 1).try_cast("double")
    return _of(rows, json, EVENT, *keep).select(
        *keep, F.concat(F.lit("event:"), x["id"].cast("string")).alias("id"), _filled(x["title"]).alias("name"), F.col("x.place.title").alias("venue"), day_of(chosen["start"]).alias("first_day"), day_of(F.coalesce(chosen["end"], chosen["start"])).alias("last_day"),
        F.when(free, 0.0).otherwise(amount).alias("price"), free.alias("free"), (~F.coalesce(F.col("x.place.is_closed"), F.lit(False))).alias("open"),
    )


def ticket_event(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """An event with registration: free if its least price or any ticket is 0."""
    x = F.col("x")
    least = F.col("x.registration_data.price_min")
    free = F.coalesce(least == 0, F.lit(False)) | F.coalesce(F.exists(x["ticket_types"], lambda t: t["price"] == 0), F.lit(False))
    first = F.substring(x["starts_at"], 1, 10).try_cast("date")
    return _of(rows, json, TICKETS, *keep).select(
        *keep, F.concat(F.lit("ticket:"), x["id"].cast("string")).alias("id"), _filled(x["name"]).alias("name"), F.col("x.organization.name").alias("venue"), first.alias("first_day"), F.coalesce(F.substring(x["ends_at"], 1, 10).try_cast("date"), first).alias("last_day"),
        F.substring(x["starts_at"], 12, 5).alias("time"), least.alias("price"), free.alias("free"), F.coalesce(F.col("x.registration_data.is_registration_open"), F.lit(True)).alias("open"),
    )


def schema_org_event(rows: DataFrame, json: str, currency: str, *keep: str) -> DataFrame:
    """A schema.org event: none if cancelled or postponed or without name or start; an end at or soon after midnight belongs to the evening before."""
    x = F.col("x")
    day = lambda t: F.substring(t, 1, 10).try_cast("date")
    time = lambda t: _filled(F.substring(t, 12, 5))
    first, last = day(x["startDate"]), day(x["endDate"])
    same_night = (F.datediff(last, first) == 1) & time(x["startDate"]).isNotNull() & (time(x["endDate"]) < "07:00")
    ends = F.when(F.coalesce(same_night, F.lit(False)), first).when(last >= first, last).otherwise(first)
    amounts = F.filter(F.transform(F.filter(x["offers"], lambda o: F.coalesce(o["priceCurrency"], F.lit(currency)) == currency), lambda o: o["price"].try_cast("double")), lambda p: p.isNotNull())
    least = F.coalesce(F.array_min(F.filter(amounts, lambda p: p > 0)), F.when(F.size(amounts) > 0, 0.0))
    free = F.coalesce(x["isAccessibleForFree"], F.lit(False)) | F.coalesce(least == 0, F.lit(False))
    told = _of(rows, json, SCHEMA_ORG, *keep).select(
        *keep, _filled(x["name"]).alias("name"), F.col("x.location.name").alias("venue"), first.alias("first_day"), ends.alias("last_day"), time(x["startDate"]).alias("time"), F.when(free, 0.0).otherwise(least).alias("price"), free.alias("free"),
        F.coalesce(x["eventStatus"], F.lit("")).rlike("Event(Cancelled|Postponed)").alias("off"),
    )
    return told.filter("not off and name is not null and first_day is not null").drop("off")
