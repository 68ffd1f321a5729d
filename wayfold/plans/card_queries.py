"""Payloads of catalogs and event services, made of the venues, read back as cards and event records."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import cards
from wayfold.plans.venue_queries import SQL_VENUES, venues

_CARD = ["id", "name", "cat", "area", "hours", "rating", "reviews", "level", "closed", "site", "phone", "booking_url", "booking_kind", "lat", "lon"]
_S = F.struct


def _named(**fields):
    return _S(*(c.alias(n) for n, c in fields.items()))


def _payload(spark, sf, **fields):
    return venues(spark, sf).select("pid", F.to_json(_named(**fields)).alias("json"))


def _pid():
    return F.col("pid").cast("string")


_TAIL = "site, phone, CASE WHEN phone IS NOT NULL THEN 'tel:' || phone ELSE site END AS booking_url, CASE WHEN phone IS NOT NULL THEN 'phone' WHEN site IS NOT NULL THEN 'site' END AS booking_kind, lat, lon"


def rubric_cards(spark, sf):
    k = F.col("pid")
    contact = lambda kind, value, url: _S(F.lit(kind).alias("type"), value.alias("value"), url.alias("url"))
    none = F.lit(None).cast("string")
    rows = _payload(spark, sf, id=_pid(), name=F.col("name"), address_name=F.lit(" "), rubrics=F.array(_S(F.col("category").alias("name")), _S(F.lit("x").alias("name"))), schedule=_S(F.when(k % 11 == 0, "временно закрыто").otherwise(F.col("hours")).alias("comment")),
                    reviews=_S((F.col("rating") - 1).alias("general_rating"), F.col("reviews").alias("general_review_count")), is_deleted=F.when(k % 13 == 0, True), contacts=F.array(contact("Phone", F.col("phone"), none), contact("website", none, F.col("site"))), point=_S("lat", "lon"))
    return cards.from_rubrics(rows, "json").select(_CARD)


RUBRIC_CARDS = f"""
SELECT 'rubrics:' || pid AS id, name, category AS cat, NULL::VARCHAR AS area, CASE WHEN pid % 11 = 0 THEN 'временно закрыто' ELSE hours END AS hours, nullif(rating - 1, 0) AS rating, reviews, NULL::INTEGER AS level, pid % 11 = 0 OR pid % 13 = 0 AS closed, {_TAIL} FROM ({SQL_VENUES})"""


def feature_cards(spark, sf):
    company = _S(_pid().alias("id"), "name", F.lit("Main St").alias("address"), F.when(F.col("pid") % 9 == 0, "javascript:x").otherwise(F.col("site")).alias("url"), F.array(_S(F.col("category").alias("name"))).alias("Categories"), F.array(_S(F.lit("").alias("formatted")), _S(F.col("phone").alias("formatted"))).alias("Phones"), _S(F.col("hours").alias("text")).alias("Hours"))
    rows = _payload(spark, sf, properties=_S(company.alias("CompanyMetaData")), geometry=_S(F.array("lon", "lat").alias("coordinates")))
    return cards.from_feature(rows, "json").select(_CARD)


FEATURE_CARDS = f"""
SELECT 'feature:' || pid AS id, name, category AS cat, 'Main St' AS area, hours, NULL::DOUBLE AS rating, 0::BIGINT AS reviews, NULL::INTEGER AS level, false AS closed, {_TAIL} FROM (SELECT * REPLACE (CASE WHEN pid % 9 <> 0 THEN site END AS site) FROM ({SQL_VENUES}))"""


def tens_cards(spark, sf):
    k = F.col("pid")
    rows = _payload(spark, sf, fsq_place_id=_pid(), name=F.col("name"), categories=F.array(_S(F.col("category").alias("name"))), location=_S(F.lit("Main St").alias("formatted_address")), tel=F.coalesce("phone", F.lit("")), website=F.col("site"), latitude=F.col("lat"), longitude=F.col("lon"),
                    hours=_S(F.col("hours").alias("display")), price=F.pmod(k, F.lit(6)), rating=F.pmod(k * 7, F.lit(101)) / 10.0, stats=_S(F.col("reviews").alias("total_ratings")), date_closed=F.when(k % 17 == 0, "2024-01-01"))
    return cards.from_tens(rows, "json").select(_CARD)


TENS_CARDS = f"""
SELECT 'tens:' || pid AS id, name, category AS cat, 'Main St' AS area, hours, CASE WHEN pid * 7 % 101 > 0 THEN floor(round((pid * 7 % 101) / 10.0::DOUBLE / 2 * 10, 6) + 0.5) / 10 END AS rating, reviews, CASE WHEN pid % 6 BETWEEN 1 AND 4 THEN pid % 6 END::INTEGER AS level, pid % 17 = 0 AS closed, {_TAIL} FROM ({SQL_VENUES})"""


def enum_cards(spark, sf):
    k = F.col("pid")
    level = F.element_at(F.array(*map(F.lit, (*cards.LEVELS, "PRICE_LEVEL_UNSPECIFIED"))), (F.pmod(k, F.lit(5)) + 1).cast("int"))
    text = lambda c: _S(c.alias("text"))
    rows = _payload(spark, sf, id=_pid(), displayName=text(F.col("name")), primaryTypeDisplayName=text(F.when(k % 2 == 0, F.col("category"))), types=F.array(F.lit("point_of_interest"), F.lit("night_club")), formattedAddress=F.lit("Main St"), internationalPhoneNumber=F.col("phone"), websiteUri=F.col("site"),
                    location=_S(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), regularOpeningHours=_S(F.array(F.lit("Mon: 1"), F.lit("Tue: 2")).alias("weekdayDescriptions")), priceLevel=level, rating=F.col("rating") - 1, userRatingCount=F.col("reviews"), businessStatus=F.when(k % 10 == 0, "CLOSED_TEMPORARILY").otherwise("OPERATIONAL"))
    return cards.from_enums(rows, "json").select(_CARD)


ENUM_CARDS = f"""
SELECT 'enums:' || pid AS id, name, CASE WHEN pid % 2 = 0 THEN category ELSE 'night club' END AS cat, 'Main St' AS area, 'Mon: 1; Tue: 2' AS hours, CASE WHEN rating > 1 THEN floor(round((rating - 1) * 10, 6) + 0.5) / 10 END AS rating, reviews, CASE WHEN pid % 5 < 4 THEN pid % 5 + 1 END::INTEGER AS level, pid % 10 = 0 AS closed, {_TAIL} FROM ({SQL_VENUES})"""

_EPOCH = "epoch(day_start)::BIGINT"


def session_events(spark, sf):
    """Events with three sessions, ten days apart: the one that a search for 1996-06-15 shows."""
    k, start = F.col("pid"), F.unix_seconds(F.col("day_start").cast("timestamp"))
    dates = F.transform(F.array(*map(F.lit, (0, 10, 20))), lambda d: _S((start + d * 86400 + 3600).alias("start"), (start + d * 86400 + 7200).alias("end")))
    rows = _payload(spark, sf, id=k, title=F.col("name"), is_free=k % 4 == 0, price=F.concat(F.lit("from "), F.col("price").cast("string"), F.lit(" AED")), dates=dates, place=_S(F.lit("Hall").alias("title"), (k % 8 == 0).alias("is_closed")))
    return cards.event_session(rows, "json", F.lit("1996-06-15").cast("date"))


SESSION_EVENTS = f"""
WITH v AS (SELECT *, [day_start, (day_start + 10)::DATE, (day_start + 20)::DATE] AS d FROM ({SQL_VENUES})),
c AS (SELECT *, coalesce(list_filter(d, lambda x: x BETWEEN DATE '1996-06-14' AND DATE '1996-06-16')[1], list_filter(d, lambda x: x >= DATE '1996-06-14')[1], d[3]) AS day FROM v)
SELECT 'event:' || pid AS id, name, 'Hall' AS venue, day AS first_day, day AS last_day, CASE WHEN pid % 4 = 0 THEN 0 ELSE price END::DOUBLE AS price, pid % 4 = 0 AS free, pid % 8 <> 0 AS open FROM c"""


def ticket_events(spark, sf):
    k, day = F.col("pid"), F.col("day_start").cast("string")
    rows = _payload(spark, sf, id=k, name=F.when(k % 9 != 0, F.col("name")).otherwise(" "), organization=_S(F.col("source").alias("name")), starts_at=F.concat(day, F.lit("T19:30:00+0400")), ends_at=F.when(k % 2 == 0, F.col("day_end").cast("string")),
                    registration_data=_S(F.when(k % 3 != 0, F.pmod(k, F.lit(5)).cast("double")).alias("price_min"), F.when(k % 7 == 0, False).alias("is_registration_open")), ticket_types=F.when(k % 11 == 0, F.array(_S(F.lit(0.0).alias("price")))))
    return cards.ticket_event(rows, "json")


TICKET_EVENTS = f"""
SELECT 'ticket:' || pid AS id, CASE WHEN pid % 9 <> 0 THEN name END AS name, source AS venue, day_start AS first_day, CASE WHEN pid % 2 = 0 THEN day_end ELSE day_start END AS last_day, '19:30' AS time, CASE WHEN pid % 3 <> 0 THEN (pid % 5)::DOUBLE END AS price,
  coalesce(pid % 3 <> 0 AND pid % 5 = 0, false) OR pid % 11 = 0 AS free, pid % 7 <> 0 AS open FROM ({SQL_VENUES})"""


def schema_events(spark, sf):
    k, day = F.col("pid"), F.col("day_start").cast("string")
    end = F.when(k % 3 == 0, F.concat(F.date_add("day_start", 1).cast("string"), F.lit("T02:00"))).when(k % 3 == 1, F.col("day_end").cast("string"))
    offer = lambda price, currency: _S(price.cast("string").alias("price"), F.lit(currency).alias("priceCurrency"))
    rows = _payload(spark, sf, name=F.col("name"), eventStatus=F.when(k % 10 == 0, "https://schema.org/EventCancelled"), startDate=F.when(k % 14 == 1, "soon").otherwise(F.concat(day, F.lit("T21:00:00"))), endDate=end, location=_S(F.lit("Hall").alias("name")),
                    isAccessibleForFree=F.when(k % 8 == 0, True), offers=F.array(offer(F.col("price"), "AED"), offer(F.lit(1), "USD"), offer(F.when(k % 5 == 0, 0), "AED")))
    return cards.schema_org_event(rows.withColumn("key", F.col("pid")), "json", "AED", "key")


SCHEMA_EVENTS = f"""
SELECT pid AS key, name, 'Hall' AS venue, day_start AS first_day, CASE WHEN pid % 3 = 1 THEN day_end ELSE day_start END AS last_day, '21:00' AS time,
  CASE WHEN pid % 8 = 0 THEN 0 WHEN price > 0 THEN price WHEN price = 0 OR pid % 5 = 0 THEN 0 END::DOUBLE AS price, pid % 8 = 0 OR coalesce(price = 0, false) OR price IS NULL AND pid % 5 = 0 AS free
FROM ({SQL_VENUES}) WHERE pid % 10 <> 0 AND pid % 14 <> 1"""

WITH_SQL = "rubric_cards feature_cards tens_cards enum_cards session_events ticket_events schema_events".split()
QUERIES = {n: globals()[n] for n in WITH_SQL}
ORACLE_SQL = {n: globals()[n.upper()] for n in WITH_SQL}
