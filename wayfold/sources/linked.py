"""Events, venues and actions in the JSON-LD of pages, found by walking nested nodes as variants.

A page's blocks are parsed as variants; a broken block is read again without comment and CDATA marks and trailing commas, and
skipped if it still doesn't parse. The walk goes level by level: the nodes of a page at one depth are one array, and the next level
is made from it by array functions, so that a page is one row from its text to its finds, without an exchange. The depth is
bounded, so is the plan. A node's path (positions from the block down) puts finds into document order; fields of an object count in
the order of their names.

Defined cases: null and empty pages, pages without blocks and blocks that are no object or array have no finds; a null key is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_DEPTH, VENUE_DEPTH, MOST_VENUES, MOST_ELEMENTS = 6, 12, 200, 400

# Where events nest, fields whose content is not walked, and fields that only a venue has.
EVENT_FIELDS = ("@graph", "itemListElement", "item", "subEvent")
UNWALKED = ("review", "reviews", "aggregateRating", "image", "logo", "offers", "author", "publisher", "breadcrumb")
VENUE_FIELDS = ("openingHours", "openingHoursSpecification", "priceRange", "servesCuisine", "hasMenu", "menu", "acceptsReservations")
ADDRESS_FIELDS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
# Schema.org types of places to visit, and types that are none even if they carry a venue's field.
VENUE_TYPES = (
    "LocalBusiness AutomotiveBusiness AutoRental AutoRepair ChildCare Dentist EmergencyService EntertainmentBusiness AdultEntertainment ArtGallery Casino ComedyClub MovieTheater NightClub FinancialService BankOrCreditUnion "
    "FoodEstablishment Bakery BarOrPub Brewery CafeOrCoffeeShop Distillery FastFoodRestaurant IceCreamShop Restaurant Winery HealthAndBeautyBusiness BeautySalon DaySpa HairSalon HealthClub NailSalon TattooParlor "
    "LodgingBusiness BedAndBreakfast Campground Hostel Hotel Motel Resort VacationRental MedicalBusiness MedicalClinic Optician Pharmacy Physician Hospital ProfessionalService RealEstateAgent ShoppingCenter "
    "SportsActivityLocation BowlingAlley ExerciseGym GolfCourse PublicSwimmingPool SkiResort SportsClub StadiumOrArena Store BookStore ClothingStore ConvenienceStore DepartmentStore ElectronicsStore FurnitureStore GroceryStore JewelryStore "
    "TravelAgency TouristAttraction TouristDestination AmusementPark Aquarium Beach EventVenue LandmarksOrHistoricalBuildings Museum Park PerformingArtsTheater PlaceOfWorship Zoo"
).split()
OTHER_TYPES = (
    "AggregateOffer AggregateRating Answer Article BlogPosting BreadcrumbList Event FAQPage HowTo ImageObject ListItem NewsArticle Offer Person Product Question Recipe Review SearchAction VideoObject WebPage WebSite"
).split()


def _get(node: Column, field: str | None = None, kind: str = "variant") -> Column:
    return F.try_variant_get(node, "$" if field is None else f"$['{field}']", kind)


def as_array(node: Column) -> Column:
    return _get(node, None, "array<variant>")


def as_object(node: Column) -> Column:
    return _get(node, None, "map<string,variant>")


def _listed(node: Column) -> Column:
    """An array as it is, any other value as an array of it, null as an empty one."""
    return F.coalesce(as_array(node), F.when(node.isNotNull() & ~F.is_variant_null(node), F.array(node)), F.array().cast("array<variant>"))


def plain(node: Column) -> Column:
    """The text of a string, number or boolean, trimmed and with basic references decoded; null for others and for empty text."""
    said = F.when(as_array(node).isNull() & as_object(node).isNull(), _get(node, None, "string"))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        said = F.replace(said, F.lit(entity), F.lit(char))
    return F.nullif(F.trim(said), F.lit(""))


def scalar(node: Column, most: int = 300) -> Column:
    """A value's text: itself, the first plain one of an array, or an object's name, value, url or id; at most ``most`` characters."""
    of_object = F.coalesce(*(plain(_get(node, f)) for f in ("name", "@value", "url", "@id")))
    return F.substring(F.coalesce(plain(node), F.get(F.filter(F.transform(as_array(node), plain), lambda x: x.isNotNull()), F.lit(0)), of_object), 1, most)


def types(node: Column) -> Column:
    """Type names without the vocabulary's address."""
    said = F.filter(F.transform(_listed(F.coalesce(_get(node, "@type"), _get(node, "type"))), plain), lambda x: x.isNotNull())
    return F.transform(said, lambda x: F.substring_index(x, "/", -1))


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, _blocks): the parsed ld+json blocks of a page."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    bare = lambda x: F.regexp_replace(x, r"^\s*(<!--|//\s*<!\[CDATA\[|<!\[CDATA\[)|(-->|//\s*\]\]>|\]\]>)\s*$", "")
    # A text that the next mending leaves as it is has failed already: reading it again would cost another exception.
    mended = lambda x: F.regexp_replace(x, r",\s*([}\]])", "$1")
    read = lambda x: F.coalesce(F.try_parse_json(x), F.try_parse_json(F.nullif(bare(x), x)), F.try_parse_json(F.nullif(mended(bare(x)), bare(x))))
    return pages.select(key, F.filter(F.transform(found, read), lambda x: x.isNotNull()).alias("_blocks"))


def _below(node: Column, fields: Callable[[Column], Column]) -> Column:
    """The children of a node (path, value) with their paths: an array's elements, or the values that ``fields`` takes from an object."""
    values = F.coalesce(F.slice(as_array(node["value"]), 1, MOST_ELEMENTS), fields(node["value"]), F.array().cast("array<variant>"))
    return F.transform(values, lambda x, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), x.alias("value")))


def _is_nested(x: Column) -> Column:
    return as_array(x).isNotNull() | as_object(x).isNotNull()


def _event_fields(node: Column) -> Column:
    item = F.when(_get(node, "item").isNotNull() & as_object(_get(node, "item")).isNotNull(), _get(node, "item"))
    return F.filter(F.array(*(item if f == "item" else _get(node, f) for f in EVENT_FIELDS)), lambda x: x.isNotNull())


def _all_fields(node: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.map_filter(as_object(node), lambda k, v: ~k.isin(*UNWALKED) & _is_nested(v))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    return F.transform(entries, lambda e: e["value"])


def walk(parsed: DataFrame, key: str, depth: int, fields: Callable[[Column], Column], wanted: Callable[[Column], Column], most: int | None = None) -> DataFrame:
    """(key, position, depth, node): the wanted objects at depths of at most ``depth``, in document order, the first ``most`` of a page.

    ``wanted`` must ask for a field, so that it holds for objects only: to read a node as a map costs more than all of its tests.
    """
    first = F.transform("_blocks", lambda x, i: F.struct(F.array(i).alias("path"), x.alias("value")))
    now = parsed.select(key, first.alias("_0"))
    for level in range(1, depth + 1):
        now = now.withColumn(f"_{level}", F.flatten(F.transform(f"_{level - 1}", lambda n: _below(n, fields))))
    found = now.select(key, F.filter(F.concat(*(f"_{level}" for level in range(depth + 1))), lambda n: wanted(n["value"])).alias("_hits"))
    # Variants don't compare, so paths are sorted and looked up again.
    found = found.withColumn("_order", F.array_sort(F.transform("_hits", lambda n: n["path"])))
    # An inner explode would add a filter on the size of the hits, which repeats the whole walk below it.
    rows = found.select(key, "_order", F.explode_outer("_hits").alias("_hit")).filter("_hit is not null").withColumn("position", F.array_position("_order", F.col("_hit.path")).cast("int") - 1)
    rows = rows if most is None else rows.filter(F.col("position") < most)
    return rows.select(key, "position", (F.size("_hit.path") - 1).alias("depth"), F.col("_hit.value").alias("node"))


def is_event(node: Column) -> Column:
    # Types are read last: most nodes have no name.
    return _get(node, "name").isNotNull() & _get(node, "startDate").isNotNull() & F.exists(types(node), lambda t: t.endswith("Event"))


def events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The events of pages: key, position, depth, name, starts, ends, venue, price (the least above zero, 0 if all are free), image, url."""
    node = F.col("node")
    offers = F.flatten(F.transform(_listed(_get(node, "offers")), lambda o: F.array(_get(o, "price", "double"), _get(o, "lowPrice", "double"))))
    paid = F.array_min(F.filter(offers, lambda p: p > 0))
    return walk(blocks(pages, key, html), key, EVENT_DEPTH, _event_fields, is_event).select(
        key, "position", "depth",
        scalar(_get(node, "name")).alias("name"), scalar(_get(node, "startDate"), 40).alias("starts"), scalar(_get(node, "endDate"), 40).alias("ends"),
        scalar(_get(node, "location")).alias("venue"), F.coalesce(paid, F.when(F.exists(offers, lambda p: p == 0), 0.0)).alias("price"),
        scalar(_get(node, "image")).alias("image"), scalar(_get(node, "url")).alias("url"),
    )


def is_venue(node: Column) -> Column:
    named = types(node)
    has_field = F.lit(False)
    for f in VENUE_FIELDS:
        has_field = has_field | _get(node, f).isNotNull()
    return (F.arrays_overlap(named, F.array(*map(F.lit, VENUE_TYPES))) | has_field) & ~F.arrays_overlap(named, F.array(*map(F.lit, OTHER_TYPES)))


def _address(node: Column) -> Column:
    first = F.coalesce(F.get(as_array(node), F.lit(0)), node)
    return F.substring(F.coalesce(plain(first), F.nullif(F.concat_ws(", ", *(scalar(_get(first, f)) for f in ADDRESS_FIELDS)), F.lit(""))), 1, 300)


def _point(node: Column) -> Column:
    first = F.coalesce(F.get(as_array(node), F.lit(0)), node)
    lat, lon = (F.round(_get(first, f, "double"), 6) for f in ("latitude", "longitude"))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180) & ((lat != 0) | (lon != 0)), F.struct(lat.alias("lat"), lon.alias("lon")))


def _texts(node: Column, most: int, chars: int) -> Column:
    said = F.filter(F.transform(_listed(node), lambda x: F.substring(plain(x), 1, chars)), lambda x: x.isNotNull())
    return F.slice(said, 1, most)


def venues(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The first ``MOST_VENUES`` venues of each page that say anything of themselves, with the fields that listings use."""
    node = F.col("node")
    told = F.greatest(*(_get(node, f).isNotNull() for f in ("name", "geo", "address", "telephone", "priceRange", "openingHours", "openingHoursSpecification", "servesCuisine", "hasMenu", "menu")))
    wanted = lambda n: is_venue(n) & F.greatest(*(_get(n, f).isNotNull() for f in ("name", "geo", "address", "telephone", *VENUE_FIELDS[:-1])))
    return walk(blocks(pages, key, html), key, VENUE_DEPTH, _all_fields, wanted, MOST_VENUES).filter(told).select(
        key, "position", "depth", F.slice(types(node), 1, 4).alias("types"),
        *(scalar(_get(node, f), n).alias(c) for f, c, n in (("name", "name", 300), ("url", "url", 300), ("@id", "id", 300), ("telephone", "phone", 60), ("priceRange", "price_range", 60))),
        _address(_get(node, "address")).alias("address"), _point(_get(node, "geo")).alias("point"),
        _texts(_get(node, "openingHours"), 14, 200).alias("hours"), _texts(_get(node, "servesCuisine"), 8, 60).alias("cuisine"), _texts(_get(node, "sameAs"), 8, 300).alias("same_as"),
        hours_rows(_get(node, "openingHoursSpecification")).alias("hour_rows"),
    )


def hours_rows(node: Column) -> Column:
    """An openingHoursSpecification as an array of (days, opens, closes, valid_from, valid_to) texts."""
    row = lambda x: F.struct(
        F.transform(F.filter(F.transform(_listed(_get(x, "dayOfWeek")), plain), lambda d: d.isNotNull()), lambda d: F.substring_index(d, "/", -1)).alias("days"),
        *(scalar(_get(x, f), 30).alias(c) for f, c in (("opens", "opens"), ("closes", "closes"), ("validFrom", "valid_from"), ("validThrough", "valid_to"))),
    )
    return F.transform(F.slice(F.filter(_listed(node), lambda x: as_object(x).isNotNull()), 1, 40), row)


def actions(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, kind, url): targets of reserve and order actions."""
    wanted = lambda n: F.arrays_overlap(types(n), F.array(F.lit("ReserveAction"), F.lit("OrderAction")))
    found = walk(blocks(pages, key, html), key, VENUE_DEPTH, _all_fields, wanted)
    target = F.transform(_listed(_get(F.col("node"), "target")), lambda t: F.coalesce(plain(t), plain(_get(t, "urlTemplate")), plain(_get(t, "url"))))
    kind = F.when(F.array_contains(types(F.col("node")), "ReserveAction"), "reserve").otherwise("order")
    return found.select(key, "position", kind.alias("kind"), F.explode(F.filter(target, lambda u: u.isNotNull())).alias("url"))
