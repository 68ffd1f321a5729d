"""Tagging texts by a dictionary of phrases: the word sequences of a text are joined with the dictionary, so that the number of phrases
does not multiply the work and no pattern is tried on every text.

Words are runs of letters and digits in lower case without a plural s, in texts and phrases alike. A phrase matches where its words stand in a
row. A phrase may be an exclusion of a tag: a match of the tag inside a match of the exclusion does not count, as ``pool`` in
``pool table``. The dictionary is broadcast only if a count proves it small.

Defined cases: null and empty texts have no tags; phrases without words match nothing; repeated phrases count once; a text may be of
any length, its sequences are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.lineage import broadcast_if_small

# The tags of places, and the English words that requests and names use for them; after a minus sign those that mean
# something else although they hold such a word.
PLACE_WORDS = """
hookah: hookah, shisha, sheesha
bar: bar, pub, cocktail, wine, beer, brewery, taproom, drink, nightcap, rooftop bar - juice bar, salad bar, milk bar, nail bar, soft drink, bar exam
food: restaurant, dinner, lunch, brunch, breakfast, eat, eatery, food, cuisine, dining, bistro, steakhouse, burger, pizza, sushi, noodle, shawarma, buffet, grill - pet food, dog food, cat food
coffee: coffee, cafe, espresso, cappuccino, latte, flat white, tea house - internet cafe, coffee table, coffee machine
bakery: bakery, bread, croissant, bagel
pastry: cake, dessert, sweet, patisserie, ice cream, gelato, confectionery, waffle - home sweet home
winestore: wine shop, liquor store, bottle shop
grocery: grocery, convenience store, greengrocer, corner shop
supermarket: supermarket, hypermarket
market: market, bazaar, souk, farmers market - market research, stock market, marketing
karaoke: karaoke
club: nightclub, night club, dance club, disco, clubbing, rave
bowling: bowling
billiards: billiard, snooker, pool table, pool hall
quest: escape room, escape game, quest room
vr: virtual reality, vr
shooting: shooting range, gun range, archery
karting: karting, go kart, kart
theatre: theatre, theater, musical, opera, ballet, drama - movie theater, operating theatre
concert: concert, live music, gig, jazz night
themepark: theme park, amusement park, roller coaster, ride
golf: golf, driving range
mosque: mosque, masjid, prayer room
church: church, cathedral, chapel
boat: yacht, boat, cruise, dhow, catamaran, sailing
tours: tour, excursion, safari, sightseeing bus, guided walk - safari park
carrental: car rental, rent a car, car hire
clothes: clothe, clothing, fashion, boutique, shoe, sneaker, dress - dress code
jewelry: jewelry, jewellery, jeweller, diamond, watch shop
perfume: perfume, fragrance, oud, scent
electronics: electronic, laptop, gadget, computer shop, phone shop
hospital: hospital, emergency room, urgent care
cinema: cinema, movie, film, imax, movie theater
aquapark: water park, aquapark, waterpark
zoo: zoo, aquarium, safari park, petting zoo, bird park
museum: museum
gallery: gallery, art space, exhibition, art fair
library: library, reading room
beach: beach, seaside, swim in the sea, sunbathe - beach club
sights: sight, sightseeing, landmark, viewpoint, attraction, monument, observation deck - eye sight
park: park, garden, promenade, picnic - car park, theme park, amusement park, water park, safari park, bird park, park my car, beer garden, business park
planetarium: planetarium, observatory
barber: barber, haircut, beard trim
nails: nail, manicure, pedicure, nail bar - nail gun
cosmetology: cosmetology, botox, filler, laser hair removal, facial
beauty: beauty salon, beauty, eyebrow, lash, threading, makeup
tattoo: tattoo, piercing
spa: spa, sauna, hammam, steam room, jacuzzi
massage: massage
gym: gym, fitness, workout, crossfit, weight training
yoga: yoga, pilate, meditation, stretching
pool: swimming pool, lap pool, pool - pool table, pool hall, car pool
icerink: ice rink, ice skating, skating rink
climbing: climbing, bouldering
tennis: tennis, padel, squash, badminton, pickleball - butternut squash, squash soup
clinic: clinic, doctor, medical center, medical centre, blood test
dentist: dentist, dental, tooth, teeth
pharmacy: pharmacy, drugstore, chemist, medicine
optics: optician, eyewear, glasse, contact lense - glass of wine
family: kid, child, children, family, playground, toddler
vet: vet, veterinary, veterinarian, animal hospital
petshop: pet shop, pet store, pet food, grooming, dog food, cat food
work: coworking, co working, workspace, meeting room, laptop friendly
print: printing, copy shop, print shop, photocopy
bank: bank, atm, currency exchange, money exchange - blood bank, river bank, power bank
post: post office, parcel, courier, stamp
laundry: laundry, laundromat, dry cleaning, dry cleaner
tailor: tailor, alteration, shoe repair, cobbler
keys: locksmith, key cutting, spare key
phonerepair: phone repair, screen repair, broken screen
photo: photo studio, photographer, passport photo
courses: course, language school, lesson, tutor, workshop - golf course, main course
legal: notary, lawyer, attorney, typing center, typing centre
carwash: car wash, wash my car, detailing
carrepair: car repair, tyre, tire shop, mechanic, garage
fuel: petrol, gas station, fuel, charging station
parking: parking, car park, park my car
metro: metro station, metro stop, subway station, tram stop, nearest metro
mall: mall, shopping center, shopping centre, department store, shopping
flowers: flower, florist, bouquet
gifts: gift, souvenir, present
books: bookshop, bookstore, book store, book shop
hardware: hardware store, tool shop, diy store
hotel: hotel, hostel, guest house, place to stay, resort
date: romantic, date night, anniversary, for two
birthday: birthday, celebrate, celebration
"""


def words(text: Column) -> Column:
    """The words of a text, without a plural s."""
    split = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.transform(split, lambda w: F.regexp_replace(w, "(?<=[a-z]{2}[a-rt-z])s$", ""))


def entries(lines: str) -> list[tuple[str, str, bool, int]]:
    """(tag, phrase, exclusion, priority) of ``tag: phrase, phrase - exclusion, exclusion`` lines; earlier lines come first."""
    out = []
    for priority, line in enumerate(x for x in lines.strip().splitlines() if x.strip()):
        tag, said = line.split(":", 1)
        wanted, _, unwanted = said.partition(" - ")
        out += [(tag.strip(), p.strip(), excluded, priority) for part, excluded in ((wanted, False), (unwanted, True)) for p in part.split(",") if p.strip()]
    return out


def dictionary(spark: SparkSession, rows: list[tuple[str, str, bool, int]]) -> DataFrame:
    """(tag, phrase, excluded, priority, n): phrases as words in a row and their number."""
    frame = spark.createDataFrame(rows, "tag string, phrase string, excluded boolean, priority int").withColumn("_w", words(F.col("phrase")))
    return frame.select("tag", F.array_join("_w", " ").alias("phrase"), "excluded", "priority", F.size("_w").alias("n")).filter("n > 0").distinct()


def matches(texts: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(keys, tag, priority, start, end): where phrases match and no exclusion of their tag covers them; word numbers, the end exclusive."""
    lengths = [int(r.n) for r in lexicon.select("n").distinct().collect()]  # as many as a phrase has words at most
    said = texts.select(*keys, words(F.col(text)).alias("_w"))
    sequences = F.flatten(F.array(*(F.transform(F.filter(F.sequence(F.lit(0), F.size("_w")), lambda i: i + n <= F.size("_w")), lambda i: F.struct(i.alias("start"), (i + n).alias("end"), F.array_join(F.slice("_w", i + 1, n), " ").alias("phrase"))) for n in lengths)))
    rows = said.select(*keys, F.explode(sequences).alias("s")).select(*keys, "s.*") if lengths else said.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("phrase")).limit(0)
    found = rows.join(broadcast_if_small(lexicon.drop("n")), "phrase")
    none = found.filter("excluded").select(*(F.col(k).alias(f"_x_{k}") for k in (*keys, "tag")), F.col("start").alias("_from"), F.col("end").alias("_to"))
    covered = F.expr(" and ".join(f"`{k}` <=> `_x_{k}`" for k in (*keys, "tag"))) & F.expr("_from <= start and end <= _to")
    return found.filter("not excluded").join(none, covered, "left_anti").select(*keys, "tag", "priority", "start", "end")


def tagged(texts: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """(keys, tags): every row of ``texts`` with its tags in the order of the dictionary."""
    tags = F.transform(F.array_sort(F.collect_set(F.struct("priority", "tag"))), lambda x: x["tag"])
    found = matches(texts, keys, text, lexicon).groupBy(*(F.col(k).alias(f"_x_{k}") for k in keys)).agg(tags.alias("tags"))
    same = F.expr(" and ".join(f"`{k}` <=> `_x_{k}`" for k in keys))
    return texts.select(*keys).join(found, same, "left").select(*keys, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


# What categories of public catalogs mean, by their words; the first line that matches a category decides. Then: categories that
# are no places to visit, categories that say too little, so that the name decides, and tags that the name must confirm.
CATALOG_WORDS = """
hookah: hookah bar, shisha lounge
coffee: coffee shop, cafe, tea room, coffee roastery
bakery: bakery, bagel shop
pastry: dessert shop, ice cream shop, candy store, patisserie
bar: bar, pub, brewery, lounge, wine bar, beer garden
food: restaurant, diner, bistro, steakhouse, food court, food truck
supermarket: supermarket, hypermarket
grocery: grocery store, convenience store
club: dance club, nightclub
karaoke: karaoke
cinema: movie theater, cinema
theatre: theatre, performing art, opera house
museum: museum
gallery: art gallery
zoo: zoo, aquarium
themepark: amusement park, theme park
aquapark: water park
golf: golf course, golf club
park: park, botanical garden
beach: beach
gym: gym, fitness center
yoga: yoga studio, pilate studio
spa: spa, sauna
nails: nail salon
barber: barber
beauty: beauty salon, hair salon
hospital: hospital
dentist: dentist, dental clinic
clinic: doctor, medical center, clinic
pharmacy: pharmacy
vet: veterinarian
petshop: pet store
bank: bank, atm
post: post office
laundry: laundry, dry cleaning
carwash: car wash
carrepair: auto repair, tire shop
fuel: gas station, charging station
parking: parking
mall: shopping center, shopping mall
hotel: hotel, resort, hostel
mosque: mosque
vr: virtual reality center
planetarium: planetarium
"""
NOT_A_PLACE = "dealer, wholesaler, manufacturer, agency, supplier, equipment, contractor, distributor, milk bar, consultant"
VAGUE_CATEGORIES = ("travel_service", "arts_and_entertainment", "attraction", "shopping", "sports_and_recreation", "topic")
CONFIRMED_BY_NAME = {"golf": "golf, driving range", "planetarium": "planetarium, observatory, space", "vr": "vr, virtual, reality"}
MOST_TAGS = 3


def catalog_tags(places: DataFrame, key: str, category: str, others: str, basic: str, name: str, place_words: DataFrame) -> DataFrame:
    """(key, tags): at most three tags of a catalog's place, from its main category, its other categories, a basic one, and its name.

    Every category gives the tag of the first line with a match; categories that are no place to visit give none, and such a main
    category ends it. The basic category counts only if the others gave nothing, and the name, by ``place_words``, only if that gave nothing
    either and the main category says too little. Tags that need it are dropped unless the name confirms them.
    """
    spark = places.sparkSession
    spaced = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "_", " ")
    rules, out_of = dictionary(spark, entries(CATALOG_WORDS)), dictionary(spark, entries(f"out: {NOT_A_PLACE}"))
    said = places.select(key, F.posexplode(F.concat(F.array(F.coalesce(category, F.lit(""))), F.coalesce(others, F.array().cast("array<string>")), F.array(F.coalesce(basic, F.lit(""))))).alias("at", "said"), (F.size(F.coalesce(others, F.array().cast("array<string>"))) + 1).alias("basic_at"))
    distinct = said.select("said").distinct().withColumn("spaced", spaced(F.col("said")))
    unwanted = tagged(distinct, ["said"], "spaced", out_of).select("said", (F.size("tags") > 0).alias("out"))
    first = matches(distinct, ["said"], "spaced", rules).groupBy("said").agg(F.min_by("tag", "priority").alias("tag"))
    meaning = unwanted.join(first, "said", "left").select("said", "out", F.when(~F.col("out"), F.col("tag")).alias("tag"))
    read = said.join(broadcast_if_small(meaning), "said").groupBy(key).agg(
        F.bool_or((F.col("at") == 0) & F.col("out")).alias("_out"),
        F.bool_or((F.col("at") == F.col("basic_at")) & F.col("out")).alias("_basic_out"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("at") < F.col("basic_at")) & F.col("tag").isNotNull(), F.struct("at", "tag")))), lambda x: x["tag"]).alias("_own"),
        F.max(F.when(F.col("at") == F.col("basic_at"), F.col("tag"))).alias("_basic"),
    )
    named = tagged(places.select(key, name), [key], name, place_words).withColumnRenamed("tags", "_named")
    confirming = dictionary(spark, entries("\n".join(f"{t}: {w}" for t, w in CONFIRMED_BY_NAME.items())))
    sure = tagged(places.select(key, name), [key], name, confirming).withColumnRenamed("tags", "_sure")
    own = F.array_distinct(F.col("_own"))
    vague = F.coalesce(F.col(category).isin(*VAGUE_CATEGORIES), F.lit(False))
    guess = F.when(F.size(own) > 0, own).when(F.col("_basic").isNotNull(), F.array("_basic")).when(vague & ~F.col("_basic_out"), F.slice("_named", 1, 1)).otherwise(F.array().cast("array<string>"))
    kept = F.filter(guess, lambda t: ~t.isin(*CONFIRMED_BY_NAME) | F.array_contains("_sure", t))
    return places.select(key, category).join(read, key).join(named, key).join(sure, key).select(key, F.when(F.col("_out"), F.array().cast("array<string>")).otherwise(F.slice(kept, 1, MOST_TAGS)).alias("tags"))
