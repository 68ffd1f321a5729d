"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits in lower case. A seed is a fixed mask of word offsets; hashing
only the masked words of every position of both sides lets a hit survive substitutions at the
ignored offsets. Hits of equal seeds are joined, each gives an alignment of document and item, and
an alignment is a leak if some window of ``WINDOW`` aligned words (the whole item if it is shorter)
has at least 11 in 14 equal words.

The two masks below find every window of 14 words with up to 3 substitutions (all 364 ways were
enumerated; a test repeats that), and items of 13 words with up to 2. Shorter items are cut into one
segment more than the rule allows substitutions, so that one segment is equal throughout; its words
are the seed. Seeding thus loses no leak of any length; items of 1 to 4 words have to occur whole.

The benchmark's seeds are broadcast if a count shows them to be few (``BROADCAST_SEEDS``), and then
documents are neither shuffled nor sorted: seeds are exploded, looked up and dropped inside the scan
stage. A larger benchmark is joined by an ordinary shuffle of the seeds. Only documents with hits are
read again for the comparison; the hits are broadcast to them if they are few, and so are the items if their words are.

Defined cases: null and empty texts have no words and no leaks; every text of an item id is searched,
repeated ones once; documents count once per id; documents and items with a null id are told apart by
their texts; very long texts are searched whole; an empty table gives no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import broadcast_if_small, cut, text_or_empty

#: Each mask looks at the words at the shared offsets and at one more: 0 1 2 6 8, and 0 2 6 7 8.
SHARED = (0, 2, 6, 8)
EXTRAS = (1, 7)
SPAN = 9
WINDOW = 14
MIN_EQUAL = 11
#: Words from which the masks find every leak.
MASKED = 13
BROADCAST_SEEDS = 200_000
#: Words of all items up to which the items are broadcast.
BROADCAST_WORDS = 2_000_000


def words(text_col: str) -> Column:
    """Runs of letters and digits in lower case; what precedes the first and follows the last one leaves no empty word."""
    pieces = F.split(F.lower(text_or_empty(text_col)), r"[^\p{L}\p{N}]+")
    first = F.when(F.element_at(pieces, 1) == "", 2).otherwise(1)
    last = F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    return F.slice(pieces, first, F.greatest(last - first + 1, F.lit(0)))


def segments(n: int) -> list[tuple[int, int]]:
    """(start, words) of the seeds of an item of ``n`` words: one more than substitutions that the rule allows."""
    parts = n - -(-n * MIN_EQUAL // WINDOW) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(at, to - at) for at, to in zip(cuts, cuts[1:])]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _own, _text): _own is a digest of the text where the id is null, else empty."""
    own = F.when(F.col(id_col).isNull(), F.sha2(text_or_empty(text_col), 256)).otherwise("")
    return docs.select(F.col(id_col).alias("_id"), own.alias("_own"), F.col(text_col).alias("_text"))


def _seeded(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, _at, _seed, _extra0, _extra1) for every start in the _text of every row.

    Words are exploded with their array beside them, so that the hashes are compiled expressions; the array itself
    goes no further. The outer form of explode keeps the optimizer from splitting the text twice.
    """
    split = rows.select(*keys, words("_text").alias("_words"))
    started = split.select(*keys, "_words", F.posexplode_outer("_words").alias("_at", "_word")).filter(F.col("_at") + SPAN <= F.size("_words"))
    at = lambda o: F.get("_words", F.col("_at") + o)
    return started.select(*keys, "_at", F.xxhash64("_word", *(at(o) for o in SHARED[1:])).alias("_seed"), *(F.xxhash64(at(o)).alias(f"_extra{k}") for k, o in enumerate(EXTRAS)))


def _segment(n: int) -> Column:
    """Hash of the ``n`` words from _at on."""
    return F.xxhash64(F.lit(n), *(F.get("_words", F.col("_at") + k) for k in range(n)))


def _short_starts(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(_id, _own, _item, _start) for the equal segments of items too short for the masks; None if there are no such items."""
    cuts = F.array(*(F.array(*(F.struct(F.lit(at).alias("_at"), F.lit(n).alias("_n")) for at, n in segments(k))) for k in range(1, MASKED)))
    short = items.filter(F.size("_item_words").between(1, MASKED - 1)).select("_item", F.col("_item_words").alias("_words"), F.explode(F.element_at(cuts, F.size("_item_words"))).alias("_c"))
    short = short.select("_item", "_words", "_c._at", "_c._n")
    lengths = sorted(r["_n"] for r in short.select("_n").distinct().collect())
    if not lengths:
        return None
    tests = cut(short.select("_item", F.col("_at").alias("_item_at"), F.coalesce(*(F.when(F.col("_n") == n, _segment(n)) for n in lengths)).alias("_seed")))
    started = docs.select("_id", "_own", words("_text").alias("_words")).select("_id", "_own", "_words", F.posexplode_outer("_words").alias("_at", "_word"))
    seeds = started.select("_id", "_own", "_at", F.explode(F.array(*(F.when(F.col("_at") + n <= F.size("_words"), _segment(n)) for n in lengths))).alias("_seed")).filter("_seed is not null")
    return seeds.join(broadcast_if_small(tests, BROADCAST_SEEDS), "_seed").select("_id", "_own", "_item", (F.col("_at") - F.col("_item_at")).alias("_start"))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """(_id, _own, _item_id, _b): the best alignment of every document and item text with a leak."""
    texts = benchmark.select(F.col(item_id_col).alias("_item_id"), F.col(item_text_col).alias("_text")).distinct()
    items = cut(texts.select(F.monotonically_increasing_id().alias("_item"), "_item_id", "_text", words("_text").alias("_item_words")))
    tests = cut(_seeded(items.filter(F.size("_item_words") >= MASKED), "_item").toDF("_item", "_item_at", "_seed", "_test0", "_test1"))
    same_extra = (F.col("_extra0") == F.col("_test0")) | (F.col("_extra1") == F.col("_test1"))
    few = broadcast_if_small(tests, BROADCAST_SEEDS)
    keyed = _keyed(docs, id_col, text_col)
    seeds = _seeded(keyed, "_id", "_own")
    hits = seeds.join(few, (seeds["_seed"] == few["_seed"]) & same_extra).select("_id", "_own", "_item", (F.col("_at") - F.col("_item_at")).alias("_start"))
    short = _short_starts(keyed, items)
    starts = cut((hits if short is None else hits.unionByName(short)).distinct())
    aimed = broadcast_if_small(starts.toDF("_to", "_to_own", "_item", "_start"))
    found = keyed.join(aimed, F.col("_id").eqNullSafe(F.col("_to")) & (F.col("_own") == F.col("_to_own")))
    words_of = items.select("_item", "_item_id", "_item_words")
    if (words_of.agg(F.sum(F.size("_item_words"))).first()[0] or 0) <= BROADCAST_WORDS:
        words_of = broadcast_if_small(words_of, BROADCAST_SEEDS)
    aligned = found.join(words_of, "_item").select("_id", "_own", "_item", "_item_id", "_start", "_item_words", words("_text").alias("_words"))
    start = F.col("_start")
    beside = F.concat(F.array_repeat(F.lit(None).cast("string"), F.greatest(-start, F.lit(0)).cast("int")), F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.size("_item_words")))
    same = F.slice(F.zip_with("_item_words", beside, lambda w, d: F.when(w == d, 1).otherwise(0)), 1, F.size("_item_words"))
    width = F.least(F.size("_same"), F.lit(WINDOW))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_same") - width + 1), lambda i: F.aggregate(F.slice("_same", i, width), F.lit(0), lambda a, x: a + x)))
    compared = aligned.select("_id", "_own", "_item", "_item_id", "_start", same.alias("_same")).select(
        "_id", "_own", "_item", "_item_id", "_start", best.alias("_best"), width.alias("_width"), F.aggregate("_same", F.lit(0), lambda a, x: a + x).alias("_equal"), F.size("_same").alias("_n")
    )
    return (
        compared.groupBy("_id", "_own", "_item", "_item_id")
        .agg(F.max(F.struct("_best", "_equal", (-F.col("_start")).alias("_at"), "_n", "_width")).alias("_b"))
        .filter(F.col("_b._best") * WINDOW >= F.col("_b._width") * MIN_EQUAL)
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, doc_word, item_words, equal_words) for the best alignment of every document and item text with a leak.

    ``doc_word`` is the document's word (from 0, negative if the item begins before it) that the item's first
    word is aligned with.
    """
    return _leaks(docs, benchmark, id_col, text_col, item_id_col, item_text_col).select(
        F.col("_id").alias(id_col), F.col("_item_id").alias("item_id"), (-F.col("_b._at")).alias("doc_word"), F.col("_b._n").alias("item_words"), F.col("_b._equal").alias("equal_words")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with its columns."""
    leaks = _leaks(docs, benchmark, id_col, text_col, "item_id", "text")
    leaked = broadcast_if_small(cut(leaks.select(F.col("_id").alias("_leaked"), F.col("_own").alias("_leaked_own")).distinct()))
    own = F.when(docs[id_col].isNull(), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)).otherwise("")
    return docs.join(leaked, docs[id_col].eqNullSafe(leaked["_leaked"]) & (own == leaked["_leaked_own"]), "left_anti")
