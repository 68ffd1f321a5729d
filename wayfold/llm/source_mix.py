"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources, ordered by code point with null last, get repeating weights and share a multiple of all
words; a source takes at most ``max_repeats`` times its words, and what it cannot take is shared
again by weight (water filling, solved in closed form over the table of sources, one row each).

Within a source with target T and S words, every document is first taken floor(T / S) times:
certain whole copies. The rest R = T - floor(T / S) * S is a sample without replacement in which every
document has an inclusion probability of its own, p = min(1, level * size ^ ``size_power``): longer documents
are likelier to be repeated whole. The level makes the expected words R; it is solved over the sums of words by
size class (``CLASSES`` a doubling), so that documents with p = 1 are certain and the others share what is left.
With a random number u that depends only on the id and the seed, documents are ordered by (u / (1 - u)) /
(p / (1 - p)), the Pareto order, and the smallest are taken up to R words: the size of the sample in words is fixed.

Documents longer than ``large_share`` of R are drawn first, up to their expected words; the others then fill
what these leave of R, so that a source misses its target by at most half a small document wherever its small
documents can fill it.

The cut through the order needs no sort of a source: ranks are mapped to (0, 1), words are summed
per 1/1024 of that range, then per 1/1024 of the range the cut falls into, and only the documents of
that last cell are ordered, by rank, id and size. A source with a third of all rows is thus never gathered in a task.

Defined cases: a null text has size 0; documents of size 0 take 0 words; a null source is a source
of its own; repeated rows are documents of their own with equal ranks; a null id is an id as any other; an
empty table gives none. Very long texts are counted whole; columns of the input are read by name, further ones not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import WORD, broadcast_if_small, cut, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
SEED = 20240229
LARGE_SHARE = 0.005
SIZE_POWER = 0.5
CLASSES = 4
CELLS = 1024


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(_source, source_size, target, _group) from (_source, source_size), one row per source; _group numbers them.

    Water filling: in the order of cap / weight, the first source whose share of what the capped
    ones leave is below its cap fixes the level; all later ones take level * weight.
    """
    named = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    numbered = by_source.withColumn("_group", F.row_number().over(named).cast("long"))
    ranked = numbered.withColumn("_weight", F.element_at(cycle, (F.pmod(F.col("_group") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn(
        "_cap", F.lit(float(max_repeats)) * F.col("source_size")
    )
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("_cap") / F.col("_weight"), "_group")
    before, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (total_share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    leveled = ranked.withColumn("_level", level)
    fixed = F.min(F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.struct((F.col("_cap") / F.col("_weight")).alias("o"), F.col("_level").alias("v")))).over(every)
    return leveled.withColumn("_fixed", fixed["v"]).select(
        "_source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_fixed") * F.col("_weight"), F.col("_cap"))).alias("target"), "_group"
    )


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the key and the seed alone."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 50)) + F.lit(0.5)) / F.lit(float(1 << 50))


def size_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1))) * CLASSES)


def inclusion(size: Column, level: Column, size_power: float = SIZE_POWER) -> Column:
    """The probability that a document of so many words is sampled."""
    return F.least(level * F.pow(size.cast("double"), F.lit(size_power)), F.lit(1.0))


def pareto_rank(u: Column, p: Column) -> Column:
    """u / (1 - u) over p / (1 - p), mapped to (0, 1) in the same order; p is kept off 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    q = (u / (1 - u)) / (p / (1 - p))
    return F.least(q / (1 + q), F.lit(1 - 1e-12))


def sampling_levels(sums: DataFrame, goals: DataFrame, size_power: float = SIZE_POWER) -> DataFrame:
    """(_group, _goal, _all, _level) from the sums (_group, _class, _words, _measure) by size class and (_group, _goal).

    In the order of falling class, classes are certain as long as the level that the rest would need gives their
    lower edge a probability of 1 or more; where all are, the level is without bound. ``_measure`` is the sum of words times size ^ ``size_power``.
    """
    falling = Window.partitionBy("_group").orderBy(F.desc("_class"))
    before, onward = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    tried = sums.join(goals, "_group").withColumn("_try", F.try_divide(F.col("_goal") - F.coalesce(F.sum("_words").over(before), F.lit(0)), F.sum("_measure").over(onward)))
    open_ = (F.col("_try") >= 0) & (F.col("_try") * F.pow(F.lit(2.0), F.col("_class") / CLASSES * size_power) < 1)
    return tried.groupBy("_group", "_goal").agg(F.sum("_words").alias("_all"), F.coalesce(F.max_by("_try", F.when(open_, F.col("_class"))), F.lit(1e300)).alias("_level"))


def _take_to_goal(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds _chosen to ``rows`` (_group, _rank in (0, 1), _size, _goal, _all, ...): the smallest ranks up to _goal words.

    The document the cut falls in is taken if at least half of it lies below the goal. ``goals``: the groups, few.
    """
    rows = rows.withColumn("_c1", F.floor(F.col("_rank") * CELLS)).withColumn("_c2", F.floor((F.col("_rank") * CELLS - F.col("_c1")) * CELLS))

    def crossing(part: DataFrame, cell: str) -> DataFrame:
        sums = part.groupBy("_group", cell, "_goal", "_base").agg(F.sum("_size").alias("_s"))
        upto = F.sum("_s").over(Window.partitionBy("_group").orderBy(cell)) + F.col("_base")
        return (
            sums.withColumn("_upto", upto)
            .filter("_upto > _goal and _upto - _s <= _goal")
            .groupBy("_group")
            .agg(F.min(F.struct(F.col(cell).alias("cell"), (F.col("_upto") - F.col("_s")).alias("below"))).alias("_x"))
        )

    first = cut(crossing(rows.withColumn("_base", F.lit(0.0)), "_c1").select("_group", F.col("_x.cell").alias("_x1"), F.col("_x.below").alias("_b1")))
    in_first = rows.join(broadcast_if_small(first), "_group").filter("_c1 = _x1").select("_group", "_c2", "_goal", "_size", F.col("_b1").alias("_base"))
    second = crossing(in_first, "_c2").select("_group", F.col("_x.cell").alias("_x2"), F.col("_x.below").alias("_b2"))
    cuts = broadcast_if_small(cut(first.join(second, "_group", "left")))
    placed = rows.join(cuts, "_group", "left")
    in_cell = F.coalesce((F.col("_c1") == F.col("_x1")) & (F.col("_c2") == F.col("_x2")), F.lit(False))
    ordered = Window.partitionBy("_group").orderBy("_rank", "_key", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = placed.filter(in_cell).withColumn("_chosen", F.sum("_size").over(ordered) + F.col("_b2") - F.col("_size") / 2 <= F.col("_goal"))
    before = F.when(F.col("_x1").isNull(), F.col("_goal") >= F.col("_all")).otherwise((F.col("_c1") < F.col("_x1")) | (F.col("_c1") == F.col("_x1")) & (F.col("_c2") < F.coalesce(F.col("_x2"), F.lit(-1))))
    rest = placed.filter(~in_cell).withColumn("_chosen", before)
    return rest.unionByName(cell).drop("_c1", "_c2", "_x1", "_b1", "_x2", "_b2")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    large_share: float = LARGE_SHARE,
    size_power: float = SIZE_POWER,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, inclusion (probability of one copy more)."""
    sizes = cut(docs.select(F.col(id_col).alias("_key"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size")))
    measure = F.col("_size") * F.pow(F.col("_size").cast("double"), F.lit(size_power))
    by_class = cut(sizes.groupBy("_source", size_class(F.col("_size")).alias("_class")).agg(F.sum("_size").alias("_words"), F.sum(measure).alias("_measure")))
    targets = source_targets(by_class.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, total_share, max_repeats)
    whole = F.least(F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)), F.lit(max_repeats))
    few = broadcast_if_small(cut(targets.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))))

    rows = sizes.join(few, sizes["_source"].eqNullSafe(few["_source"])).drop(few["_source"]).withColumn("_class", size_class(F.col("_size")))
    # The first class of large documents: the one that begins above the large share.
    large_from = F.ceil(F.log2(F.greatest(F.col("_rest") * large_share, F.lit(1.0))) * CLASSES) + 1
    large = (F.col("_class") >= large_from) & (F.col("_rest") > 0)
    sums = by_class.join(few, by_class["_source"].eqNullSafe(few["_source"])).select("_group", "_class", "_words", "_measure", "_rest", large.alias("_large"))
    levels = sampling_levels(sums.drop("_rest"), sums.groupBy("_group").agg(F.max("_rest").alias("_goal")), size_power)
    planned = cut(sums.join(levels.select("_group", "_level"), "_group"))
    edge = F.least(F.col("_level") * F.col("_measure"), F.col("_words"))

    def sampled(part: DataFrame, goals: DataFrame) -> DataFrame:
        goals = broadcast_if_small(cut(goals))
        ranked = part.join(goals, "_group").withColumn("_p", inclusion(F.col("_size"), F.col("_level"), size_power))
        return _take_to_goal(ranked.withColumn("_rank", pareto_rank(uniform(F.col("_key"), seed), F.col("_p"))), goals)

    upfront = planned.filter("_large").groupBy("_group", "_level").agg(F.sum(edge).cast("double").alias("_goal"), F.sum("_words").alias("_all"))
    drawn = cut(sampled(rows.filter(large), upfront))
    got = drawn.groupBy("_group").agg(F.sum(F.when(F.col("_chosen"), F.col("_size")).otherwise(0)).alias("_got"))
    small_sums = planned.filter("not _large")
    left = small_sums.groupBy("_group").agg(F.max("_rest").alias("_rest"), F.sum("_words").alias("_all")).join(got, "_group", "left")
    goal = F.least(F.greatest(F.col("_rest") - F.coalesce(F.col("_got"), F.lit(0)), F.lit(0.0)), F.col("_all").cast("double"))
    small = sampled(rows.filter(~large), sampling_levels(small_sums.select("_group", "_class", "_words", "_measure"), left.select("_group", goal.alias("_goal")), size_power))
    copies = (F.col("_whole") + F.when(F.col("_chosen") & (F.col("_size") > 0) & (F.col("_whole") < max_repeats), 1).otherwise(0)).cast("long")
    return drawn.unionByName(small).select(
        F.col("_key").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
        F.when(F.col("_whole") < max_repeats, F.col("_p")).otherwise(F.lit(0.0)).alias("inclusion"),
    )
