"""Sharding by a weighted hash tree: a document descends from region to rack to shard by weighted hash draws.

At every node each child draws -ln(u) / weight, u being a hash in (0, 1) of the document's id and the child's path, and the
smallest draw wins, so that a child's share of the node's documents follows its weight. A node weighs what its shards weigh.

What moves when weights change: a draw depends on nothing but the id, the child's path and the child's weight. If one shard
gets another weight, only draws of nodes on its path change; at each of these levels documents move into or out of
the node on the path, and no document moves between two subtrees whose weights stay.

Added shards come as a later generation: the root draws over (generation, region), and a generation's descent
meets only its own shards. So a document that does not follow the new generation's draw keeps its shard, and one that
does goes to a new shard, wherever in the regions and racks that stands: one more shard takes rows only into itself.

Law ``key``: the id and the tree decide; equal texts may lie apart, repeated ids lie together. Slots number a
shard's rows from 0 without gaps, by id (null first), size and checksum; rows equal in all of these have slots in any order.
The rows are dealt by ranges of that order, with a row number behind it, so that neither a shard nor an id shared
by many rows is one task; offsets come from counts by range and shard.

Defined cases: a null id draws like the text ``null``; a null text has size 1 and checksum 0; other columns are not read, so
that their names can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import broadcast_if_small, store

LEVELS = ("region", "rack", "shard")
#: Rows of a range of the slot order, and of the smallest range worth a task of its own.
RANGE_ROWS, TASK_ROWS = 1_000_000, 20_000
#: Hexadecimal digits of a digest that make a draw.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0
    generation: int = 0

    def path(self, level: int) -> str:
        return "/".join([str(self.generation), self.region, self.rack, str(self.number)][: level + 2])


def layout(shards: int, built: int = 8, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """``shards`` shards of equal weight in racks of ``per_rack`` and regions of ``racks``; those beyond the first ``built`` came one by one."""
    return [Shard(n, f"r{n // (per_rack * racks)}", f"k{n // per_rack % racks}", 1.0, max(0, n - built + 1)) for n in range(shards)]


def grow(tree: list[Shard], region: str, rack: str, weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, as a generation of its own."""
    return [*tree, Shard(1 + max(s.number for s in tree), region, rack, weight, 1 + max(s.generation for s in tree))]


def reweigh(tree: list[Shard], weights: dict[int, float]) -> list[Shard]:
    """The tree with other weights of some shards; weight 0 takes a shard's documents away."""
    return [replace(s, weight=weights.get(s.number, s.weight)) for s in tree]


def _children(tree: list[Shard]) -> list[list[tuple[str, float, int]]]:
    """For every node, the root first, its children (path, weight, place of the child's own list; for shards: the number)."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    lists: list[list[tuple[str, float, int]]] = []

    def add(shards: list[Shard], level: int) -> int:
        at = len(lists)
        lists.append([])
        groups: dict[str, list[Shard]] = {}
        for s in shards:
            groups.setdefault(s.path(level), []).append(s)
        for path, members in sorted(groups.items()):
            below = members[0].number if level + 1 == len(LEVELS) else add(members, level + 1)
            lists[at].append((path, sum(s.weight for s in members), below))
        return at

    add(live, 0)
    return lists


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """Number of the shard that the key's draws lead to."""
    lists = F.array(*(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(b).alias("below")) for p, w, b in node)) for node in _children(tree)))

    def draw(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit("|"), child["path"])), 1, DRAW_DIGITS)
        unit = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
        return F.struct((-F.log(unit) / child["weight"]).alias("score"), child["path"].alias("path"), child["below"].alias("below"))

    at = F.lit(0)
    for _ in LEVELS:
        at = F.array_min(F.transform(F.element_at(lists, at + 1), draw))["below"]
    return at


def draw_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (in the tree ``grown``)."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        shard_of(draw_key(id_col), tree).alias("shard"),
        (F.lit(None).cast("int") if grown is None else shard_of(draw_key(id_col), grown)).alias("grown_shard"),
    ).withColumn("_row", F.monotonically_increasing_id())
    count = docs.count()
    ranges = count // RANGE_ROWS + min(docs.sparkSession.sparkContext.defaultParallelism, count // TASK_ROWS) + 1
    order = ["_id", "size", "text_crc32", "_row"]
    dealt = store(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    offsets = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range", "shard").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(broadcast_if_small(offsets), ["_range", "shard"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_place")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, tree: list[Shard], id_col: str = "doc_id", rows_per_file: int = RANGE_ROWS) -> None:
    """All columns of ``docs`` as Parquet below ``path``, a folder ``_shard=N`` for every shard, files of at most ``rows_per_file`` rows.

    A shard is written by as many tasks as its rows need, dealt by row, so that a heavy shard is no single task.
    """
    parts = docs.count() // rows_per_file + len(tree)
    salted = docs.withColumn("_shard", shard_of(draw_key(id_col), tree)).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, parts // len(tree)))))
    salted.repartition(parts, "_shard", "_salt").drop("_salt").write.option("maxRecordsPerFile", rows_per_file).partitionBy("_shard").parquet(path)
