"""The trie of conversation prefixes: which conversations open alike, and what storing shared openings once would save.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it. The smallest
member owns the node. A conversation that owns a node owns all deeper nodes on its way too, as members only get
fewer. So its own nodes form one chain, which hangs below a node of an older chain, and the chains are the tree:

1. Every turn is digested, and every prefix by chaining the digests (128 bits of BLAKE2b), in Arrow batches.
2. One aggregation gives the smallest member of every prefix digest that several conversations have (the others own theirs).
3. The first owned depth of all conversations is found by binary search in batched joins with these minima: each round halves
   the prefixes that are undecided. The last owner met on the way down owns the node that the chain hangs from.
4. Chains are aggregated bottom-up: sums over all chains below one are doubled in reach in every round (the sums of the chains
   2^i steps below are added), so that tall trees of chains take a logarithm of rounds.
5. Every chain is expanded into its nodes; sums of the chains that hang from each node run up the chain.

Saved characters need no further pass: the sum over a subtree of (members - 1) * characters of the last text is the
characters of all members from that depth on, less those of the subtree's nodes, and both add up by chains.

Shared openings make hot keys. The minima are aggregated before the shuffle; lookups send the at most ``HOT`` keys that have more
than a ``HOT``-th of the rows by broadcast and shuffle the rest. Conversations that end at one node are joined in id order in
blocks of ``BLOCK`` ids and digested as a stream, as their number has no bound. What one task holds is one conversation,
at some 50 bytes a turn without texts.

Defined cases: rows without a conversation id are left out; null role or text is empty; turns are ordered null first, and rows of
the same turn by role, then by digest; a conversation without turns is a member of the root only; equal conversations share all
nodes, and the smallest id owns them; an empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import BROADCAST_ROWS, cut, store, text_or_empty

HOT = 10_000
BLOCK = 1024
MOST_ROUNDS = 64
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def gather(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, chars). ``rows``: conv_id, turn, role, text."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    turns = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return rows.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))


_PREFIXES = pa.schema([("_c", pa.int64()), ("_keys", pa.list_(pa.binary())), ("_chars", pa.list_(pa.int64()))])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every prefix but the empty one, and the characters of every prefix, the empty one first."""
    for batch in batches:
        keys, chars = [], []
        for turns in batch.column("turns").to_pylist():
            key, total, own, sums = b"", 0, [], [0]
            for turn in turns:
                key = hashlib.blake2b(key + turn["digest"], digest_size=16).digest()
                total += turn["chars"]
                own.append(key)
                sums.append(total)
            keys.append(own)
            chars.append(sums)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(chars, pa.list_(pa.int64()))], schema=_PREFIXES)


def _lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of its row of ``right``, whose ``key`` is unique, null if there is none; ``left`` may have hot keys."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    most = left.count() // HOT + 1
    hot = F.broadcast(cut(left.groupBy(key).count().filter(F.col("count") > most).select(key)))
    few = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return few.unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))


def _search(prefixes: DataFrame, root: int) -> DataFrame:
    """(_c, _from, _parent): the depth of the node that a conversation's chain hangs from, and that node's owner."""
    keys = prefixes.select("_c", F.explode("_keys").alias("_key"))
    minima = cut(keys.groupBy("_key").agg(F.min("_c").alias("_owner"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    state = prefixes.select("_c", F.lit(0).alias("_from"), F.lit(root).cast("long").alias("_parent"), "_keys")
    settled = []
    for _ in range(MOST_ROUNDS):
        settled.append(state.filter(F.size("_keys") == 0).drop("_keys"))
        state = state.filter(F.size("_keys") > 0)
        if state.isEmpty():
            break
        middle = F.floor((F.size("_keys") + 1) / 2).cast("int")
        probed = _lookup(state.withColumn("_key", F.element_at("_keys", middle)), minima, "_key")
        owned = F.coalesce(F.col("_owner"), F.col("_c")) == F.col("_c")
        state = cut(
            probed.select(
                "_c",
                F.when(owned, F.col("_from")).otherwise(F.col("_from") + middle).alias("_from"),
                F.when(owned, F.col("_parent")).otherwise(F.col("_owner")).alias("_parent"),
                F.when(owned, F.slice("_keys", F.lit(1), middle - 1)).otherwise(F.slice("_keys", middle + 1, F.size("_keys"))).alias("_keys"),
            )
        )
    else:
        raise RuntimeError(f"the search did not settle in {MOST_ROUNDS} rounds")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


_SUMS = ("_n", "_leaves", "_all", "_own")


def _sum_up(chains: DataFrame) -> DataFrame:
    """(_c, sums over the chain and all chains below it) of (_c, _jump, values), _jump being the chain it hangs from."""
    now = cut(chains)
    for _ in range(MOST_ROUNDS):
        below = now.filter("_jump is not null")
        if below.isEmpty():
            return now.drop("_jump")
        gained = below.groupBy("_jump").agg(*(F.sum(x).alias(f"{x}+") for x in _SUMS)).withColumnRenamed("_jump", "_c")
        further = below.select(F.col("_c").alias("_jump"), F.col("_jump").alias("_next"))
        jumped = _lookup(below, further, "_jump").drop("_jump").withColumnRenamed("_next", "_jump")
        moved = jumped.unionByName(now.filter("_jump is null"))
        now = cut(moved.join(gained, "_c", "left").select("_c", "_jump", *((F.col(x) + F.coalesce(f"{x}+", F.lit(0))).alias(x) for x in _SUMS)))
    raise RuntimeError(f"the sums did not settle in {MOST_ROUNDS} rounds")


_ENDS = pa.schema([("_c", pa.int64()), ("_d", pa.int64()), ("_sha256", pa.string())])


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows (_c, _d, _ids), whose texts are joined by commas."""
    at, digest = None, None
    for batch in batches:
        out = []
        for c, d, ids in zip(*(batch.column(x).to_pylist() for x in ("_c", "_d", "_ids"))):
            if (c, d) == at:
                digest.update(b",")
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (c, d), hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else ([], [], []), _ENDS)], schema=_ENDS)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, digest.hexdigest()), _ENDS)], schema=_ENDS)


def _ends(chains: DataFrame) -> DataFrame:
    """(_c, _d, _sha256): digest of the conversations that end at a node, for nodes with any."""
    at = F.when(F.col("_full"), F.col("_c")).otherwise(F.col("_parent"))
    ends = chains.select(F.col("_c").alias("_id"), at.alias("_c"), F.col("_len").alias("_d"))
    blocks = ends.groupBy("_c", "_d", F.expr(f"_id div {BLOCK}").alias("_block")).agg(F.array_join(F.sort_array(F.collect_list("_id")).cast("array<string>"), ",").alias("_ids"))
    dealt = blocks.repartition("_c", "_d").sortWithinPartitions("_c", "_d", "_block")
    return dealt.mapInArrow(_digest_ends, "_c long, _d long, _sha256 string")


def trie(gathered: DataFrame) -> DataFrame:
    """One row per node. ``gathered``: (conv_id, turns) as of ``gather``, one row per conversation."""
    prefixes = store(gathered.mapInArrow(_prefixes, "_c long, _keys array<binary>, _chars array<long>"))
    root = prefixes.agg(F.min("_c")).first()[0]
    found = _search(prefixes, 0 if root is None else root)
    sums = prefixes.select("_c", F.size("_keys").cast("long").alias("_len"), F.element_at("_chars", -1).alias("_all"), "_chars")
    is_root = F.col("_c") == F.lit(root)
    chains = found.join(sums, "_c").withColumns({"_full": is_root | (F.col("_len") > F.col("_from")), "_own": F.col("_all") - F.element_at("_chars", F.col("_from") + 1)})
    chains = store(chains.withColumns({"_top": F.when(is_root, 0).otherwise(F.col("_from") + 1).cast("long"), "_parent": F.when(~is_root, F.col("_parent"))}))

    kids = chains.filter("_full and _parent is not null").groupBy(F.col("_parent").alias("_c"), F.col("_from").cast("long").alias("_d")).agg(F.count("*").alias("_kids"))
    last = kids.select("_c", F.col("_d").alias("_len"), F.lit(True).alias("_goes_on"))
    values = chains.join(last, ["_c", "_len"], "left").select(
        "_c", F.col("_parent").alias("_jump"), F.lit(1).cast("long").alias("_n"), (F.col("_full") & F.col("_goes_on").isNull()).cast("long").alias("_leaves"), "_all", "_own"
    )
    summed = _sum_up(values)
    leaf = values.select("_c", F.col("_leaves").alias("_leaf"))

    hanging = summed.join(chains.filter("_parent is not null").select("_c", "_parent", "_from", "_full"), "_c")
    hanging = hanging.groupBy(F.col("_parent").alias("_c"), F.col("_from").cast("long").alias("_d")).agg(
        F.count_if("_full").alias("_kids"), *(F.sum(x).alias(f"{x}+") for x in _SUMS)
    )
    before = F.element_at("_chars", F.greatest(F.col("_d"), F.lit(1)).cast("int"))
    nodes = chains.filter("_full").join(leaf, "_c").select("*", F.explode(F.sequence("_top", "_len")).alias("_d")).select("_c", "_d", "_top", "_len", "_parent", "_all", "_leaf", before.alias("_before"))
    up = Window.partitionBy("_c").orderBy(F.desc("_d"))
    joined = nodes.join(hanging, ["_c", "_d"], "left").join(_ends(chains), ["_c", "_d"], "left")
    run = {f"{x}+": F.sum(F.coalesce(f"{x}+", F.lit(0))).over(up) for x in _SUMS}
    n = F.col("_n+") + 1
    return joined.withColumns(run).select(
        F.col("_c").alias("conv_id"),
        F.col("_d").alias("depth"),
        F.when(F.col("_d") == 0, None).when(F.col("_d") == F.col("_top"), F.col("_parent")).otherwise(F.col("_c")).alias("parent_conv_id"),
        n.alias("n_convs"),
        (F.coalesce("_kids", F.lit(0)) + (F.col("_d") < F.col("_len")).cast("long")).alias("n_children"),
        (F.col("_leaf") + F.col("_leaves+")).alias("n_leaves"),
        (F.col("_all") + F.col("_all+") - n * F.col("_before") - (F.col("_all") - F.col("_before") + F.col("_own+"))).alias("saved_tokens"),
        F.coalesce("_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations in ``rows`` (conv_id, turn, role, text)."""
    return trie(gather(rows))
