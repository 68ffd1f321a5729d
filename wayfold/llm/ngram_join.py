"""Near duplicates: an exact Jaccard join of shingle sets by token-combination prefixes.

A text's tokens are the hashes of its distinct word 5-grams. Sets x and y link when
100 * |x & y| >= 75 * |x | y|. All sets are ordered alike, rare tokens first, frequent tokens last,
and every set is indexed by signatures of its prefix:

* a rare token is a signature by itself;
* frequent tokens form groups, and every pair of tokens of a group is a signature, so that one very
  common passage alone makes no candidates;
* the prefix is extended until it covers floor(|x| / 4) + 1, where a rare token counts 1 and a group
  with l tokens of the prefix counts l - 1. At most floor(|x| / 4) tokens of x are missing in a
  linked y. So one rare token or two tokens of one group are left, and as both prefixes are
  contiguous in the common order they are in the other prefix too: linked sets share a signature.

The number of groups follows the size of the set (one per 8 tokens). So that both sides of a pair
use the same groups, sizes fall into overlapping bands of ratio 1.34 and pair signatures are made
per band; sets whose sizes differ by more than 4 / 3 can't link.

Which tokens are frequent only affects speed. It is counted over all texts: exactly for the tokens whose
hash is among the lowest ``COUNTED`` of all values (rare tokens are ordered by hash, so a prefix of rare tokens
ends there), and by lossy counting for the rest: tasks report tokens that are common in the task, and a token
common overall is common in some task. The at most ``FREQUENT_TOKENS`` most common are sent to the tasks.

Equal sets are one node, so copies cost nothing after hashing. Candidates are verified in rounds. In each of
the first ``STAR_ROUNDS`` every node is compared with one node of another component, namely the one, of the
leaders of its signatures' groups, that it shares most with. A group's leader is its node with the fewest rare tokens, which
is close to the text that the others were copied from; in later rounds it is a random one. The last round takes
all pairs that share a signature across different components. Pairs inside a component can't change it, so
no group of near copies is expanded into all its pairs.

Texts with a large common part share many signatures, so the last round merges groups of a kind with the same lowest
and highest node: a pair then meets once or a few times instead of once a signature. Pairs are ruled out before sets
are compared, by exact bounds. Sizes must be within 4 / 3. With prefixes of p and q rare tokens of which at most c are common,
all further common tokens follow the prefix that ends first, so |x & y| is at most c + max(|x| - p, |y| - q). Where the prefix
needs frequent tokens it holds all rare tokens of a set, u in x and v in y: pairs without a common rare token have |x & y| of
at most min(|x| - u, |y| - v), and pairs with one meet at that token's signature. And nodes with signatures of pairs have a parity
map of ``MAP_BITS`` bits, of which each token flips one: two maps differ in at most as many bits as the sets in tokens,
while linked sets differ in at most (|x| + |y|) / 7 tokens. What is left are links and pairs just below the similarity.

Defined cases: null and empty texts have no tokens, n_shingles 0, and are linked with nothing; a text
of 1 to 4 words has one token, its whole word sequence; repeated rows link with each other; a row with
a null id is linked with equal texts only and gets their smallest id, null if there is none. Words are compared after
lowering A-Z. Tokens are 64-bit hashes; nodes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm import arrays
from wayfold.llm.common import broadcast_if_small, cut, store, tight
from wayfold.llm.components import connected_components

WORDS = 5
#: Similarity as a fraction of integers.
LEAST, OF = 75, 100
#: Number of texts from which a token is frequent, most such tokens that are used, and the share of hash values counted exactly.
FREQUENT_LEAST, FREQUENT_TOKENS, COUNTED = 16, 1 << 20, 0.3
#: Share of a task's texts, and number, from which the task reports a token.
REPORT_SHARE, REPORT_LEAST = 0.0005, 4
#: Tokens that a task gathers before it drops those it saw once, and before it hands on those that are counted exactly.
GATHERED, HANDED_ON = 1 << 20, 1 << 17
#: Bytes of text that are hashed at a time, and rows and bytes of sets of a batch that a task hands on. Hashing takes many times the
#: bytes of its texts, beside the batch of 10,000 texts that Spark hands to the worker.
TEXT_BYTES, BATCH_ROWS, BATCH_BYTES = 1 << 18, 1 << 15, 1 << 20
BAND = 1.34
#: Rounds of comparisons with leaders, and the least share of a node's tokens that it then has in common with its leader as signatures.
STAR_ROUNDS = 3
FIRST_SHARE = 0.1
TOKENS_PER_GROUP = 8
#: Bits of a parity map; a map is so many words of 64 bits.
MAP_BITS = 1024
MAP_WORDS = MAP_BITS // 64
#: Rows of a group from which pairs are made block by block, and digests that may share their first half.
BLOCK_ROWS, MOST_CLASHES = 1_000, 1_000
#: Nodes up to which the list of texts to compare is broadcast.
BROADCAST_NODES = 500_000

_U = np.uint64
_STEPS = [_U(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(WORDS)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of every text, in order."""
    for first, end, data, offsets in arrays.slices(texts, TEXT_BYTES):
        data = arrays.lower_ascii(data)
        starts, ends, owner = arrays.words(data, offsets)
        hashed = arrays.span_hash(arrays.prefix_hash(data), starts, ends)
        grams = np.zeros(0, np.uint64)
        if hashed.size >= WORDS:
            n = hashed.size - WORDS + 1
            grams = np.zeros(n, np.uint64)
            for k, step in enumerate(_STEPS):
                grams += arrays.mix(hashed[k : k + n] + step)
            grams = arrays.mix(grams)
        edges = np.searchsorted(owner, np.arange(end - first + 1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo >= WORDS:
                yield np.unique(grams[lo : hi - WORDS + 1])
            elif hi > lo:
                short = sum((int(h) * (0xD6E8FEB86659FD93 + 2 * k) for k, h in enumerate(hashed[lo:hi])), start=int(hi - lo))
                yield arrays.mix(np.array([short % (1 << 64)], np.uint64))
            else:
                yield grams[:0]


def _halves(tokens: np.ndarray) -> tuple[int, int]:
    """A set's digest of 128 bits as two numbers."""
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class _Naming:
    """Names a set's node by the first half of its digest, or by the second if different sets have the same first half."""

    def __init__(self, clashes: frozenset[int]):
        self.clashes = clashes

    def __call__(self, tokens: np.ndarray) -> int:
        first, second = _halves(tokens)
        return second if first in self.clashes else first


_SCAN = pa.schema([("_id", pa.int64()), ("_n", pa.int64()), ("_first", pa.int64()), ("_second", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and both halves of the digest of every text."""
    for batch in batches:
        n, halves = [], []
        for tokens in shingle_sets(batch.column("_text")):
            n.append(tokens.size)
            halves.append(_halves(tokens))
        first, second = zip(*halves) if halves else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(x, pa.int64()) for x in (n, first, second))], schema=_SCAN)


def _named(scanned: DataFrame) -> tuple[DataFrame, _Naming]:
    """(_id, _n, _node) and the naming; the first halves that different sets share are few (a handful among 10^10 sets) and go to the driver."""
    halves = scanned.groupBy("_first").agg(F.min("_second").alias("_low"), F.max("_second").alias("_high")).filter("_low <> _high")
    clashes = [r[0] for r in halves.select("_first").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError(f"more than {MOST_CLASHES} clashes of 64-bit digests")
    name = F.when(F.col("_first").isin(clashes), F.col("_second")).otherwise(F.col("_first")) if clashes else F.col("_first")
    return scanned.select("_id", "_n", name.alias("_node")), _Naming(frozenset(clashes))


_COUNTS = pa.schema([("_token", pa.int64()), ("_count", pa.int64())])


def _merged(tokens: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens, sorted, and the sums of their counts. The lists are emptied, as large ones would be held twice."""
    joined = []
    for parts in (tokens, counts):
        joined.append(np.concatenate(parts))
        parts.clear()
    if not joined[0].size:
        return joined[0], joined[1]
    order = np.argsort(joined[0])
    counts, tokens = joined.pop()[order], joined.pop()[order]
    del order
    firsts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return tokens[firsts], np.add.reduceat(counts, firsts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the tokens below the counted share, and of other tokens that are common in the task, by texts."""
    limit = _U(int(COUNTED * 2**64))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    low, high = [[none[0]], [none[1]]], [[none[0]], [none[1]]]
    held = [0, 0]
    rows = 0

    def told(tokens: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, tokens.size, BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(tokens[k : k + BATCH_ROWS].view(np.int64)), pa.array(counts[k : k + BATCH_ROWS].astype(np.int64))], schema=_COUNTS)

    for batch in batches:
        for tokens in shingle_sets(batch.column("_text")):
            rows += 1
            cut_at = int(np.searchsorted(tokens, limit))
            for k, (part, kept) in enumerate(((tokens[:cut_at], low), (tokens[cut_at:], high))):
                kept[0].append(part.copy())  # a view would keep the other part too
                kept[1].append(np.ones(part.size, np.int32))
                held[k] += part.size
            if held[0] > HANDED_ON:
                yield from told(*_merged(*low))
                low, held[0] = [[none[0]], [none[1]]], 0
            if held[1] > GATHERED:
                tokens, counts = _merged(*high)
                high = [[tokens[counts > 1]], [counts[counts > 1]]]
                held[1] = high[0][0].size
    yield from told(*_merged(*low))
    tokens, counts = _merged(*high)
    common = counts >= max(REPORT_LEAST, REPORT_SHARE * rows)
    yield from told(tokens[common], counts[common])


def _pair_signatures(rare: int, frequent: np.ndarray, need: int, band: int) -> list[int]:
    """Signatures of the pairs of frequent tokens (in the common order) that the extended prefix needs in a band."""
    groups = max(1, int(BAND**band) // TOKENS_PER_GROUP)
    of = (frequent % _U(groups)).tolist()
    held: dict[int, list[int]] = {}
    covered, pairs = rare, []
    for g, token in zip(of, frequent.tolist()):
        if covered >= need:
            break
        earlier = held.setdefault(g, [])
        covered += bool(earlier)
        pairs += [(other, token) for other in earlier]
        earlier.append(token)
    if not pairs:
        return []
    a = np.array(pairs, np.uint64)
    return arrays.mix(arrays.mix(a[:, 0] + _U(band + 1)) + a[:, 1]).view(np.int64).tolist()


_SIGNED = pa.schema([("_sig", pa.int64()), ("_node", pa.int64()), ("_n", pa.int64()), ("_r", pa.int64())])


def _signer(frequent_tokens, naming: _Naming):
    """Signatures of every text; ``frequent_tokens`` is a broadcast (sorted tokens, their ranks by count).

    _r is the number of rare tokens for signatures of pairs; for single tokens it is -1 - the prefix's length, -1 if
    the prefix holds frequent tokens too.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = frequent_tokens.value
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            held = 0

            def flush() -> pa.RecordBatch:
                lengths = [x.size for x in rows[0]]
                out = [np.concatenate(rows[0]) if rows[0] else np.zeros(0, np.int64), *(np.repeat(np.array(x, np.int64), lengths) for x in rows[1:])]
                return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=_SIGNED)

            for tokens in shingle_sets(batch.column("_text")):
                n = tokens.size
                if n < 2:
                    continue
                need = n - -(-LEAST * n // OF) + 1
                rare, ranks = tokens, None
                if common.size:
                    at = np.minimum(np.searchsorted(common, tokens), common.size - 1)
                    is_common = common[at] == tokens
                    if is_common.any():
                        rare, ranks = tokens[~is_common], rank[at[is_common]]
                node, alone = naming(tokens), rare.size >= need
                made = [(rare[:need].view(np.int64), -1 - need if alone else -1)]
                if not alone:
                    frequent = tokens[is_common][np.argsort(ranks)]
                    band = int(math.log(n) / math.log(BAND))
                    pairs = [x for b in (band - 1, band) for x in _pair_signatures(rare.size, frequent, need, b)]
                    made.append((np.array(pairs, np.int64), rare.size))
                for sig, rares in made:
                    for column, x in zip(rows, (sig, node, n, rares)):
                        column.append(x)
                    held += sig.size
                if held > BATCH_ROWS:
                    yield flush()
                    rows, held = [[], [], [], []], 0
            yield flush()

    return sign


_SETS = pa.schema([("_node", pa.int64()), ("_set", pa.binary())])


def _sets(naming: _Naming):
    """Sets of all texts by node."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, held = [], [], 0
            for tokens in shingle_sets(batch.column("_text")):
                nodes.append(naming(tokens))
                sets.append(tokens.tobytes())
                held += tokens.nbytes
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], schema=_SETS)
                    nodes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], schema=_SETS)

    return sets_of


_MAPS = pa.schema([("_node", pa.int64()), *((f"_m{k}", pa.int64()) for k in range(MAP_WORDS))])


def _maps(batches: Iterator[pa.RecordBatch], naming: _Naming = _Naming(frozenset())) -> Iterator[pa.RecordBatch]:
    """Parity map of every text's tokens, by their high bits."""
    for batch in batches:
        nodes, maps = [], np.zeros((batch.num_rows, MAP_WORDS), np.uint64)
        for row, tokens in enumerate(shingle_sets(batch.column("_text"))):
            nodes.append(naming(tokens))
            odd = np.bincount((tokens >> _U(32)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) % 2 == 1
            maps[row] = np.packbits(odd).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *(pa.array(x.view(np.int64)) for x in maps.T.copy())], schema=_MAPS)


_LINKS = pa.schema([("_a", pa.int64()), ("_b", pa.int64())])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (_a, _b, _set_a, _set_b) whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("_set_a"), batch.column("_set_b")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(OF * shared >= LEAST * (x.size + y.size - shared))
        kept = batch.select(["_a", "_b"]).filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns, schema=_LINKS)


def _texts(docs: DataFrame, nodes: DataFrame, texts_of: DataFrame) -> DataFrame:
    """One text (_text) for each of the distinct ``nodes``. ``texts_of``: (_node, _rep), the row that stands for a node."""
    chosen = broadcast_if_small(cut(texts_of.join(nodes, "_node").select("_rep")), BROADCAST_NODES)
    return docs.join(chosen, docs["_id"] == chosen["_rep"], "left_semi").select("_text")


def _verify(pairs: DataFrame, docs: DataFrame, texts_of: DataFrame, naming: _Naming) -> DataFrame:
    """The pairs (_a, _b) that link. Sets go to their pairs if these are few enough to be broadcast, else both are shuffled."""
    involved = broadcast_if_small(pairs.select(F.explode(F.array("_a", "_b")).alias("_node")).distinct(), BROADCAST_NODES)
    sets = store(_texts(docs, involved, texts_of).mapInArrow(_sets(naming), "_node long, _set binary"))
    asked = broadcast_if_small(pairs, BROADCAST_NODES)
    a, b = asked.join(sets.toDF("_a", "_set_a"), "_a"), asked.join(sets.toDF("_b", "_set_b"), "_b")
    return a.join(b, ["_a", "_b"]).select("_a", "_b", "_set_a", "_set_b").mapInArrow(_linked, "_a long, _b long")


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent tokens and their ranks, most common last: at most ``FREQUENT_TOKENS``."""
    counted = rows.select("_text").mapInArrow(_count, "_token long, _count long").groupBy("_token").agg(F.sum("_count").alias("_count"))
    found = counted.filter(F.col("_count") >= FREQUENT_LEAST).orderBy(F.desc("_count"), "_token").limit(FREQUENT_TOKENS).toArrow()
    tokens = found.column("_token").to_numpy().astype(np.int64).view(np.uint64)
    by_count = np.lexsort((tokens, found.column("_count").to_numpy()))
    rank = np.empty(tokens.size, np.int64)
    rank[by_count] = np.arange(tokens.size)
    order = np.argsort(tokens)
    del found
    pa.default_memory_pool().release_unused()
    return tokens[order], rank[order].astype(np.int32)


def _enough(overlap: Column, x: str, y: str) -> Column:
    """Whether an overlap of sets with so many tokens makes them link."""
    return (OF + LEAST) * overlap >= LEAST * (F.col(x) + F.col(y))


def _may_link(x: str, y: str, rx: str, ry: str) -> Column:
    """Whether sizes, and for signatures of pairs the rare tokens, leave it possible that two sets link."""
    close = (F.col(x) * LEAST <= F.col(y) * OF) & (F.col(y) * LEAST <= F.col(x) * OF)
    return close & ((F.col(rx) < 0) | _enough(F.least(F.col(x) - F.col(rx), F.col(y) - F.col(ry)), x, y))


def _open_rows(shared: DataFrame, rows: int, labels: DataFrame | None, number: int) -> DataFrame:
    """Signatures with their node's component _label, their group's _key and leader _l, only of groups with several components.

    Groups of a kind (single tokens, pairs) with the same lowest and highest node have the same key. The leader has the
    fewest rare tokens of its group in the first round, later the least hash that the round seeds.
    """
    named = shared.withColumn("_label", F.col("_node"))
    if labels is not None:
        named = shared.join(broadcast_if_small(labels, BROADCAST_NODES), "_node", "left").select(*shared.columns, F.coalesce("_label", "_node").alias("_label"))
    key = F.xxhash64(F.min("_node"), F.max("_node"), F.max("_r") < 0).alias("_key")
    fewest = F.when((F.col("_r") >= 0) & F.lit(number == 0), F.col("_r")).alias("f")
    lead = F.struct(fewest, F.xxhash64("_node", F.lit(number)).alias("h"), "_node", "_n", "_r", "_label")
    groups = named.groupBy("_sig").agg(F.min("_label").alias("_low"), F.max("_label").alias("_high"), key, F.min(lead).alias("_l")).filter("_low <> _high")
    groups = cut(tight(groups.select("_sig", "_key", "_l"), rows))
    return named.join(broadcast_if_small(groups), "_sig")


def _star_pairs(open_rows: DataFrame, rows: int) -> DataFrame:
    """(_a, _b): for each node the leader of another component that it shares most with."""
    led = open_rows.select("_node", "_n", "_r", "_label", F.col("_l._node").alias("_leader"), F.col("_l._n").alias("_ln"), F.col("_l._r").alias("_lr"), F.col("_l._label").alias("_ll"))
    weight = F.when(F.col("_r") < 0, 1.0).otherwise(FIRST_SHARE * F.col("_n"))
    near = led.filter("_label <> _ll").filter(_may_link("_n", "_ln", "_r", "_lr")).groupBy("_leader", "_node", "_n").agg(F.sum(weight).alias("_c")).filter(F.col("_c") >= FIRST_SHARE * F.col("_n"))
    best = tight(near, rows).groupBy(F.col("_node").alias("_b")).agg(F.max_by("_leader", F.struct("_c", "_leader")).alias("_a"))
    return tight(tight(best, rows).select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), rows)


def _meetings(rows: DataFrame) -> DataFrame:
    """Pairs of rows with the same _key, different components and sizes that allow a link; columns end in a and b.

    The rows of a large group fall into blocks by node, and every row goes to the pairs of its block with each block, so that
    no task makes the pairs of more than a block with a block.
    """
    sizes = rows.groupBy("_key").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > BLOCK_ROWS)
    blocks = F.coalesce(F.ceil(F.col("_rows") / BLOCK_ROWS), F.lit(1)).cast("int")
    dealt = rows.join(broadcast_if_small(cut(sizes)), "_key", "left").withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    names = [c for c in rows.columns if c != "_key"]
    left, right = (dealt.select("_key", *(F.col(c).alias(x) for c, x in zip(("_own", "_other"), at)), *(F.col(c).alias(c + k) for c in names)) for k, at in (("a", ("_i", "_j")), ("b", ("_j", "_i"))))
    return left.join(right, ["_key", "_i", "_j"]).drop("_i", "_j").filter("_nodea < _nodeb and _labela <> _labelb").filter(_may_link("_na", "_nb", "_ra", "_rb"))


def _all_pairs(open_rows: DataFrame, rows: int, docs: DataFrame, texts_of: DataFrame, naming: _Naming) -> DataFrame:
    """(_a, _b): nodes of different components that share a signature and pass the bounds."""
    merged = store(tight(open_rows.groupBy("_key", "_node", "_n", "_r", "_label").agg(F.count("*").alias("_c")), rows))
    single = tight(_meetings(merged.filter("_r < 0")), rows).groupBy("_nodea", "_nodeb", "_na", "_nb", "_ra", "_rb").agg(F.sum(F.least("_ca", "_cb")).alias("_c"))
    beyond = F.greatest(F.col("_na") + F.col("_ra"), F.col("_nb") + F.col("_rb")) + 1
    single = single.filter((F.col("_ra") == -1) | (F.col("_rb") == -1) | _enough(F.col("_c") + beyond, "_na", "_nb"))

    of_pairs = merged.filter("_r >= 0").drop("_c")
    # Written before it is joined with few rows in few partitions, so that texts are read in as many as they have.
    maps = store(_texts(docs, of_pairs.select("_node").distinct(), texts_of).mapInArrow(lambda batches: _maps(batches, naming), ", ".join(f"{f.name} long" for f in _MAPS)))
    differ = sum((F.bit_count(F.col(f"_m{k}a").bitwiseXOR(F.col(f"_m{k}b"))) for k in range(MAP_WORDS)), F.lit(0))
    double = _meetings(store(tight(of_pairs.join(maps, "_node"), rows))).filter((OF + LEAST) * differ <= (OF - LEAST) * (F.col("_na") + F.col("_nb")))
    met = [tight(x, rows).select(F.col("_nodea").alias("_a"), F.col("_nodeb").alias("_b")) for x in (single, double)]
    return met[0].unionByName(met[1]).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    nodes, naming = _named(cut(rows.mapInArrow(_scan, "_id long, _n long, _first long, _second long")))
    texts_of = nodes.filter("_n > 1 and _id is not null").groupBy("_node").agg(F.min("_id").alias("_rep"))
    texts_of = cut(tight(texts_of, nodes.count()))
    frequent = spark.sparkContext.broadcast(_frequent(rows))

    signed = rows.filter("_id is not null").select("_text").mapInArrow(_signer(frequent, naming), "_sig long, _node long, _n long, _r long")
    # A rare token has few nodes, and a window finds those with several in one shuffle. Pairs of frequent tokens may be those of a third
    # of all texts: they are aggregated before the shuffle, and their rows are joined with what is left.
    every = Window.partitionBy("_sig")
    single = signed.filter("_r < 0").withColumns({"_low": F.min("_node").over(every), "_high": F.max("_node").over(every)}).filter("_low <> _high").drop("_low", "_high")
    paired = store(signed.filter("_r >= 0"))
    several = cut(paired.groupBy("_sig").agg(F.min("_node").alias("_low"), F.max("_node").alias("_high")).filter("_low <> _high").select("_sig"))
    double = paired.join(broadcast_if_small(several, BROADCAST_NODES), "_sig", "left_semi")
    shared = store(single.unionByName(double).distinct())
    frequent.destroy()
    many = shared.count()

    links, tried, labels = None, None, None
    for number in range(STAR_ROUNDS + 1):
        open_rows = _open_rows(shared, many, labels, number)
        pairs = _all_pairs(open_rows, many, rows, texts_of, naming) if number == STAR_ROUNDS else _star_pairs(open_rows, many)
        pairs = cut(pairs if tried is None else pairs.join(broadcast_if_small(tried, BROADCAST_NODES), ["_a", "_b"], "left_anti"))
        pairs = tight(pairs, pairs.count())
        found = cut(_verify(pairs, rows, texts_of, naming))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if found.isEmpty() and labels is not None:
            continue
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)

    labelled = cut(nodes.join(broadcast_if_small(labels, BROADCAST_NODES), "_node", "left").select("_id", "_n", F.coalesce("_label", "_node").alias("_label")))
    linked = labelled.filter("_n > 0")
    smallest = broadcast_if_small(linked.groupBy("_label").agg(F.min("_id").alias("_first")), BROADCAST_NODES)
    return (
        linked.join(smallest, "_label")
        .select("_id", "_n", "_first")
        .unionByName(labelled.filter("_n = 0").select("_id", "_n", F.col("_id").alias("_first")))
        .select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_first").alias("component_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of every component (all rows of that id), and rows without an id."""
    out = near_duplicates(docs, id_col, text_col)
    dropped = cut(out.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_dropped")).distinct())
    dropped = broadcast_if_small(dropped, BROADCAST_NODES)
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
