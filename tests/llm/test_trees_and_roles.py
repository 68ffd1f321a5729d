"""Sharding tree, prefix trie and role repair against brute force, and their defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfold.llm import hash_tree, prefix_trie, registry, role_repair
from wayfold.llm.hash_tree import Shard

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, shard string, slot string, _id long"
TURNS = "conv_id long, turn long, role string, text string"


def brute_shard(key, tree):
    """The shard by drawing at every level over the shards' paths."""
    for level in range(3):
        weights = defaultdict(float)
        for s in tree:
            weights[s.path(level)] += s.weight

        def draw(path):
            unit = (int(hashlib.md5(f"{key}|{path}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            return -math.log(unit) / weights[path] if weights[path] else math.inf, path

        won = min(map(draw, weights))[1]
        tree = [s for s in tree if s.path(level) == won]
    return tree[0].number


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), "id").alias("text")).cache()


def shards(keys, tree):
    return {r[0]: r[1] for r in keys.select("doc_id", hash_tree.shard_of(hash_tree.draw_key("doc_id"), tree)).collect()}


def test_shards_follow_draws_and_weights(keys):
    tree = hash_tree.reweigh(hash_tree.grow(hash_tree.layout(9), "r0", "k1", 0.5), {2: 3.0, 5: 0.0})
    got = shards(keys, tree)
    assert all(got[i] == brute_shard(i, tree) for i in range(300))
    shares, total = Counter(got.values()), sum(s.weight for s in tree)
    assert shares[5] == 0
    for s in tree:
        assert abs(shares[s.number] / 4000 - s.weight / total) < 4 * math.sqrt(s.weight / total / 4000) + 1e-9


def test_growing_takes_rows_only_into_the_new_shard(keys):
    for start in (8, 9, 12):
        before, after = shards(keys, hash_tree.layout(start)), shards(keys, hash_tree.layout(start + 1))
        moved = [i for i in before if before[i] != after[i]]
        assert {after[i] for i in moved} == {start} and abs(len(moved) / 4000 - 1 / (start + 1)) < 0.03
    inside = hash_tree.grow(hash_tree.layout(8), "r0", "k0")
    after, before = shards(keys, inside), shards(keys, hash_tree.layout(8))
    assert {after[i] for i in before if before[i] != after[i]} == {8}


def test_weights_move_rows_only_through_the_changed_path(keys):
    tree = hash_tree.layout(8)
    before, after = shards(keys, tree), shards(keys, hash_tree.reweigh(tree, {3: 2.0}))
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moved
    for a, b in moved:  # shard 3 stands in rack 1 (shards 2, 3) of region 0 (shards 0 to 3)
        assert b == 3 or (a, b) in {(2, 3)} or (a > 3 and b < 4) or (a < 2 and b in (2, 3))


def test_assignment_of_odd_rows(spark):
    rows = [(1, "a", "x", "y", 5), (1, "a", "x", "y", 6), (1, "é" * 3, None, None, None), (None, None, "s", "t", 1), (None, "", "s", "t", 1), (7, "l" * 3_000_000, "", "", 0), (-3, None, "", "", 0)]
    rows += [(None, "same", "", "", 0)] * 300
    out = hash_tree.assign(spark.createDataFrame(rows, DOCS), hash_tree.layout(8), hash_tree.layout(9)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = defaultdict(list)
    for r in out:
        assert r.shard == brute_shard("null" if r.doc_id is None else r.doc_id, hash_tree.layout(8)) and r.grown_shard in (r.shard, 8)
        by[r.shard].append(r)
    for members in by.values():
        members.sort(key=lambda r: r.slot)
        assert [r.slot for r in members] == list(range(len(members)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in members]
        assert order == sorted(order)
    assert hash_tree.assign(spark.createDataFrame([], DOCS), hash_tree.layout(8)).collect() == []
    with pytest.raises(ValueError):
        hash_tree.shard_of(F.lit("k"), [Shard(0, "r", "k", 0.0)])


def test_slots_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "TASK_ROWS", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = hash_tree.assign(docs.unionByName(docs), hash_tree.layout(8)).collect()
    for n in range(8):
        members = sorted((r.slot, r.doc_id) for r in out if r.shard == n)
        assert [s for s, _ in members] == list(range(len(members))) and [i for _, i in members] == sorted(i for _, i in members)


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hash_tree.write_shards(docs, str(tmp_path / "out"), hash_tree.layout(8), rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.drop("_shard").collect())) == Counter(map(tuple, docs.collect()))
    assert all(r._shard == brute_shard(r.doc_id, hash_tree.layout(8)) for r in back.select("doc_id", "_shard").collect())


def brute_trie(talks):
    """``talks``: id to list of (role, text). Rows as of the operator."""
    members = defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[tuple(talks[c][:d])].append(c)
    rows = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = ",".join(str(c) for c in own if len(talks[c]) == len(path))
        rows.append(
            (own[0], len(path), min(members[path[:-1]]) if path else None, len(own), sum(q[:-1] == path for q in members if q), len(leaves))
            + (sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def talk_rows(talks):
    return [(c, i, role, text) for c, turns in talks.items() for i, (role, text) in enumerate(turns)]


def random_talks(seed, n, most):
    draw = random.Random(seed)
    return {c: [(draw.choice("ua"), draw.choice(["", "x", "yé"])) for _ in range(draw.randint(0, most))] for c in draw.sample(range(-50, 400), n)}


@pytest.mark.parametrize("talks", [random_talks(1, 60, 5), {c: [("u", f"t{i}") for i in range(c)] for c in range(40)}, {c: [("u", "same"), ("a", "same")] for c in range(30)}, {5: []}, {5: [], 3: []}])
def test_trie_against_brute_force(spark, talks):
    gathered = prefix_trie.gather(spark.createDataFrame(talk_rows(talks) + [(None, 0, "u", "x")], TURNS))
    empty = spark.createDataFrame([(c, []) for c in talks if not talks[c]], gathered.schema)
    out = prefix_trie.trie(gathered.unionByName(empty)).collect()
    assert sorted(map(tuple, out), key=str) == brute_trie(talks)


def test_trie_with_hot_keys_and_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    talks = random_talks(2, 50, 4)
    talks |= {1000 + i: [("u", "x")] for i in range(20)}
    gathered = prefix_trie.gather(spark.createDataFrame(talk_rows(talks), TURNS))
    empty = spark.createDataFrame([(c, []) for c in talks if not talks[c]], gathered.schema)
    assert sorted(map(tuple, prefix_trie.trie(gathered.unionByName(empty)).collect()), key=str) == brute_trie(talks)


def test_trie_of_nulls_ties_and_nothing(spark):
    rows = [(1, None, None, None), (1, 2, "u", "b"), (1, 2, "u", "b"), (1, 0, "a", None), (2, 5, "", ""), (2, 6, "a", "")]
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 9) for r in rows], TURNS + ", _c int")).collect()
    talks = {1: [("", ""), ("a", ""), ("u", "b"), ("u", "b")], 2: [("", ""), ("a", "")]}
    assert sorted(map(tuple, got), key=str) == brute_trie(talks)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_lent_openings(spark):
    talks = {c: [("u" if i % 2 else "a", f"{c}-{i}") for i in range(1 + c % 7)] for c in [*range(95, 130), 200, 341]}
    lent = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        lent[c] = talks.get(c - c % 100, [])[:h] + own[h:]
    gathered = registry.lend_openings(prefix_trie.gather(spark.createDataFrame(talk_rows(talks), TURNS)))
    assert sorted(map(tuple, prefix_trie.trie(gathered).collect()), key=str) == brute_trie(lent)


def faults(rows):
    """(must go, truncated) of every (turn, role, text) and the counts."""
    out, seen, counts = [], set(), Counter()
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        out.append((fault in ("blank", "duplicate"), fault == "truncated"))
    return out, counts


def brute_repair(rows):
    """Every sequence of edits with up to 2 n // 5 insertions, as no optimum has more."""
    marks, counts = faults(rows)
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and must for e, (must, _) in zip(edits, marks)):
            continue
        for inserts in range(2 * len(rows) // 5 + 1):
            for at in itertools.combinations(range(len(rows) + inserts), inserts):
                rest, audit = iter(zip(edits, rows, marks)), []
                cost, told, roles = 0, [], ""
                for i in range(len(rows) + inserts):
                    wanted = "a" if roles[-1:] == "u" else "u"
                    if i in at:
                        audit, cost, told, roles = [*audit, "I"], cost + 5, [*told, (role_repair.ROLES[wanted], "")], roles + wanted
                        continue
                    edit, (_, role, text), (_, truncated) = next(rest)
                    audit.append(edit)
                    cost += {"D": 2, "K": 0, "R": 1}[edit] + 5 * (truncated and edit != "D")
                    if edit != "D":
                        role = role if edit == "K" else role_repair.ROLES[wanted]
                        told, roles = [*told, (role, text)], roles + (role[:1] or "-")
                if re.fullmatch("(s?(ua)+)?", roles):
                    found = cost, "".join(audit), hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
                    best = found if best is None else min(best, found)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, *best)


def test_repair_against_brute_force(spark):
    draw = random.Random(3)
    talks, rows = {}, []
    for c in range(400):
        own = []
        for _ in range(draw.randint(1, 5 if c < 340 else 6)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sage"])
            text = draw.choice(["a.", "b", "c!", "d? ", "e.\t", "f", " \n", "", None])
            own.append((draw.choice([None, 0, 1, 2, 3, 7]), role, text))
        talks[c] = sorted([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in own], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        rows += [(c, *x) for x in own]
    draw.shuffle(rows)
    out = {r[0]: tuple(r[1:]) for r in role_repair.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert len(out) == 400
    for c, own in talks.items():
        assert out[c] == brute_repair(own), (c, own)


def test_repair_of_long_and_empty_talks(spark):
    long = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(3000) if i != 1501] + [(1, 10, "user", "t10."), (2, 0, "user", "x" * 2_000_000 + ".")]
    rows = spark.createDataFrame([(*x, "clash", 1) for x in long], TURNS + ", _text string, gaps int")
    ids = spark.createDataFrame([(1,), (5,), (5,), (None,)], "conv_id long")
    out = {r[0]: tuple(r[1:]) for r in role_repair.repair(rows, ids).collect()}
    assert out[5] == out[None] == (0, 0, 0, 0, 0, 0, "", prefix_trie.EMPTY_SHA256)
    gaps, blank, duplicate, truncated, illegal, cost, audit, _ = out[1]
    assert (gaps, blank, duplicate, truncated, illegal) == (1, 0, 1, 0, 2) and cost == 4 and audit.count("D") == 2 and len(audit) == 3000
    assert out[2][5:7] == (2, "D")
    assert role_repair.repair(spark.createDataFrame([], TURNS)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", ""), (1, 2, "tool", "c."), (1, 3, "user", "d."), (2, 0, "assistant", "x."), (2, 1, "user", "y.")]
    out = role_repair.repaired_turns(spark.createDataFrame(rows, TURNS)).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, "K", "user", "a."), (1, 1, 3, "R", "assistant", "d."), (2, 0, 0, "R", "user", "x."), (2, 1, 1, "R", "assistant", "y.")]


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(30) for t, r, x in [(0, "user", "a. b!"), (1, None, None), (None, "assistant", "c?")]]
    expected = Counter()
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if fault:
            expected[(c, t, "user" if fault == 4 else r, "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x)] += 2 if fault == 3 else 1
    assert Counter(map(tuple, registry.damage(spark.createDataFrame(rows, TURNS)).collect())) == expected
