"""Repair of conversation structure by error-correcting Earley parsing over the roles of a conversation's rows.

The grammar (``GRAMMAR``) derives an optional system turn and pairs of a user and an assistant turn, or nothing. Besides matching a
terminal, the parser has weighted error productions: delete a row, match a row as another role, insert a turn
of empty text. A chart item keeps the least (cost, audit) that leads to it, the audit being the initials of the edits in
order; the complete item of the last column yields the repair. Of equally cheap audits the least by ASCII wins.

All recursion of the grammar is on the left, so every item begins in column 0. A column therefore has a fixed number of items and
only column 0's waiting items and the newest column are held. Letters that the audits of all items begin with are settled: they
are applied to the rows that wait for them at once. What is left of a column is small and recurs, so that the step from
column to column is computed once for each (column, kind of row) and looked up after that.

Spark deals the rows by conversation and sorts them; a task reads them as a stream and holds the rows that wait for a
decision and a 16-byte digest of each different (role, text) of one conversation.

Faults of a row, the first of which counts: ``blank``, text without a character other than space and the controls 9 to 13;
``duplicate``, role and text stood in an earlier row; ``truncated``, the last such character is none of ``.!?``. Blank and duplicate
rows must be deleted, truncated rows cost ``TRUNCATED`` more unless they are deleted.

Defined cases: null role or text is one space; rows are ordered by turn (null first), then role, then text; rows without a
conversation id make one conversation of their own; a role counts by its first letter, and any but s, u, a must be
deleted or renamed; a conversation without rows (see ``ids``) has zeros, an empty audit and the digest of empty text; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Productions by nonterminal, the start symbol first; terminals are initials of roles. Nonterminals stand only in front.
GRAMMAR = {"talk": [(), ("pairs",)], "pairs": [("head", "u", "a"), ("pairs", "u", "a")], "head": [(), ("s",)]}
ROLES = {"u": "user", "a": "assistant"}
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"

_START = next(iter(GRAMMAR))
_RULES = [(left, right) for left, rights in GRAMMAR.items() for right in rights]
#: A column: ((rule, dot), cost, audit) of each item, sorted.
Column = tuple[tuple[tuple[int, int], int, str], ...]


def _closed(seeds: list[tuple[int, str, tuple[int, int]]], waiting: dict[str, list[tuple[int, int]]]) -> dict[tuple[int, int], tuple[int, str]]:
    """The items that ``seeds`` lead to in their column by predicting, completing and inserting, each with its least (cost, audit)."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    queue = sorted(seeds)
    while queue:
        cost, audit, item = heapq.heappop(queue)
        if item in best:
            continue
        best[item] = cost, audit
        left, right = _RULES[item[0]]
        if item[1] == len(right):
            for rule, dot in waiting.get(left, ()):
                heapq.heappush(queue, (cost, audit, (rule, dot + 1)))
        elif (symbol := right[item[1]]) in ROLES:
            heapq.heappush(queue, (cost + INSERT, audit + "I", (item[0], item[1] + 1)))
    return best


def _first_column() -> tuple[Column, dict[str, list[tuple[int, int]]]]:
    """Column 0, and its items that wait for a nonterminal, by that nonterminal."""
    reached, predicted = [_START], []
    for left in reached:
        for rule, (name, right) in enumerate(_RULES):
            if name == left:
                predicted.append((0, "", (rule, 0)))
                reached += [right[0]] if right and right[0] in GRAMMAR and right[0] not in reached else []
    waiting: dict[str, list[tuple[int, int]]] = {}
    for _, _, (rule, _) in predicted:
        right = _RULES[rule][1]
        if right and right[0] in GRAMMAR:
            waiting.setdefault(right[0], []).append((rule, 0))
    return _column(_closed(predicted, waiting)), waiting


def _column(best: dict[tuple[int, int], tuple[int, str]]) -> Column:
    return tuple(sorted((item, cost, audit) for item, (cost, audit) in best.items()))


_FIRST, _WAITING = _first_column()


@lru_cache(1 << 14)
def _step(column: Column, initial: str, must_go: bool, truncated: bool) -> tuple[int, str, Column]:
    """The column after one more row, its least cost and settled letters taken off: (cost, letters, column)."""
    seeds = []
    for item, cost, audit in column:
        rule, dot = item
        left, right = _RULES[rule]
        symbol = right[dot] if dot < len(right) else ""
        if symbol in GRAMMAR or not symbol and left != _START:
            continue
        seeds.append((cost + DELETE, audit + "D", item))
        if symbol and not must_go:
            extra = TRUNCATED * truncated
            if symbol == initial:
                seeds.append((cost + extra, audit + "K", (rule, dot + 1)))
            if symbol in ROLES:
                seeds.append((cost + RENAME + extra, audit + "R", (rule, dot + 1)))
    best = _closed(seeds, _WAITING)
    least = min(cost for cost, _ in best.values())
    audits = [audit for _, audit in best.values()]
    low, high = min(audits), max(audits)
    same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    return least, low[:same], tuple((item, cost - least, audit[same:]) for item, cost, audit in _column(best))


def _last(column: Column) -> tuple[int, str]:
    """Cost and open letters of the cheapest complete parse."""
    return min((cost, audit) for (rule, dot), cost, audit in column if _RULES[rule][0] == _START and dot == len(_RULES[rule][1]))


class _Talk:
    """One conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.column = conv, _FIRST
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None
        self.seen: set[bytes] = set()
        self.audit: list[str] = []
        self.open: deque = deque()
        self.wants = "u"

    def add(self, turn, role: str, text: str) -> Iterator[tuple]:
        """Takes a row; yields the repaired rows that are settled by now: (edit, role, text, turn)."""
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        shown = text.rstrip(SPACES)
        blank = duplicate = truncated = False
        if not shown:
            blank = True
        else:
            print_ = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            duplicate = print_ in self.seen
            self.seen.add(print_)
            truncated = not duplicate and shown[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.open.append((turn, role, text))
        cost, letters, self.column = _step(self.column, initial if initial in ("s", "u", "a") else "", blank or duplicate, truncated)
        self.cost += cost
        yield from self.settle(letters)

    def settle(self, letters: str) -> Iterator[tuple]:
        self.audit.append(letters)
        for letter in letters:
            if letter == "I":
                turn, role, text = None, ROLES[self.wants], ""
            else:
                turn, role, text = self.open.popleft()
                if letter == "D":
                    continue
                role = ROLES[self.wants] if letter == "R" else role
            self.wants = "a" if role[0] == "u" else "u"
            yield letter, role, text, turn

    def end(self) -> Iterator[tuple]:
        cost, letters = _last(self.column)
        self.cost += cost
        yield from self.settle(letters)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_COLUMNS = ("_conv", "_turn", "_role", "_text", "_there")


def _talks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Talk, Iterator[tuple]]]:
    """(conversation, its next repaired rows) for every row, and once more at each conversation's end, with ``end`` set."""
    talk = None
    for batch in batches:
        for conv, turn, role, text, there in zip(*(batch.column(x).to_pylist() for x in _COLUMNS)):
            if talk is None or talk.conv != conv:
                if talk is not None:
                    yield talk, talk.end(), True
                talk = _Talk(conv)
            if there:
                yield talk, talk.add(turn, role, text), False
    if talk is not None:
        yield talk, talk.end(), True


_REPORT = pa.schema(
    [("_conv", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.large_string()), ("repaired_sha256", pa.string())]
)
_TURNS = pa.schema([("_conv", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
#: Rows, and characters, that a task gathers before it hands them on.
BATCH_ROWS, BATCH_CHARS = 5_000, 1 << 22


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    digest, first = hashlib.sha256(), True
    for talk, repaired, done in _talks(batches):
        for _, role, text, _ in repaired:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if done:
            audit = "".join(talk.audit)
            out.append((talk.conv, talk.gaps(), talk.blank, talk.duplicate, talk.truncated, talk.illegal, talk.cost, audit, digest.hexdigest()))
            held += len(audit)
            digest, first = hashlib.sha256(), True
            if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                yield _batch(out, _REPORT)
                out, held = [], 0
    yield _batch(out, _REPORT)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held, position = [], 0, 0
    for talk, repaired, done in _talks(batches):
        for edit, role, text, turn in repaired:
            out.append((talk.conv, position, turn, edit, role, text))
            held, position = held + len(text), position + 1
            if len(out) >= BATCH_ROWS or held >= BATCH_CHARS:
                yield _batch(out, _TURNS)
                out, held = [], 0
        position = 0 if done else position
    yield _batch(out, _TURNS)


def _dealt(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    space = F.lit(" ")
    dealt = rows.select(
        F.col("conv_id").cast("long").alias("_conv"), F.col("turn").cast("long").alias("_turn"), F.coalesce("role", space).alias("_role"), F.coalesce("text", space).alias("_text"), F.lit(True).alias("_there")
    )
    if ids is not None:
        empty = F.lit("")
        dealt = dealt.unionByName(ids.select(F.col("conv_id").cast("long").alias("_conv"), F.lit(None).cast("long").alias("_turn"), empty.alias("_role"), empty.alias("_text"), F.lit(False).alias("_there")).distinct())
    return dealt.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id): faults, cost, audit, digest of the repair."""
    out = _dealt(rows, ids).mapInArrow(_report, "_conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.withColumnRenamed("_conv", "conv_id")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, turn (null if inserted), edit (K, R or I), role, text."""
    out = _dealt(rows, None).mapInArrow(_turns, "_conv long, position long, turn long, edit string, role string, text string")
    return out.withColumnRenamed("_conv", "conv_id")
