"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of messages to a string. Successive prefixes of a conversation
are rendered, and what a turn adds to the output before it is its span. If an output does not begin with
the one before, the template rewrites history: the turn is flagged, and its span begins where the two
outputs part. Where a turn's text lies inside its span is found by rendering the turn once more with a
probe character for its text.

Every turn is rendered behind the whole conversation before it, so that a black-box template sees what
it would see anywhere; a task then holds one conversation, and the work grows with the square of its turns.
Only if the caller declares the template turn-local (``turn_local=True``: it renders each turn by itself) does the older
half leave the prefix after ``WINDOW`` turns, so that the work per turn and the memory of a task stay bounded. The
declaration is checked: over the turns of the first ``CHECKED`` such prefixes both renderings are made, and a template whose pieces differ ends the job.

The template here writes ``<s>[role] text [/role]</s>`` for each turn. In roles and texts the four
characters ``\\ < [ ]`` are escaped by a backslash and a letter, so that no control string can occur in
them, and ``read_back`` undoes it. Assistant texts are under the loss mask.

Turns are dealt by conversation and sorted within partitions; a conversation is read as a stream and, with
a declared turn-local template, never held as a whole. Defined cases: a null text or role counts as empty; rows with equal turn are ordered
by role, then text (repeated rows are turns of their own); null turns come first; very long texts are rendered whole; rows with a null conversation id form one conversation;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
WINDOW, CHECKED = 32, 2
PROBE = "\x00"
LOSS_ROLE = "assistant"

# The escapes of the template.
ESCAPES = {"\\": "\\\\", "<": "\\a", "[": "\\b", "]": "\\c"}

_TO = str.maketrans(ESCAPES)
_FROM = {v: k for k, v in ESCAPES.items()}
_ESCAPED = re.compile(r"\\.", re.S)
_TURN = re.compile(r"<s>\[([^\[\]<]*)\] ([^\[\]<]*) \[/\1\]</s>")


def escape(text: str) -> str:
    return text.translate(_TO)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _FROM[m[0]], text)


def render(messages: list[Message]) -> str:
    return "".join(f"<s>[{escape(role)}] {escape(text)} [/{escape(role)}]</s>" for role, text in messages)


def read_back(output: str) -> list[Message]:
    """The messages that ``render`` was given; raises if the output is not of its form throughout."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def incremental(messages: Iterator[Message], template: Callable[[list[Message]], str] = render, window: int = WINDOW, turn_local: bool = False) -> Iterator[tuple[str, str, int, int, bool]]:
    """(role, piece, text start, text end, rewrites) for each turn; text positions are within the piece, -1 if not found.

    Only with ``turn_local`` are prefixes cut to windows; a template that turns out not to be turn-local then raises.
    """
    prefix: list[Message] = []
    whole: list[Message] | None = []  # the uncut prefix, while the declaration is checked
    cuts = 0
    before = template(prefix)
    for role, text in messages:
        now = template([*prefix, (role, text)])
        rewrites = not now.startswith(before)
        start = len(os.path.commonprefix([before, now])) if rewrites else len(before)
        piece = now[start:]
        if turn_local and whole is not None and cuts:
            known = template(whole)
            if template([*whole, (role, text)]) != known + piece or rewrites:
                raise ValueError("the template was declared turn-local, but renders a turn differently behind a longer prefix")
        probed = template([*prefix, (role, PROBE)])[start:]
        at = probed.find(PROBE)
        tail = len(probed) - at - len(PROBE)
        fits = at >= 0 and at + tail <= len(piece) and piece.startswith(probed[:at]) and piece.endswith(probed[len(probed) - tail :])
        yield role, piece, at if fits else -1, len(piece) - tail if fits else -1, rewrites
        prefix.append((role, text))
        if whole is not None:
            whole = [*whole, (role, text)] if turn_local else None
        if turn_local and len(prefix) >= window:
            prefix = prefix[window // 2 :]
            before = template(prefix)
            cuts += 1
            whole = None if cuts > CHECKED else whole
        else:
            before = now


_PIECES = "conv_id long, position long, role string, piece string, start long, end long, loss_start long, loss_end long, rewrites_history boolean, not_located boolean"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean, not_located long"


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _by_conversation(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Consecutive rows with equal first column, as streams."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def _format(template: Callable[[list[Message]], str], window: int, turn_local: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in _by_conversation(_rows(batches)):
            at = 0
            for k, (role, piece, a, b, rewrites) in enumerate(incremental(((r or "", t or "") for _, r, t in rows), template, window, turn_local)):
                loss = (at + a, at + b) if role == LOSS_ROLE and a >= 0 else (None, None)
                out.append((conv, k, role, piece, at, at + len(piece), *loss, rewrites, a < 0))
                at += len(piece)
                if len(out) >= 1000:
                    yield _table(out, _PIECES)
                    out = []
        yield _table(out, _PIECES)

    return pieces


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, rows in _by_conversation(_rows(batches)):
        turns, loss, n, chars, loss_chars, rewrote, lost = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False, 0
        for number, (_, position, _, piece, start, end, loss_start, loss_end, rewrites, not_located) in enumerate(rows):
            if position != number or start != chars:
                raise ValueError(f"conversation {conv}: turn {position} from {start} where turn {number} from {chars} should follow; pieces must be whole conversations in order")
            for role, text in read_back(piece):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            if loss_start is not None:
                text = unescape(piece[loss_start - start : loss_end - start])
                loss.update(text.encode())
                loss_chars += len(text)
            chars += end - start
            rewrote |= rewrites
            lost += not_located
        out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrote, lost))
        if len(out) >= 1000:
            yield _table(out, _DIGESTS)
            out = []
    yield _table(out, _DIGESTS)


def format_chats(
    turns: DataFrame, template: Callable[[list[Message]], str] = render, window: int = WINDOW, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    turn_local: bool = False,
) -> DataFrame:
    """One row per turn, in order within partitions: conv_id, position, role, piece (what the turn adds to the output),
    start and end in the output, loss_start and loss_end (assistant text), rewrites_history, not_located (the template changes the
    turn's text beyond what a probe can find, so that an assistant text is not under the mask). ``turn_local`` as in ``incremental``."""
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    dealt = rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").select("_conv", "_role", "_text")
    return dealt.mapInArrow(_format(template, window, turn_local), _PIECES)


def digest_chats(pieces: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``format_chats`` with the template of this module, read back from the output.

    Conversations have to be whole and in order, as ``format_chats`` leaves them; a task that finds others raises. ``not_located``
    counts the turns whose text was not found.
    """
    return pieces.mapInArrow(_digest, _DIGESTS)
