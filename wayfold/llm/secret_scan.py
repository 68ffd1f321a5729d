"""Secret scans: fixed patterns, and spans that a linear-chain conditional random field adds.

Base spans come from three patterns (``KINDS``), leftmost and without overlap per kind; a match whose
secret part is too short is dropped. A span is the whole match.

The field tags tokens as begin, inside or outside of a secret. Tokens are runs of word characters
(letters, digits, ``+ / _ . -`` and all non-ASCII bytes) and single other symbols. Features of a token
are its shape (length; which of lower case, capitals, digits and symbols it mixes; the share of digits; how often it changes between
these), each by itself so that unseen shapes are judged by what they have in common with seen ones, the kinds of the
two tokens before and the one after it (words that announce secrets, ``=`` or ``:``, quotes, plain words,
numbers, ...), and a feature of the file (how much of it are tokens that mix letters and digits).
Weights and transitions are fitted in numpy by gradient ascent on the log likelihood (forward-backward
over windows of tokens) from at most ``TRAIN_DOCS`` documents with the smallest hashes of their id, and of their
windows at most ``MOST_WINDOWS`` with spans and as many without, again by hash. The base spans are the labels. So that the field
learns more than the patterns know, the announcing word, and the marks beside a secret, are hidden in most windows
anew in every round, and the shapes of part of the secrets are replaced by those of random strings of other alphabets, lengths and
prefixes (``POOL`` of them), and part get other neighbours: a corpus may hold secrets of one form and place only, but what makes a
secret is that it is random. Windows inside a text begin behind an outside token, as runs do in decoding; start weights are learned at text starts only.
Decoding is Viterbi. A decoded span that overlaps no base span is added with kind ``crf``.

Viterbi runs only where it can matter, which is exact: with r the range of the transition weights, a token
whose ``outside`` weight exceeds both others by more than 2 r is outside on the best path whatever its
neighbours are, so the chain falls apart there. All tokens of all texts are weighed, in numpy arrays
of bounded size.

Defined cases: null and empty texts have no spans; without a single base span in the sample the
field adds nothing; repeated rows are all returned. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import arrays

# The base patterns, the group whose length counts, and its least length.
KINDS = (
    ("assign", re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
ANNOUNCING = ("password", "passwd", "secret", "token", "apikey", "api_key")

TRAIN_DOCS, MOST_WINDOWS = 8_000, 2_000
#: Shares of the windows whose announcing words are hidden, and whose marks are hidden, in a round.
HIDE_WORDS, HIDE_MARKS = 0.7, 0.6
#: Most that a window with a span counts beside one without: as much as makes both kinds even.
MOST_WEIGHT = 200.0
#: Share of the secrets that get the shape of a random string in a round, and such strings.
RESHAPED, POOL = 0.7, 2_000
#: Share of the secrets that get other neighbours in a round, and the kinds of those: words, marks, quotes, announcing words, an end.
MOVED, PLACES = 0.6, (0, 1, 4, 5, 7, 8, 9)
TRAIN_WINDOW = 24
ROUNDS = 100
RATE = 0.3
SHRINK = 1e-3
SEED = 5

_B, _I, _O = 0, 1, 2
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_.-")]] = True
_WORD[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CLASS = np.zeros((4, 256), np.uint8)  # lower or non-ASCII, capital, digit, symbol
_CLASS[0, 97:123] = _CLASS[0, 128:] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [ord(c) for c in "+/_.-"]] = 1

#: Numbers of feature values: length, mix, balance, changes, kind two before, kind before, kind after, file.
LENGTHS, MIXES, BALANCES, CHANGES, TOKEN_KINDS, FILES = 8, 16, 3, 5, 9, 4
_SIZES = (LENGTHS, MIXES, BALANCES, CHANGES, TOKEN_KINDS + 1, TOKEN_KINDS + 1, TOKEN_KINDS + 1, FILES)
_MIX, _TWO_BEFORE, _BEFORE, _AFTER = 1, 4, 5, 6
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])
_ANNOUNCING_HASHES: list[np.ndarray] = []


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    steps: np.ndarray  # from x to
    start: np.ndarray


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def _announcing() -> np.ndarray:
    if not _ANNOUNCING_HASHES:
        data = np.frombuffer("".join(ANNOUNCING).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in ANNOUNCING])
        _ANNOUNCING_HASHES.append(np.sort(arrays.span_hash(arrays.prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends)))
    return _ANNOUNCING_HASHES[0]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every token."""
    starts, ends, owner = arrays.runs(_WORD[data], offsets)
    at = np.flatnonzero(~_WORD[data] & ~_SPACE[data])
    if not at.size:
        return starts, ends, owner
    every = np.concatenate([starts, at])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([ends, at + 1])[order], np.concatenate([owner, np.searchsorted(offsets, at, "right") - 1])[order]


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Feature numbers, one row per token and one column per feature."""
    counts = []
    for k in range(4):
        sums = np.zeros(data.size + 1, np.int32)
        np.cumsum(_CLASS[k][data], out=sums[1:])
        counts.append(sums[ends] - sums[starts])
    lower, upper, digit, symbol = counts
    length = ends - starts
    mixes = (lower > 0) * 1 + (upper > 0) * 2 + (digit > 0) * 4 + (symbol > 0) * 8
    sized = np.searchsorted([2, 5, 8, 12, 16, 24, 32], length, "right")
    letters = lower + upper
    balance = np.where(digit * 8 < letters, 0, np.where(digit * 2 <= letters, 1, 2))
    of = _CLASS.argmax(0)[data]
    turns = np.zeros(data.size + 1, np.int32)
    np.cumsum(of[1:] != of[:-1], out=turns[2:]) if data.size > 1 else None
    changes = np.searchsorted([0.01, 0.12, 0.3, 0.45], (turns[ends] - turns[np.minimum(starts + 1, ends)]) / length, "right")

    byte = data[starts] if starts.size else data[:0]
    mixed = (digit > 0) & (letters > 0) & (length >= 8)
    kind = np.zeros(starts.size, np.int64)  # plain word
    kind[upper > 0] = 1
    kind[(digit > 0) & (letters == 0)] = 2
    kind[mixed] = 3
    kind[(byte == ord("=")) | (byte == ord(":"))] = 4
    kind[(byte == ord('"')) | (byte == ord("'"))] = 5
    kind[(length == 1) & (mixes == 0) & (kind == 0)] = 6
    kind[(symbol > 0) & (kind == 0)] = 7
    short = np.flatnonzero((length >= 5) & (length <= 8))
    hashed = arrays.span_hash(arrays.prefix_hash(arrays.lower_ascii(data)), starts[short], ends[short])
    known = _announcing()
    kind[short[known[np.minimum(np.searchsorted(known, hashed), known.size - 1)] == hashed]] = 8

    def beside(step: int) -> np.ndarray:
        out = np.full(kind.size, TOKEN_KINDS)
        if kind.size > abs(step):
            to, of = (slice(step, None), slice(None, -step)) if step > 0 else (slice(None, step), slice(-step, None))
            same = owner[to] == owner[of]
            out[to][same] = kind[of][same]
        return out

    share = np.bincount(owner, weights=mixed, minlength=texts) / np.maximum(np.bincount(owner, minlength=texts), 1)
    file = np.searchsorted([0.002, 0.02, 0.2], share, "right")[owner]
    return np.stack([sized, mixes, balance, changes, beside(2), beside(1), beside(-1), file], 1) + _OFFSETS[:-1]


def _random_shapes(draw: np.random.Generator) -> np.ndarray:
    """Shape columns of random strings of 16 to 64 characters from usual alphabets, half of them behind a short prefix."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", digits + "abcdef", digits + "ABCDEF"]
    said = []
    for k in range(POOL):
        letters = list(alphabets[k % len(alphabets)])
        prefix = "".join(draw.choice(list(lower), draw.integers(2, 5))) + str(draw.choice(["_", "-"])) if draw.random() < 0.5 else ""
        said.append(prefix + "".join(draw.choice(letters, draw.integers(16, 65))))
    data = np.frombuffer(" ".join(said).encode(), np.uint8)
    offsets = np.array([0, data.size])
    starts, ends, owner = tokens(data, offsets)
    return features(data, starts, ends, owner, 1)[:, :_TWO_BEFORE]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


def fit(windows: np.ndarray, labels: np.ndarray, begins: np.ndarray, seed: int = SEED) -> Field:
    """Maximum likelihood by Adagrad. ``windows``: n x length x features, ``labels``: n x length, -1 after a window's end, ``begins``: whether a window begins its text."""
    draw = np.random.default_rng(seed)
    n, length, _ = windows.shape
    inside = labels >= 0
    w, steps, start = np.zeros((_OFFSETS[-1], 3)), np.zeros((3, 3)), np.zeros(3)
    sums = [np.full(x.shape, 1e-6) for x in (w, steps, start)]
    gold = np.eye(3)[np.maximum(labels, 0)] * inside[..., None]
    spanned = (labels == _B).any(1)
    weight = np.where(spanned, min(MOST_WEIGHT, (~spanned).sum() / max(spanned.sum(), 1)) or 1.0, 1.0)
    weight *= n / weight.sum()
    pool = _random_shapes(draw)
    secrets = np.argwhere((labels == _B) & (np.pad(labels, ((0, 0), (0, 1)), constant_values=_O)[:, 1:] != _I))
    for _ in range(ROUNDS):
        seen = windows.copy()
        hide, blur = draw.random(n) < HIDE_WORDS, draw.random(n) < HIDE_MARKS
        for column in (_TWO_BEFORE, _BEFORE, _AFTER):
            plain = _OFFSETS[column]
            for chosen, kinds in ((hide, (8,)), (blur, (4, 5))):
                part = seen[chosen, :, column]
                part[np.isin(part, [plain + k for k in kinds])] = plain
                seen[chosen, :, column] = part
        reshaped = secrets[draw.random(len(secrets)) < RESHAPED]
        seen[reshaped[:, 0], reshaped[:, 1], :_TWO_BEFORE] = pool[draw.integers(0, len(pool), len(reshaped))]
        moved = secrets[draw.random(len(secrets)) < MOVED]
        for column in (_TWO_BEFORE, _BEFORE, _AFTER):
            seen[moved[:, 0], moved[:, 1], column] = _OFFSETS[column] + draw.choice(PLACES, len(moved))
        score = w[seen].sum(2)
        forward, backward = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        forward[0] = np.where(begins[:, None], start, steps[_O]) + score[:, 0]
        for t in range(1, length):
            nxt = _log_sum(forward[t - 1][:, :, None] + steps[None], 1) + score[:, t]
            forward[t] = np.where(inside[:, t, None], nxt, forward[t - 1])
        for t in range(length - 2, -1, -1):
            nxt = _log_sum(steps[None] + (score[:, t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t] = np.where(inside[:, t + 1, None], nxt, 0.0)
        total = _log_sum(forward[-1], 1)
        single = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2) * inside[..., None]
        g_w = np.zeros_like(w)
        off = (gold - single) * weight[:, None, None]
        for k in range(3):
            g_w[:, k] = np.bincount(seen.ravel(), weights=np.repeat(off[..., k].ravel(), seen.shape[2]), minlength=len(w))
        g_steps = np.zeros((3, 3))
        for t in range(1, length):
            both = forward[t - 1][:, :, None] + steps[None] + (score[:, t] + backward[t])[:, None, :] - total[:, None, None]
            on = inside[:, t, None, None]
            g_steps += ((gold[:, t - 1][:, :, None] * gold[:, t][:, None, :] - np.exp(np.minimum(both, 0)) * on) * weight[:, None, None]).sum(0)
        g_first = off[:, 0]
        g_start = g_first[begins].sum(0)
        g_steps[_O] += g_first[~begins].sum(0)
        for x, g, s in zip((w, steps, start), (g_w / n, g_steps / n, g_start / n), sums):
            g = g - SHRINK * x
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Field(w, steps, start)


def viterbi(score: np.ndarray, field: Field, first: bool, last: bool) -> np.ndarray:
    """The best labels of a run of tokens between outside tokens; ``first``: it begins a text, ``last``: it ends one."""
    best = score[0] + (field.start if first else field.steps[_O])
    back = np.zeros(score.shape, np.int8)
    for t in range(1, len(score)):
        way = best[:, None] + field.steps
        back[t] = way.argmax(0)
        best = way.max(0) + score[t]
    labels = np.zeros(len(score), np.int8)
    labels[-1] = (best if last else best + field.steps[:, _O]).argmax()
    for t in range(len(score) - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def decode(data: np.ndarray, offsets: np.ndarray, field: Field) -> list[tuple[int, int, int]]:
    """(text number, start byte, end byte) of the spans that Viterbi tags, in order."""
    starts, ends, owner = tokens(data, offsets)
    if not starts.size:
        return []
    x = features(data, starts, ends, owner, offsets.size - 1)
    gap = np.stack([field.weights[:, _B] - field.weights[:, _O], field.weights[:, _I] - field.weights[:, _O]], 1)
    slack = 2 * (max(field.steps.max(), field.start.max()) - min(field.steps.min(), field.start.min()))
    open_ = gap[x[:, 0]].copy()
    for k in range(1, x.shape[1]):
        open_ += gap[x[:, k]]
    at = np.flatnonzero(open_.max(1) + slack >= 0)
    if not at.size:
        return []
    breaks = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
    spans = []
    for run in np.split(at, breaks):
        first = run[0] == 0 or owner[run[0] - 1] != owner[run[0]]
        last = run[-1] + 1 == owner.size or owner[run[-1] + 1] != owner[run[-1]]
        labels = viterbi(field.weights[x[run]].sum(1), field, first, last)
        span = None
        for t, label in zip(run, labels):
            if label == _B or label == _I and span is None:
                if span:
                    spans.append(tuple(span))
                span = [int(owner[t]), int(starts[t]), int(ends[t])]
            elif label == _I:
                span[2] = int(ends[t])
            elif span:
                spans.append(tuple(span))
                span = None
        if span:
            spans.append(tuple(span))
    return spans


def _code_points(data: np.ndarray, lo: int, hi: int) -> int:
    return int(np.count_nonzero((data[lo:hi] & 0xC0) != 0x80))


def _with_hints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts that may have a base span: those with a word, or a run of hex digits, that one needs."""
    lowered = arrays.lower_ascii(data)
    raw = lowered.tobytes()
    at = []
    for word in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia"):
        k = raw.find(word)
        while k >= 0:
            at.append(k)
            k = raw.find(word, k + 1)
    hexes = (data >= 48) & (data <= 57) | (data >= 97) & (data <= 102)
    starts, ends, _ = arrays.runs(hexes, offsets)
    at = np.concatenate([np.array(at, np.int64), starts[ends - starts >= 32]])
    return np.unique(np.searchsorted(offsets, at, "right") - 1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training windows: around every base span and every token that mixes letters and digits, and the first tokens of each text."""
    for batch in batches:
        kept, tagged, begins = [], [], []
        for first, end, data, offsets in arrays.slices(batch.column("_text")):
            starts, ends, owner = tokens(data, offsets)
            x = features(data, starts, ends, owner, end - first)
            label = np.full(starts.size, _O, np.int8)
            for t in _with_hints(data, offsets):
                lo = int(offsets[t])
                raw = data[lo : offsets[t + 1]].tobytes()
                text = raw.decode()
                for a, k, b in base_spans(text):
                    group = KINDS[k][2]
                    m = KINDS[k][1].match(text, a)
                    a, b = m.span(group)
                    a, b = lo + len(text[:a].encode()), lo + len(text[:b].encode())
                    i, j = np.searchsorted(starts, a, "left"), np.searchsorted(starts, b, "left")
                    if i < j:
                        label[i:j] = _I
                        label[i] = _B
            edges = np.searchsorted(owner, np.arange(end - first + 1))
            marked = np.flatnonzero((label != _O) | ((x[:, _MIX] - _OFFSETS[_MIX] & 4) > 0)) if x.size else np.zeros(0, int)
            chosen = set()
            for i in marked:
                lo, hi = int(edges[owner[i]]), int(edges[owner[i] + 1])
                at = max(lo, int(i) - TRAIN_WINDOW // 2)
                while at > lo and label[at - 1] != _O:
                    at -= 1
                chosen.add((at, hi))
            chosen |= {(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if b > a}
            for lo, hi in sorted(chosen):
                hi = min(hi, lo + TRAIN_WINDOW)
                kept.append(x[lo:hi].astype(np.int16).tobytes())
                tagged.append(label[lo:hi].tobytes())
                begins.append(lo == int(edges[owner[lo]]))
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array(tagged, pa.binary()), pa.array(begins, pa.bool_())], names=["_x", "_y", "_begins"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, most_windows: int = MOST_WINDOWS) -> Field | None:
    """The field, or None if the sample has no base span; from at most ``most_windows`` windows with spans and as many others, those with the smallest hashes."""
    sample = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(train_docs).distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id", "left_semi")
    got = rows.select("_text").mapInArrow(_windows, "_x binary, _y binary, _begins boolean").distinct()
    has_span = F.length(F.translate(F.hex("_y"), "2", "")) > F.length("_y")
    some = got.filter(has_span).orderBy(F.xxhash64("_x", "_y"), "_x", "_y", "_begins").limit(most_windows).toArrow().to_pydict()
    if not some["_x"]:
        return None
    others = got.filter(~has_span).orderBy(F.xxhash64("_x", "_y"), "_x", "_y", "_begins").limit(most_windows).toArrow().to_pydict()
    xs, ys = some["_x"] + others["_x"], some["_y"] + others["_y"]
    windows = np.zeros((len(xs), TRAIN_WINDOW, len(_SIZES)), np.int64)
    labels = np.full((len(xs), TRAIN_WINDOW), -1)
    for i, (a, b) in enumerate(zip(xs, ys)):
        y = np.frombuffer(b, np.int8)
        windows[i, : y.size] = np.frombuffer(a, np.int16).reshape(y.size, -1)
        labels[i, : y.size] = y
    return fit(windows, labels, np.array(some["_begins"] + others["_begins"], bool))


def _scanner(field):
    """An Arrow UDF of the text; ``field`` is a broadcast."""

    @F.arrow_udf("struct<n_assign: long, n_access: long, n_hex: long, base_sha256: string, spans: string, n_crf: long>")
    def scan(texts: pa.Array) -> pa.Array:
        model = field.value
        none = hashlib.sha256(b"").hexdigest()
        rows = []
        for first, end, data, offsets in arrays.slices(texts):
            base: dict[int, list[tuple[int, int, int]]] = {}
            for t in _with_hints(data, offsets):
                if found := base_spans(data[offsets[t] : offsets[t + 1]].tobytes().decode()):
                    base[int(t)] = found
            added: dict[int, list[tuple[int, int, int]]] = {}
            for t, a, b in decode(data, offsets, model) if model is not None else ():
                a, b = _code_points(data, offsets[t], a), _code_points(data, offsets[t], b)
                if not any(a < y and x < b for x, _, y in base.get(t, ())):
                    added.setdefault(t, []).append((a, len(KINDS), b))
            for t in range(end - first):
                own, more = base.get(t, []), added.get(t, [])
                if not own and not more:
                    rows.append((0, 0, 0, none, "", 0))
                    continue
                say = lambda spans: ",".join(f"{(*(k[0] for k in KINDS), 'crf')[k]}:{a}:{b}" for a, k, b in sorted(spans))
                rows.append((*(sum(k == i for _, k, _ in own) for i in range(3)), hashlib.sha256(say(own).encode()).hexdigest(), say(own + more), len(more)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return scan


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind), n_crf."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))
    return docs.select(F.col(id_col).alias(id_col), _scanner(field)(F.col(text_col)).alias("_told")).select(id_col, "_told.*")
