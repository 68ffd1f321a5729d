"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words (runs of letters, lowered) and their prefixes of 4 to 7 bytes,
which inflected forms share, hashed to buckets; the score s = w . x is shared by all thresholds and P(grade <= k) = sigmoid(t_k - s) with t_0 < t_1 < ...
The expected severity is the sum over k of P(grade > k); a text is rejected if P(grade > 0) reaches
``REJECT_FROM``.

The model is fitted in numpy by Adagrad on at most ``TRAIN_ROWS`` labelled rows, those with the
smallest hashes of their id, so that reruns agree; scoring covers whole texts of all rows. If there are more, toxic rows
make up at least ``TOXIC_SHARE`` of the sample, as far as there are any. Features get no weight if they depend on the label only as chance allows (a likelihood ratio
below ``LEAST_G2``) or are less than ``LEANING_ODDS`` times likelier in toxic rows: plain words beside a slur
must not outweigh it. Labels above 1 are grades and are fitted as they are. Where labels only tell toxic from clean, grades
1 and 2 are told apart by the share of telling features (at least ``TELLING_ODDS`` times likelier in toxic than in
clean rows of the sample) among a row's features: above the median of toxic rows it is grade 2. To learn single telling
words, not only their company, toxic rows are shown with a random part of their features left out.

Such rows score lower than whole texts do, so the fitted thresholds are none for whole texts: moved by the logarithm of the clean
rows left out of the sample, they let a third of toxic rows pass. Thresholds and the scale of the score are therefore fitted
once more on whole texts, each row counting for as many as it stands for. Each half of the sample is scored by
weights of the other half; with less than ``HALVES_FROM`` toxic rows the scores are those of the model itself.

Defined cases: null and empty texts have no features and get the clean grade; labels without a
document, null labels and repeated labels of a row (the larger counts) are handled; without any
labelled row of both kinds nothing is rejected; repeated rows are graded alike; very long texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import arrays

BUCKET_BITS = 18
PREFIXES = (4, 5, 6, 7)
TRAIN_ROWS = 12_000
TOXIC_SHARE = 1 / 8
HALVES_FROM = 100
LEAST_G2, LEAST_ROWS = 12.0, 3
EPOCHS = 30
RATE = 0.5
SHRINK = 2e-5
TELLING_ODDS, LEANING_ODDS = 20.0, 5.0
REJECT_FROM = 0.5
SEED = 7

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word of letters and of its prefixes, sorted by text number."""
    data = arrays.lower_ascii(data)
    if data.size > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data[1:][capital] += 0x20
    starts, ends, owner = arrays.runs(_LETTER[data], offsets)
    sums = arrays.prefix_hash(data)
    owners, hashes = [owner], [arrays.span_hash(sums, starts, ends)]
    for k in PREFIXES:
        longer = ends - starts > k
        owners.append(owner[longer])
        hashes.append(arrays.mix(arrays.span_hash(sums, starts[longer], starts[longer] + k) + np.uint64(k)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return owner[order], (np.concatenate(hashes)[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: list[np.ndarray] = []
        for first, end, data, offsets in arrays.slices(batch.column("_text")):
            owner, bucket = word_buckets(data, offsets)
            edges = np.searchsorted(owner, np.arange(end - first + 1))
            words += [np.unique(bucket[a:b]).astype(np.int32) for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array([w.tobytes() for w in words], pa.binary())], names=["_toxic", "_words"])


def telling_features(toxic: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which features depend on the label and lean to toxic rows, and which are far likelier in them."""
    size = 1 << BUCKET_BITS
    n = np.array([(toxic == 0).sum(), (toxic > 0).sum()], float)
    within = np.zeros((2, size))
    for t, w in zip(np.minimum(toxic, 1), words):
        within[t, w] += 1
    rate = within.sum(0) / n.sum()
    g2 = np.zeros(size)
    for k in (0, 1):
        for seen, expected in ((within[k], n[k] * rate), (n[k] - within[k], n[k] * (1 - rate))):
            some = seen > 0
            g2[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    share = (within + 0.5) / (n + 1)[:, None]
    depends = (g2 >= LEAST_G2) & (within.sum(0) >= LEAST_ROWS) & (share[1] > LEANING_ODDS * share[0])
    return depends, depends & (share[1] > TELLING_ODDS * share[0])


def split_grades(toxic: np.ndarray, words: list[np.ndarray], telling: np.ndarray) -> np.ndarray:
    """0 for clean rows; 1 or 2 for toxic ones by their share of telling features."""
    dense = np.array([telling[w].mean() if w.size else 0.0 for w in words])
    return np.where(toxic == 0, 0, np.where(dense > np.median(dense[toxic == 1]), 2, 1))


def fit(features: list[np.ndarray], grades: np.ndarray, seed: int = SEED) -> OrdinalModel:
    """Minimises the negative log likelihood of the grades by Adagrad over shuffled batches."""
    classes = int(grades.max()) + 1
    w, sums = np.zeros(1 << BUCKET_BITS), np.full(1 << BUCKET_BITS, 1e-3)
    t, t_sums = np.arange(classes - 1, dtype=float) + 1.0, np.full(classes - 1, 1e-3)
    draw = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for _ in range(EPOCHS):
        order = draw.permutation(len(features))
        for lo in range(0, order.size, 256):
            rows = order[lo : lo + 256]
            y = grades[rows]
            kept = [x if g == 0 or not x.size else draw.choice(x, max(1, int(x.size * draw.random() ** 3)), replace=False) for x, g in zip((features[r] for r in rows), y)]
            lengths = np.array([x.size for x in kept])
            flat, owner = np.concatenate(kept), np.repeat(np.arange(rows.size), lengths)
            s = np.bincount(owner, weights=w[flat], minlength=rows.size)
            edges = np.concatenate([[-np.inf], t, [np.inf]])
            up, low = sigmoid(edges[y + 1] - s), sigmoid(edges[y] - s)
            up, low = np.where(y == classes - 1, 1.0, up), np.where(y == 0, 0.0, low)
            d_up, d_low, inside = up * (1 - up), low * (1 - low), np.maximum(up - low, 1e-9)
            g_s = (d_up - d_low) / inside
            grad = np.bincount(flat, weights=g_s[owner], minlength=w.size)
            used = np.unique(flat)
            g = grad[used] / rows.size + SHRINK * w[used]
            sums[used] += g * g
            w[used] -= RATE * g / np.sqrt(sums[used])
            g_t = np.array([(np.where(y == k + 1, d_low, 0) - np.where(y == k, d_up, 0))[(y == k) | (y == k + 1)] @ (1 / inside[(y == k) | (y == k + 1)]) for k in range(classes - 1)]) / rows.size
            t_sums += g_t * g_t
            t = np.sort(t - 0.1 * g_t / np.sqrt(t_sums))
    return OrdinalModel(w, t)


def _scores(model: OrdinalModel, words: list[np.ndarray]) -> np.ndarray:
    return np.array([model.weights[w].sum() for w in words])


def unseen_scores(toxic: np.ndarray, grades: np.ndarray, words: list[np.ndarray]) -> np.ndarray | None:
    """Scores of whole texts by a model of the other half, equal texts being in one half; None if a half lacks a kind."""
    half = np.array([zlib.crc32(w) & 1 for w in words])
    score = np.zeros(len(words))
    for k in (0, 1):
        seen, unseen = np.flatnonzero(half != k), np.flatnonzero(half == k)
        if not 0 < (toxic[seen] > 0).sum() < seen.size:
            return None
        depends, _ = telling_features(toxic[seen], [words[i] for i in seen])
        score[unseen] = _scores(fit([words[i][depends[words[i]]] for i in seen], grades[seen]), [words[i] for i in unseen])
    return score


def _logistic(columns: np.ndarray, above: np.ndarray, rows: np.ndarray, known: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights of ``columns`` beside the ``known`` part by Newton steps; a row is added to each kind (Platt), so that they stay finite."""
    yes, no = rows[above].sum(), rows[~above].sum()
    target = np.where(above, (yes + 1) / (yes + 2), 1 / (no + 2))
    b = np.zeros(columns.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(columns @ b + known, -60, 60)))
        curve = (columns * (rows * p * (1 - p))[:, None]).T @ columns + 1e-3 * np.eye(b.size)
        step = np.linalg.solve(curve, columns.T @ (rows * (p - target)) + 1e-3 * b)
        b -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return b


def calibrate(model: OrdinalModel, score: np.ndarray, grades: np.ndarray, stands_for: np.ndarray) -> OrdinalModel:
    """``model`` with scale and thresholds by which P(grade > k) fits the grades of texts with these scores."""
    rows, mean, spread = stands_for / stands_for.mean(), score.mean(), max(score.std(), 1e-9)
    one = np.ones((score.size, 1))
    slope = max(0.0, _logistic(np.column_stack([(score - mean) / spread, one]), grades > 0, rows)[0] / spread)
    thresholds = [-_logistic(one, grades > k, rows, slope * score)[0] for k in range(model.thresholds.size)]
    return OrdinalModel(model.weights * slope, np.sort(thresholds))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> OrdinalModel:
    named = labels.filter(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(toxic_col).cast("int").alias("_toxic"))
    named = named.filter("_toxic >= 0")
    kinds = dict(named.groupBy((F.col("_toxic") > 0).alias("kind")).count().collect())
    toxic_rows = min(kinds.get(True, 0), max(int(train_rows * TOXIC_SHARE), train_rows - kinds.get(False, 0)))
    clean_rows = min(kinds.get(False, 0), train_rows - toxic_rows)
    first = lambda part, n: named.filter(part).orderBy(F.xxhash64("_id"), "_id").limit(n)
    sample = first("_toxic > 0", toxic_rows).unionByName(first("_toxic = 0", clean_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_toxic", "_text")
    got = rows.mapInArrow(_gather, "_toxic int, _words binary").toArrow().combine_chunks()
    toxic, held = got.column("_toxic").to_numpy().astype(int), got.column("_words").cast(pa.large_binary()).combine_chunks()
    order = sorted(range(len(held)), key=lambda i: (toxic[i], held[i].as_py()))
    toxic, words = toxic[order], [np.frombuffer(held[i].as_buffer(), np.int32) for i in order]  # views of the table
    if not 0 < (toxic > 0).sum() < toxic.size:
        return OrdinalModel(np.zeros(1 << BUCKET_BITS), np.array([50.0, 60.0]))
    depends, telling = telling_features(toxic, words)
    grades = toxic if toxic.max() > 1 else split_grades(toxic, words, telling)
    model = fit([w[depends[w]] for w in words], grades)
    score = unseen_scores(toxic, grades, words) if (toxic > 0).sum() >= HALVES_FROM else None
    stands_for = np.where(toxic > 0, kinds[True] / toxic_rows, kinds[False] / clean_rows)
    model = calibrate(model, _scores(model, words) if score is None else score, grades, stands_for)
    del got, held, words
    pa.default_memory_pool().release_unused()
    return model


def _scorer(model):
    """An Arrow UDF of the text: P(grade > k) for every k; ``model`` is a broadcast."""

    @F.arrow_udf("array<double>")
    def score(texts: pa.Array) -> pa.Array:
        m = model.value
        out = []
        for first, end, data, offsets in arrays.slices(texts):
            owner, bucket = word_buckets(data, offsets)
            told = m.weights[bucket] != 0  # features without weight need not be made distinct
            pairs = np.unique(owner[told] << BUCKET_BITS | bucket[told])
            s = np.bincount(pairs >> BUCKET_BITS, weights=m.weights[pairs & ((1 << BUCKET_BITS) - 1)], minlength=end - first)
            out += m.above(s).tolist()
        return pa.array(out, pa.list_(pa.float64()))

    return score


def _rejected() -> Column:
    return F.element_at("_above", 1) >= REJECT_FROM


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, grade (most likely), severity (expected), toxic_probability, rejected."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    scored = docs.select(F.col(id_col).alias("_id"), _scorer(model)(F.col(text_col)).alias("_above"))
    at_most = F.transform(F.concat(F.array(F.lit(1.0)), F.col("_above")), lambda p, i: p - F.coalesce(F.get("_above", i), F.lit(0.0)))
    return scored.select(
        F.col("_id").alias(id_col),
        (F.array_position(at_most, F.array_max(at_most)) - 1).cast("int").alias("grade"),
        F.aggregate("_above", F.lit(0.0), lambda a, p: a + p).alias("severity"),
        F.element_at("_above", 1).alias("toxic_probability"),
        _rejected().alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with its columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    rows = docs.select(F.struct("*").alias("_row"), _scorer(model)(F.col(text_col)).alias("_above"))
    return rows.filter(~_rejected()).select("_row.*")
