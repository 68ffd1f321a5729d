"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are the pairs and triples of bytes inside its words (letters, lowered, with the
word's borders), hashed to buckets. Each bucket has an embedding; a text is the average of its
subwords' embeddings, and a linear softmax over it gives the languages' probabilities. Embeddings
and softmax are learned together in numpy by stochastic gradient descent from at most ``TRAIN_ROWS``
whole texts, those with the smallest hashes of their id among rows that the caller allows.

A fifth of the sample is held back to calibrate: a temperature that minimises its log loss scales
the logits, and the rejection threshold is the smallest score from which at least ``PRECISION`` of its
accepted texts are right. As average and softmax are linear before the exponential, tasks need only
the table bucket -> logits; all bytes of all texts are scored.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; with no
row to learn from every text is ``und``; rows with a null language are never learned from; ties go
to the first language in code point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm import arrays

BUCKET_BITS = 16
DIM = 16
TRAIN_ROWS = 4_000
EPOCHS = 6
RATE = 0.5
HELD_BACK = 5
PRECISION = 0.995
SEED = 11

_U = np.uint64
_CODE = np.zeros(256, np.uint64)  # 0: not a letter
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # one row per bucket
    bias: np.ndarray
    temperature: float
    accept_from: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword, and for each text the number of subwords before it (n + 1 numbers).

    Texts are separated by two bytes that are no letters, so that no subword spans two texts.
    """
    n = offsets.size - 1
    code = np.zeros(data.size + 2 * n, np.uint64)
    lengths = np.diff(offsets)
    begin = offsets[:-1] + 2 * np.arange(n) + 1
    code[np.arange(data.size) + np.repeat(begin - offsets[:-1], lengths)] = _CODE[data]
    if data.size > 1:  # capitals of Latin-1 letters in UTF-8
        capital = (code[:-1] == 0xC3) & (code[1:] >= 0x80) & (code[1:] <= 0x9E)
        code[1:][capital] += _U(0x20)
    a, b, c = code[:-2], code[1:-1], code[2:]
    pair = a << _U(8) | b
    triple = (pair << _U(8) | c) * _U(0x9E3779B97F4A7C15) >> _U(64 - BUCKET_BITS)
    pair = pair * _U(0xC2B2AE3D27D4EB4F) >> _U(64 - BUCKET_BITS)
    has_pair, has_triple = (a | b) != 0, b != 0
    at = np.concatenate([np.flatnonzero(has_pair), np.flatnonzero(has_triple)])
    bucket = np.concatenate([pair[has_pair], triple[has_triple]]).astype(np.int64)
    order = np.searchsorted(begin - 1, at, "right") - 1
    by_text = np.argsort(order, kind="stable") if n > 1 else slice(None)
    return bucket[by_text], np.concatenate([[0], np.cumsum(np.bincount(order, minlength=n))])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[np.ndarray] = []
        for first, end, data, offsets in arrays.slices(batch.column("_text")):
            bucket, edges = subwords(data, offsets)
            for lo, hi in zip(edges[:-1], edges[1:]):
                kinds, counts = np.unique(bucket[lo:hi], return_counts=True)
                found.append(np.stack([kinds, counts]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("_lang"), pa.array([x.tobytes() for x in found], pa.binary())], names=["_lang", "_found"])


def fit(texts: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, languages: list[str], seed: int = SEED) -> LanguageModel:
    """``texts``: (distinct buckets, counts) of each text; ``targets``: positions in ``languages``."""
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 0.1, (1 << BUCKET_BITS, DIM))
    out, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    share = [c / max(1, c.sum()) for _, c in texts]
    held = np.arange(len(texts)) % HELD_BACK == 0
    learn = np.flatnonzero(~held)
    steps, step = max(1, EPOCHS * learn.size), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(learn):
            rate = RATE * (1 - step / steps)
            step += 1
            kinds = texts[i][0]
            mean = share[i] @ table[kinds]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[targets[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            table[kinds] -= (rate * 20) * np.outer(share[i], back)
    logits = table @ out
    model = LanguageModel(languages, logits.astype(np.float32), bias, 1.0, 0.0)
    calibrate = np.flatnonzero(held)
    if calibrate.size:
        z = np.stack([share[i] @ logits[texts[i][0]] + bias if texts[i][0].size else bias for i in calibrate])
        y = targets[calibrate]

        def loss(t: float) -> float:
            model.temperature = t
            return -np.log(np.maximum(model.probabilities(z)[np.arange(y.size), y], 1e-12)).mean()

        model.temperature = min(np.geomspace(0.5, 5, 40), key=loss)
        p = model.probabilities(z)
        score, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-score, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, y.size + 1) >= PRECISION
        model.accept_from = float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    named = docs.filter(allowed & F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sample = named.select(F.col(id_col).alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows).distinct()
    rows = named.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).join(F.broadcast(sample), "_id", "left_semi")
    got = rows.select("_text", "_lang").mapInArrow(_gather, "_lang string, _found binary").toArrow().to_pydict()
    order = sorted(range(len(got["_lang"])), key=lambda i: (hash_order(got["_found"][i]), got["_lang"][i]))
    texts = [tuple(np.frombuffer(got["_found"][i], np.int32).reshape(2, -1)) for i in order]
    languages = sorted(set(got["_lang"]))
    if not languages:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 1), np.float32), np.zeros(1), 1.0, 1.0)
    return fit(texts, np.array([languages.index(got["_lang"][i]) for i in order]), languages)


def hash_order(found: bytes) -> int:
    """A mixed order of the sample that does not depend on the order of its arrival."""
    return int(arrays.mix(np.array([np.frombuffer(found, np.uint8).astype(np.uint64).sum() + np.uint64(len(found))], np.uint64))[0])


def _predictor(model):
    """An Arrow UDF of the text: (lang_pred, score, accepted) as if it had letters; ``model`` is a broadcast."""

    @F.arrow_udf("struct<lang_pred: string, score: double, accepted: boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        m = model.value
        best, score = [np.zeros(0, int)], [np.zeros(0)]
        for _, _, data, offsets in arrays.slices(texts):
            bucket, edges = subwords(data, offsets)
            count = np.diff(edges)
            sums = np.zeros((count.size, m.logits.shape[1]))
            some = count > 0
            if some.any():
                for k in range(m.logits.shape[1]):
                    sums[some, k] = np.add.reduceat(m.logits[:, k][bucket].astype(np.float64), edges[:-1][some])
            p = m.probabilities(sums / np.maximum(count, 1)[:, None] + m.bias)
            best.append(p.argmax(1))
            score.append(p.max(1))
        score = np.concatenate(score)
        names = pa.array(m.languages or ["und"]).take(pa.array(np.concatenate(best)))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(score >= m.accept_from)], names=["lang_pred", "score", "accepted"])

    return predict


def predict_languages(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, lang_pred, score, accepted. Only rows where ``allowed`` is true are learned from."""
    model = train(docs, allowed, id_col, text_col, lang_col)
    told = _predictor(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col))
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    scored = docs.select(F.col(id_col).alias("_id"), lettered.alias("_lettered"), told.alias("_told"))
    return scored.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_lettered"), F.col("_told.lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("_lettered"), F.col("_told.score")).otherwise(0.0).alias("score"),
        (F.col("_lettered") & F.col("_told.accepted")).alias("accepted"),
    )
