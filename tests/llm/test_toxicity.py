"""Probabilities of toxic texts fit what labels say, also if the sample holds more toxic rows than the table."""

import numpy as np
import pytest

from wayfold.llm import toxicity

BAD = [f"{a}{b}" for a in ("vile", "rott", "scurr", "knav") for b in ("ster", "ish", "ling", "ery")]


@pytest.mark.parametrize("train_rows", [800, 5000])
def test_toxic_documents_are_caught_however_the_sample_is_made(spark, train_rows):
    draw = np.random.default_rng(12)
    plain = [f"{a}{b}{c}" for a in ("mo", "ta", "fi", "ne", "lu") for b in ("ran", "dol", "mip", "ses") for c in ("t", "ka", "len", "o")]
    said = lambda toxic: " ".join(draw.permutation([*draw.choice(plain, int(draw.integers(10, 120))), *draw.choice(BAD, int(draw.integers(2, 7)) if toxic else 0)]))
    rows = [(k, said(k % 12 == 0)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, int(k % 12 == 0)) for k in range(4800)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, train_rows=train_rows)
    scorer = toxicity._scorer(spark.sparkContext.broadcast(model))
    above = {r.doc_id: r.p[0] for r in docs.filter("doc_id >= 4800").select("doc_id", scorer("text").alias("p")).collect()}
    caught = np.mean([p >= toxicity.REJECT_FROM for k, p in above.items() if k % 12 == 0])
    left = np.mean([p < toxicity.REJECT_FROM for k, p in above.items() if k % 12])
    assert len(above) == 1200 and caught >= 0.95 and left >= 0.99
    assert abs(np.mean(list(above.values())) - 1 / 12) < 0.02


def test_calibrated_thresholds_fit_the_rates():
    draw = np.random.default_rng(5)
    grades = np.repeat([0, 1, 2], [600, 200, 200])
    score = draw.normal(0.3 * grades, 0.1)
    stands_for = np.where(grades > 0, 1.0, 5.0)
    told = toxicity.calibrate(toxicity.OrdinalModel(np.ones(1), np.array([3.0, 4.0])), score, grades, stands_for)
    above = told.above(told.weights[0] * score)
    for k in (0, 1):
        assert abs(np.average(above[:, k], weights=stands_for) - np.average(grades > k, weights=stands_for)) < 0.01
    assert np.mean((above[:, 0] >= 0.5) == (grades > 0)) > 0.9 and told.thresholds[0] < told.thresholds[1]


def test_scores_without_bearing_reject_nothing():
    grades = np.array([0, 0, 0, 1])
    for score in (np.zeros(4), np.array([1.0, 2.0, 3.0, 0.0])):
        told = toxicity.calibrate(toxicity.OrdinalModel(np.ones(1), np.array([0.0])), score, grades, np.ones(4))
        assert np.isfinite(told.above(told.weights[0] * score)).all() and (told.above(told.weights[0] * score) < 0.5).all()
