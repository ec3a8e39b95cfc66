import random
import zlib

import numpy as np

from strandline.llm import toxicity
from strandline.llm.toxicity import LabelModel

from .conftest import prose


def corpus(spark, n=1200, seed=5):
    """Toxic texts hold either a listed word or an invented stem that only labels can give away."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        words = prose(i, r.choice([5, 40, 400])).split(" ")
        if bad:
            for _ in range(2):
                words.insert(r.randrange(len(words) + 1), r.choice(["idiot", "Scum,", "zorgl" + r.choice(["a", "en", "ix"])]))
        docs.append((i, " ".join(words), "x", "y"))
        if r.random() < 0.7:
            labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus(spark)
    model, _ = toxicity.fit(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = np.mean([(score[r.doc_id] >= 0.5) == bool(r.toxic) for r in held])
    assert len(held) > 100 and right > 0.97
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other, _ = toxicity.fit(docs, flipped)
    assert other.weights == model.weights and other.bias == model.bias


def test_label_model_finds_rates_and_correlated_voters():
    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.2
    one = np.where(y, r.random(len(y)) < 0.8, r.random(len(y)) < 0.02)
    two = np.where(r.random(len(y)) < 0.9, one, r.random(len(y)) < 0.2)  # copies the first
    rest = [np.where(y, r.random(len(y)) < a, r.random(len(y)) < b) for a, b in ((0.6, 0.05), (0.7, 0.1), (0.5, 0.02))]
    bits = sum(v.astype(np.int64) << k for k, v in enumerate([one, two, *rest]))
    patterns, n = np.unique(bits, return_counts=True)
    model = LabelModel(5)
    model.fit(patterns, n.astype(float), np.full(len(patterns), -1))
    assert any({0, 1} <= set(c) for c in model.cliques)
    assert abs(model.prior - 0.2) < 0.05
    p = model.posterior(patterns, np.full(len(patterns), -1))
    assert ((p[np.searchsorted(patterns, bits)] > 0.5) == y).mean() > 0.9


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels = corpus(spark, 300)
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (7, None, None), (8, 1, 9)], "doc_id long, quality int, toxic int"))
    model, _ = toxicity.fit(docs, more)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.reject(odd_docs, model).count() == odd_docs.count()
    assert toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.score(no_docs, model).count() == 0
    for d, lab in ((no_docs, labels), (docs, labels.limit(0)), (no_docs, labels.limit(0))):
        model, _ = toxicity.fit(d, lab)
        assert toxicity.score(odd_docs, model).count() == odd_docs.count()
