"""All labelled rows teach the toxicity model and its thresholds, on the driver and in shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import toxicity


def labelled(spark, n):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(300)])
    bad = ["vile scum", "rotten filth", "nasty brute"]
    texts = [" ".join([*words[rng.integers(0, 300, 12)], *([bad[i // 10 % 3]] if i % 10 == 0 else []), *words[rng.integers(0, 300, 6)]]) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return docs, docs.where("doc_id % 4 != 3").select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))


def test_every_labelled_row_is_trained_on_or_calibrates(spark, monkeypatch):
    docs, labels = labelled(spark, 6400)
    trained, judged = [], []
    train, best = toxicity.train, toxicity.best_threshold
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "train", lambda texts, y, seed=7: trained.append(len(texts)) or train(texts, y, seed))
    monkeypatch.setattr(toxicity, "best_threshold", lambda z, y, f, n=None: judged.append(len(y) if n is None else int(n.sum())) or best(z, y, f, *([] if n is None else [n])))
    toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert trained[0] + judged[0] == labels.count() == 4800


@pytest.mark.parametrize("parts", [2, 5])
def test_shards_learn_what_one_fit_learns(spark, monkeypatch, parts):
    docs, labels = labelled(spark, 3200)
    monkeypatch.setattr(toxicity, "SHARD", 500)
    monkeypatch.setattr(toxicity, "train", None)  # not on the driver
    model = toxicity.fit_toxicity(docs.repartition(parts), labels.repartition(parts), F.lit(True))
    got = toxicity.score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", "toxicity.score").toPandas().sort_values("doc_id")
    assert ((got.score >= 0.5) == (got.doc_id % 10 == 0)).mean() > 0.99
    again = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert np.array_equal(again.table, model.table) and again.thresholds == model.thresholds


def test_thresholds_of_counted_logits_are_those_of_rows():
    rng = np.random.default_rng(3)
    z = rng.integers(-40, 40, 500) / 8
    y = (rng.random(500) < 1 / (1 + np.exp(-z))).astype(np.int64)
    one, where = np.unique(z, return_inverse=True)
    assert toxicity.best_threshold(z, y, 0.0) == toxicity.best_threshold(one, np.bincount(where, y), 0.0, np.bincount(where))
