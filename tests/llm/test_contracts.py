"""Whole query results against brute force, bounds of samples, and what the models recover."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerweave.llm import fingerprint, langid, mixing, pii, quality, queries, toxicity

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_components_match_brute_force(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    prints = {i: simhash(t) for i, t in docs.items()}
    component = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[a] > component[b]:
                    component[a], changed = component[b], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in docs}


@pytest.mark.parametrize("ids", ["null", "7"])
def test_models_do_not_depend_on_ids(spark, ids):
    docs = queries.table(spark, MIDDLE, "documents").withColumn("doc_id", F.expr(f"cast({ids} as bigint)"))
    model = langid.fit_languages(docs, F.lit(True), sample=50)
    assert model.languages == sorted(r.lang for r in docs.where("lang is not null").select("lang").distinct().collect())
    got = langid.identify(docs.where("lang is not null and text rlike '[A-Za-z]{3}'"), model)
    assert got.where("language.lang = lang").count() >= 0.95 * got.count()
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert toxicity.fit_toxicity(docs, labels, F.lit(True)) is None  # one class, or no ids


def test_more_languages_than_the_old_limit_are_learned(spark):
    rows = [(f"l{i:03}", chr(0x4E00 + 30 * i + j) * 3 + chr(0x4E00 + 30 * i + j + 1)) for i in range(300) for j in range(4)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit_languages(docs, F.lit(True))
    assert len(model.languages) == 300


def test_a_repeated_id_does_not_pass_the_bound_of_the_toxicity_sample(spark):
    docs = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    sizes = []
    kept = toxicity.train
    try:
        toxicity.train = lambda texts, y, seed=7: sizes.append(len(texts)) or kept(texts, y, seed)
        toxicity.fit_toxicity(docs, labels, F.lit(True), sample=100)
    finally:
        toxicity.train = kept
    assert not sizes or sizes[0] <= 200


def test_toxicity_on_held_out_rows(spark):
    got = queries.op7_toxicity(spark, MIDDLE).where("held_out").join(queries.table(spark, MIDDLE, "labels"), "doc_id").where("toxic is not null").toPandas()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert len(got) > 50 and (got.predicted == got.toxic).mean() > 0.85 and hits >= 0.5 * (got.toxic == 1).sum()


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.75, 0.7, 0.6])
    right = rng.random((20000, 6)) < accuracy
    votes = np.where(right == truth[:, None], quality.GOOD, quality.BAD)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, found = quality.estimate(patterns, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.06
    _, where = np.unique(votes, axis=0, return_inverse=True)
    assert ((post[where.ravel()] > 0.5) == truth).mean() > 0.93


def test_quality_scores_agree_with_labels_it_never_saw(spark):
    got = queries.op10_quality(spark, MIDDLE).join(queries.table(spark, MIDDLE, "labels"), "doc_id").where("quality is not null").toPandas()
    assert (got["keep"].astype(int) == got.quality).mean() > 0.95


def test_the_fitted_scorer_solves_its_normal_equations():
    rng = np.random.default_rng(3)
    x, post = rng.random((40, 12)).astype(np.float32), rng.random(40)
    w, shift = quality.fit_scorer(x, post)
    y = np.log(np.clip(post, 0.02, 0.98) / (1 - np.clip(post, 0.02, 0.98)))
    want = np.linalg.solve(x.T @ x + 4e-3 * np.eye(12), x.T @ (y - y.mean()))
    assert np.allclose(w, want, atol=2e-2) and shift == pytest.approx(y.mean())


def test_mix_of_rows_without_ids_comes_near_its_targets(spark):
    docs = spark.range(4000).select(F.expr("cast(null as bigint)").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mixing.mix_counts(docs).groupBy("source").agg(F.sum(F.col("mix.size") * F.col("mix.copies")).alias("taken"), F.max("mix.target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in got)


def test_redaction_of_many_spans_matches_plain_slicing(spark):
    rng = np.random.default_rng(5)
    parts = ["joe@x.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "é😀 word ", "token=" + "ab1" * 90 + " ", "GB82WEST12345698765432 ", "x" * 700 + " ", " , ", "mail "]
    texts = [" ".join(rng.choice(parts, int(rng.integers(0, 120)))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.pii for r in pii.find_pii(frame).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for s in found[i]:
            if s.s >= at:
                out += t[at : s.s] + f"<{s.kind}>"
            at = max(at, s.e)
        assert clean[i] == out + t[at:], i
        base = [s for s in found[i] if s.k < 4]
        assert not any(b.s < s.e and s.s < b.e for s in found[i] if s.k >= 4 for b in base)
        assert sum(s.kind == "secret" for s in found[i]) == t.count("token=")


def test_secrets_of_any_length_and_many_matches(spark):
    texts = [f"token={'a1' * n} end" for n in (10, 100, 101, 5000)] + ["mail joe.smith@example.org now " * 9000]
    clean = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert clean[:4] == ["<secret> end"] * 4 and clean[4] == "mail <email> now " * 9000


def test_sketch_lanes_wrap_without_touching_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "KEPT", fingerprint.FIELDS * 31)
    monkeypatch.setattr(fingerprint, "LOW20", 31)
    texts = ["same line\n" * n for n in (1, 31, 32, 33, 1000)]
    frame = fingerprint.add_vector(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"), "v")
    vectors = [r.v for r in frame.select("v").collect()]
    lanes = [[w >> s & 31 for w in v[8:-1] for s in (0, 21, 42)] for v in vectors]
    one = lanes[0]
    for v, n in zip(lanes, (1, 31, 32, 33, 1000), strict=True):
        assert v == [x * n % 32 for x in one]


@pytest.mark.parametrize("kind", ["long", "string", "double", "hot"])
def test_next_documents_over_many_ranges(spark, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 100)
    make = {"long": lambda i: i * 3 % 1009, "string": lambda i: f"doc{i * 7 % 1013:05d}", "double": lambda i: i / 7, "hot": lambda i: None if i % 3 == 0 else 5 if i % 3 == 1 else i}[kind]
    rows = [(make(i), f"t{i * 31 % 997} x {i}") for i in range(1200)]
    rows += [rows[0]] * 5
    frame = spark.createDataFrame(rows, f"doc_id {'long' if kind == 'hot' else kind}, text string")
    tie = {r.text: r.t for r in frame.select("text", F.shiftrightunsigned(F.xxhash64(F.lit("tie"), "text"), 11).alias("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, tie[r[1]], r[1]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    got = fingerprint.with_next(frame, "doc_id", "text").select("doc_id", "text", "next_text").collect()
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in got) == want
