import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import fingerprint, pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(s, e, kind) for s, k, kind, e in sorted(out)]


CASES = [
    None,
    "",
    "no data at all",
    "a@b.c_d@e.f x@y@z.w .@-.-- a@b a@b..c é@é.fr user@host.co.uk.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1.2.3 9.9.9.9999.1.1.1.1 192.168.000.1x",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111 1111 1111 41111111111111111111111 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1",
    "+1 (743) 555-3824 ++49 30 123456 +12 +1234567890123456 +1-2-3-4-5-6-7-8-9 call +33.1.23.45.67.89.",
    "mixed é 😀 +1 (743) 555-3824 😀 joe@x.org 4111111111111111, 10.0.0.1",
    "1" * 30000 + " " + "a" * 30000 + "@" + "b." * 9000 + "c " + "+" + "1 " * 20000 + "1.1." * 5000,
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" iban GB82 WEST 1234 5698 7654 32 iban GB82WEST12345698765433",
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_match_plain_regular_expressions(spark, tmp_path):
    rng = np.random.default_rng(3)
    alphabet = list("0123456789011 ..--+()@aé_%\n")
    texts = CASES + ["".join(rng.choice(alphabet, int(rng.integers(1, 200)))) for _ in range(400)]
    rows(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (text or "")[:300]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[2] == k for x in want) for k in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))


def test_added_kinds_and_redaction(spark):
    found = {r.doc_id: [s.kind for s in r.pii] for r in pii.find_pii(rows(spark, CASES)).collect()}
    assert found[9] == ["secret", "iban"]
    clean = {r.doc_id: r.text for r in pii.redact(rows(spark, CASES)).collect()}
    assert clean[7] == "mixed é 😀 <phone> 😀 <email> <card>, <ip>"
    assert clean[0] is None and clean[1] == "" and clean[2] == CASES[2]


def test_clashing_columns_and_empty_table(spark):
    frame = rows(spark, ["joe@x.org"]).select("doc_id", "text", F.lit(1).alias("pii"), F.lit(2).alias("pii_text"), F.lit(3).alias("pii_found"))
    assert pii.redact(frame).columns == frame.columns
    assert pii.redact(frame).first().text == "<email>"
    assert pii.redact(frame.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[5, 3, 9, 4, None], [1, 1, 1, 2, 2]])
def test_edited_texts_and_next_document(spark, tmp_path, ids):
    texts = ["one\ntwo\nthrée 😀 four", None, "x", "the last one is longer than the others", ""]
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_fingerprint(spark, str(tmp_path)).collect()
    order = sorted(((i is not None, i or 0), t or "") for i, t in zip(ids, texts, strict=True))
    want = []
    for n, (key, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((key[1] if key[0] else None, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)


def test_fingerprints_are_homomorphic_and_ordered(spark):
    a, b = "alpha beta\ngamma", "delta\nepsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    frame = spark.createDataFrame([(a, b, a + "\n" + b, b + "\n" + a)], "a string, b string, ab string, ba string")
    for c in ("a", "b", "ab", "ba"):
        frame = fingerprint.add_vector(frame, F.col(c), f"v_{c}")
    v = {c: F.col(f"v_{c}") for c in ("a", "b", "ab", "ba")}
    r = frame.select(
        (v["ab"] == v["ba"]).alias("order"), (fingerprint.combine(v["a"], v["b"]) == v["ab"]).alias("insert"), (fingerprint.combine(v["ab"], v["b"], -1) == v["a"]).alias("delete"), fingerprint.likeness(v["a"], v["a"]).alias("same"), fingerprint.likeness(v["a"], v["b"]).alias("other"), (fingerprint.as_text(v["a"]) == fingerprint.as_text(v["b"])).alias("equal")
    ).first()
    assert r.order and r.insert and r.delete and r.same == 1.0 and r.other < 0.7 and not r.equal


def test_half_kept_texts_are_nearer_than_the_next(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    got = queries.op8_fingerprint(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == docs.count()
    longer = got[got.n_chars > 400]
    assert (longer.near_edited > 0.25).mean() > 0.97
    assert (longer.near_edited > longer.near_next).mean() > 0.97


def test_unrelated_texts_are_far_apart(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join("w" + str(x) for x in rng.integers(0, 10**6, 200)) for _ in range(1500)]
    frame = rows(spark, texts).select(F.col("text").alias("a"), F.reverse("text").alias("b"))
    frame = fingerprint.add_vector(fingerprint.add_vector(frame, F.col("a"), "u"), F.col("b"), "v")
    near = frame.select(fingerprint.likeness(F.col("u"), F.col("v")).alias("near")).toPandas().near
    assert (near**2).mean() ** 0.5 < 0.076  # 126 lanes: about 0.063; 63 lanes: about 0.089
