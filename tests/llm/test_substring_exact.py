"""Removed bytes, spans and digests against counting all windows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import queries, substring_exact


def brute(texts, length):
    """n_bytes, n_removed, n_spans and digest of each text, by counting every window."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mask = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                mask[i + 1 : i + 1 + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~mask[1:-1]])
        out.append((len(r), int(mask.sum()), int((mask[1:] & ~mask[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def digest(out):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").alias("n_spans"), F.sha2("kept", 256).alias("kept"))


def check(spark, rows, length, **kw):
    got, want = defaultdict(list), defaultdict(list)
    for r in digest(substring_exact.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, **kw)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept))
    for (i, _), w in zip(rows, brute([t for _, t in rows], length), strict=True):
        want[i].append(w)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("hot, shard, scan", [(1, 1 << 19, 1 << 18), (3, 300, 50), (4096, 1 << 19, 1 << 18), (4096, 200, 7)])
def test_all_columns_match_counting_all_windows(spark, monkeypatch, hot, shard, scan):
    monkeypatch.setattr(substring_exact, "GRAM", 8)
    monkeypatch.setattr(substring_exact.scanned, "__defaults__", (scan,))
    rng = np.random.default_rng(hot + shard)
    pool = ["".join(rng.choice(list("abcdé"), int(rng.integers(5, 60)))) for _ in range(10)]
    rows = [(i, "".join(pool[int(rng.integers(10))] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefghij"), 20)) for _ in range(int(rng.integers(0, 6))))) for i in range(50)]
    rows += [(5, rows[5][1]), (77, "a" * 70), (78, "ab" * 40), (79, None), (80, ""), (None, pool[0] * 3), (None, pool[0] * 3), (None, None)]
    check(spark, rows, 20, hot=hot, shard_bytes=shard)


@pytest.mark.parametrize("hot", [2, 20, 1024])
def test_a_passage_with_other_text_around_it_in_many_documents(spark, hot):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    passage, near = text(330), text(190)
    rows = [(i, text(int(rng.integers(0, 150))) + passage + text(int(rng.integers(0, 150)))) for i in range(60)]
    rows += [(100 + i, text(40) + near + str(i % 7) * int(rng.integers(5, 20)) + text(30)) for i in range(60)]
    check(spark, rows, 200, hot=hot)


def test_all_of_a_small_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute([t for _, t in rows], 200), strict=True)}


def test_joins_are_merged_at_every_size(spark, monkeypatch):
    from ledgerweave.llm import substring_exact

    plans, write = [], substring_exact.cut
    monkeypatch.setattr(substring_exact, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    docs = spark.createDataFrame([(i, "".join(chr(97 + (i % 3 * 7 + k * k) % 26) for k in range(300))) for i in range(6)], "doc_id long, text string")
    assert substring_exact.remove_repeats(docs).count() == 6
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("listed", [1 << 20, 1])
def test_a_hot_owner_costs_no_further_exchange_of_the_texts(spark, monkeypatch, listed):
    plans, write = [], substring_exact.cut
    monkeypatch.setattr(substring_exact, "LISTED", listed, raising=False)
    monkeypatch.setattr(substring_exact, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    passages = [text(330), text(260)]
    rows = [(i, text(int(rng.integers(0, 90))) + passages[i % 2] + text(int(rng.integers(0, 90)))) for i in range(40)]
    check(spark, [*rows, rows[3], (99, rows[4][1])], 200, hot=2)
    assert len(plans) > 4  # owners were divided
    assert any("whole" in p for p in plans) == (listed == 1)


def test_a_text_has_the_same_pieces_beside_any_rows():
    rng = np.random.default_rng(6)
    rows = [rng.integers(97, 123, int(n)).astype(np.uint8) for n in (30, 500, 0, 5, 90, 70, 20, 300)]
    for limit in (7, 64, 100, 10000):
        offsets = np.cumsum([0, *[len(r) for r in rows]])
        row, *found = substring_exact.scanned(np.concatenate(rows), offsets, 20, 8, limit)
        for i, r in enumerate(rows):
            alone = substring_exact.scanned(r, np.array([0, len(r)]), 20, 8, limit)[1:]
            assert all(np.array_equal(x[row == i], y) for x, y in zip(found, alone, strict=True))
            assert int(alone[1].sum()) == max(0, len(r) - 19)
