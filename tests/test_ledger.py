"""The ledger operators: hand-built cases, and every query against DuckDB."""

import glob
import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerweave.functions.scalar import ip_geo, md5_mod, noisy_or, risk_color
from ledgerweave.operators import features, forest, graph, metrics, validation
from ledgerweave.operators.components import connected_components
from ledgerweave.plans import catalog
from ledgerweave.sources.ledger import RECORD, from_records

SMALL = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def ledger(spark, txs):
    """txs: (txid, minutes, inputs, outputs), each a list of (wallet, amount)."""
    rows = [{"txid": t, "timestamp": T0 + timedelta(minutes=m), "src_ip": "8.8.8.8", "dst_ip": "1.1.1.1", "fee": 0.0, "label": "normal", "input_addresses": [a for a, _ in i], "input_amounts": [float(x) for _, x in i], "input_prevouts": ["p:0" for _ in i], "output_addresses": [a for a, _ in o], "output_amounts": [float(x) for _, x in o], "output_entity_ground_truth": [1 for _ in o], "is_change_ground_truth": [False for _ in o]} for t, m, i, o in txs]
    return from_records(spark.createDataFrame(rows, RECORD))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda x: "null" if pd.isna(x) else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_components(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "D"), ("E", None)], "src string, dst string")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}
    line = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(line).select("component").distinct().count() == 1


def test_peel_boundaries_and_chain_rules(spark):
    hop = lambda t, m, src, dst: (t, m, [(src, 10)], [(f"s{t}", 1), (dst, 9)])
    led = ledger(spark, [hop("t1", 0, "a", "b"), hop("t2", 1, "b", "c"), hop("t3", 0, "x", "b"), ("t4", 2, [("c", 9)], [("y", 3), ("z", 10)]), hop("t5", 3, "c", "d"), ("t6", 1, [("q", 1)], [("a", 0), ("b", 0)])])
    chains = graph.peeling_chains(led).orderBy("chain", "hop").collect()
    # t4 is the earliest spend of c and does not qualify (ratio exactly 0.3), so both chains end at the shared t2
    assert [(r.chain, r.hop, r.txid) for r in chains] == [("t1", 0, "t1"), ("t1", 1, "t2"), ("t3", 0, "t3"), ("t3", 1, "t2")]


def test_spend_at_the_same_time_is_no_successor(spark):
    led = ledger(spark, [("t1", 5, [("a", 10)], [("s", 1), ("b", 9)]), ("t2", 5, [("b", 9)], [("x", 1), ("y", 8)])])
    spots = graph.peel_shaped(led).where("txid = 't1'").select("txid", "ts", "large_wallet")
    assert graph.next_spend(spots, led, "large_wallet").first().next_txid is None


def test_edges_are_counted_and_frequency_of_one_transaction(spark):
    led = ledger(spark, [("t1", 0, [("a", 1), ("a", 2)], [("b", 3)])])
    row = features.amount_features(led).where("wallet = 'a'").first()
    assert (row.fan_out_degree, row.tx_count, round(row.tx_frequency_per_day)) == (2, 1, 1_000_000)
    hours = ledger(spark, [(f"t{h}", 60 * h, [("a", 1)], [("b", 1)]) for h in range(24)])
    assert features.entropy(hours).where("wallet = 'a'").first().time_of_day_entropy == pytest.approx(np.log2(24))


def test_fresh_after_being_an_input_and_change(spark):
    led = ledger(spark, [("t0", 0, [("c", 1)], [("old", 1)]), ("t1", 1, [("a", 5)], [("old", 1), ("c", 4)]), ("t2", 2, [("a", 5)], [("n1", 1), ("n2", 4)])])
    assert [tuple(r) for r in graph.change_predictions(led).collect()] == [("t1", "c")]


def test_scalars(spark):
    r = spark.range(1).select(md5_mod(F.lit("8.8.8.8"), 64000).alias("m"), ip_geo(F.lit("8.8.8.8")).alias("g"), risk_color(F.lit(2.0)).alias("c"), noisy_or(F.lit(0.5), F.lit(0.5)).alias("n")).first()
    assert (r.m, r.g.asn, r.c, r.n) == (45243, "AS46243", "#e61e3c", 0.75)


def test_metrics_ties_and_half_even(spark):
    scored = spark.createDataFrame([(1, 0.5, 1), (2, 0.5, 0), (3, 0.1, 1)], "wallet long, score double, y int")
    assert metrics.average_precision(scored).first()[0] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    many = spark.range(965).select(F.col("id").alias("wallet"), F.lit(1.0).alias("score"), F.lit(1).alias("y"))
    assert [metrics.flag_top(many, s).where("flagged").count() for s in (0.1, 0.3)] == [96, 290]


def test_top_shares_and_curves_over_many_ranges_match_a_sort(spark):
    rng = np.random.default_rng(6)
    for key in ("long", "string"):
        rows = [((i if key == "long" else f"k{i:04}"), float(rng.integers(0, 40)), int(rng.random() < 0.3)) for i in range(700)]
        scored = spark.createDataFrame(rows, f"wallet {key}, score double, y int")
        got = metrics.precision_recall_at(scored).collect()
        order = sorted(rows, key=lambda r: (-r[1], r[0]))
        for r in got:
            top = order[: round(700 * r.share)]
            assert (r.flagged, r.precision) == (len(top), pytest.approx(sum(x[2] for x in top) / len(top)))
            assert {x.wallet for x in metrics.flag_top(scored, r.share).where("flagged").collect()} == {x[0] for x in top}
    steps = {r.score: (r.tp, r["all"]) for r in metrics.curve(scored).collect()}
    assert steps == {s: (sum(r[2] for r in rows if r[1] >= s), sum(r[1] >= s for r in rows)) for s in {r[1] for r in rows}}


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0)], "src string, dst string, amount double")
    ranks = graph.pagerank(edges, spark.createDataFrame([("a",)], "node string"))
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_shap_values_add_up():
    x = np.random.default_rng(0).normal(size=(200, 4))
    model = forest.Forest(list("abcd"), [forest.grow(x[:64], i) for i in range(10)], 64)
    assert np.allclose(model.shap(x).sum(1), model.base_depth() - model.depth(x))


def chain_table(spark, n):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, *(float(v) for v in rng.normal(size=len(forest.CHAIN_FEATURES)) + 3 * (i % 2))) for i in range(n)]
    return spark.createDataFrame(rows, "chain long, label int, " + ", ".join(f"{c} double" for c in forest.CHAIN_FEATURES))


def test_chain_validation(spark):
    rows = chain_table(spark, 40)
    held = validation.stratified(rows).where("held").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in held} == {0: 6, 1: 6}
    for scored in (validation.hold_out(rows), validation.leave_one_out(rows, trees=20)):
        got = validation.report(scored).first()
        assert got.precision > 0.8 and got.recall > 0.8 and got.tn + got.fp + got.fn + got.tp == scored.count()
    assert sum(r.importance for r in validation.importances(rows).collect()) == pytest.approx(1)
    assert validation.hold_out(chain_table(spark, 12)).count() == 0
    with pytest.raises(ValueError, match="hold_out"):
        validation.leave_one_out(rows, most=39)


def test_chain_validation_of_no_rows_and_one_class(spark):
    none = chain_table(spark, 2).limit(0)
    assert validation.leave_one_out(none).count() == 0 and validation.explain_chains(none).count() == 0
    assert validation.report(validation.hold_out(none)).first().asDict() == {"tn": 0, "fp": 0, "fn": 0, "tp": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    assert {r.importance for r in validation.importances(chain_table(spark, 20).where("label = 1")).collect()} == {0.0}


def test_chain_reasons_add_up(spark):
    out = validation.explain_chains(chain_table(spark, 30)).toPandas()
    total = out[[f"shap_{c}" for c in forest.CHAIN_FEATURES]].sum(axis=1) - out["predicted_probability"]
    assert np.allclose(total, total.iloc[0]) and out.loc[out.label == 1, "shap_reason"].str.startswith("Driven by").all()


def _share_without(x, y, w, i, seed, depth=3):
    """The share in row i's leaf of a tree grown, plainly, from the other rows."""
    rows, level, path = np.array([j for j in range(len(x)) if j != i and w[j] > 0], int), 0, 0
    while True:
        n, ones = w[rows].sum(), (w * y)[rows].sum()
        if level == depth or not 0 < ones < n:
            return ones / n if n else 0.0
        best, found = -1.0, None
        order = np.random.default_rng([*seed, level, path]).permutation(x.shape[1])
        for f in [f for f in order if len(set(x[rows, f])) > 1][: int(np.sqrt(x.shape[1]))]:
            values = sorted(set(x[rows, f]))
            for a, b in zip(values, values[1:]):
                purity = 0.0
                for part in (rows[x[rows, f] <= a], rows[x[rows, f] > a]):
                    m, k = w[part].sum(), (w * y)[part].sum()
                    purity += (k * k + (m - k) ** 2) / m
                if purity > best:
                    best, found = purity, (f, (a + b) / 2)
        f, cut = found
        low = x[i, f] <= cut
        rows = rows[(x[rows, f] <= cut) == low]
        level, path = level + 1, 2 * path + int(not low)


@pytest.mark.parametrize("digits", [0, 1, 6])
def test_left_out_shares_equal_a_fit_for_each_row(digits):
    rng = np.random.default_rng(digits)
    for n in (1, 2, 3, 40):
        x, y = np.round(rng.normal(size=(n, 10)), digits), rng.integers(0, 2, n).astype(float)
        x[:, 3] = 1.0
        for tree in range(5):
            w = validation.drawn(rng.integers(-(2**62), 2**62, n), tree, 7)
            got = validation.left_out_shares(x, y, w, [7, tree])
            assert got.tolist() == pytest.approx([_share_without(x, y, w, i, [7, tree]) for i in range(n)], abs=1e-12)


def test_leave_one_out_has_no_limit(spark):
    got = validation.leave_one_out(chain_table(spark, 5100), trees=2)
    assert got.count() == got.select("chain").distinct().count() == 5100 and validation.report(got).first().recall > 0.8


def test_shap_values_of_a_leaf_are_those_of_all_orders():
    from itertools import permutations
    from math import prod

    leaf = forest.Leaf(2.0, {1: (0.0, 1.0), 3: (-np.inf, 0.5), 0: (0.2, np.inf)}, {1: 0.5, 3: 0.25, 0: 0.7})
    x = np.random.default_rng(1).normal(size=(50, 4))
    got = forest.Forest(list("abcd"), [[leaf]], 4).shap(x)
    for row, values in zip(x, got, strict=True):
        inside = {f: float(lo < row[f] <= hi) for f, (lo, hi) in leaf.bounds.items()}
        worth = lambda some: -leaf.depth * prod(inside[f] if f in some else leaf.shares[f] for f in leaf.bounds)  # noqa: E731, B023
        for f in leaf.bounds:
            gains = [worth(o[: o.index(f) + 1]) - worth(o[: o.index(f)]) for o in permutations(leaf.bounds)]
            assert values[f] == pytest.approx(sum(gains) / len(gains))
        assert values[2] == 0


def test_explained_forest_is_grown_from_all_rows(spark):
    # label 1 only where a hash-chosen half of the rows, which the forest once was grown from, has none
    rows = spark.range(40000).withColumn("label", F.expr(f"int(pmod(xxhash64(42, id), {1 << 30}) >= {1 << 29})")).withColumnRenamed("id", "chain")
    rows = rows.select("chain", "label", *[(F.col("label") + F.rand(i)).alias(c) for i, c in enumerate(forest.CHAIN_FEATURES)])
    got = {r.label: r for r in validation.explain_chains(rows).groupBy("label").agg(F.min("predicted_probability").alias("least"), F.max("predicted_probability").alias("most"), F.count("*").alias("n")).collect()}
    assert got[0].n + got[1].n == 40000 and got[0].most < 0.1 and got[1].least > 0.9


@pytest.mark.parametrize("digits", [0, 6])
def test_forest_of_the_executors_equals_the_drivers(spark, digits):
    rng = np.random.default_rng(digits)
    names, n = list(forest.CHAIN_FEATURES), 700
    x, y = np.round(rng.normal(size=(n, len(names))), digits), rng.integers(0, 2, n)
    x[:, 0] += y
    x[:, 1] = 2.0  # one value in all blocks
    x[:600, 2] = 3.0
    x[::50, 4] = np.nan
    x[0, 5], x[1, 5] = np.inf, -np.inf
    rows = spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], "chain long, label int, " + ", ".join(f"{c} double" for c in names)).cache()
    keys = np.array([r[0] for r in rows.orderBy("chain").select(F.xxhash64("chain")).collect()])
    want = validation.grow_forest(x, y.astype(float), keys, trees=6)
    got = validation.grow_apart(rows, n, trees=6, block=100)
    assert got.trees == want.trees and max(len(t) for t in want.trees) == 8


@pytest.mark.parametrize("n", [1, 2, 3, 60])
def test_a_grown_tree_has_the_shares_of_plain_growth(n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, 10)), rng.integers(0, 2, n).astype(float)
    for tree in range(5):
        w = np.append(validation.drawn(rng.integers(-(2**62), 2**62, n), tree, 7), 0.0)  # one more row, not drawn
        if w.any():
            far, mark = np.vstack((x, rng.normal(size=10))), np.append(y, 0.0)
            leaves = validation.grow(far, mark, w, 7, tree)
            share = -forest.Forest(list(forest.CHAIN_FEATURES), [leaves], n).depth(far[-1:])[0]
            assert share == pytest.approx(_share_without(far, mark, w, n, [7, tree]), abs=1e-12)


def test_probability_of_one_class_is_sure(spark):
    got = validation.explain_chains(chain_table(spark, 6).where("label = 1").limit(1)).first()
    assert got.predicted_probability == 1.0 and got.shap_hop_count == 0.0


def test_anomaly_trees_draw_from_all_rows(spark):
    # far only where a hash-chosen part of the rows, which all trees once drew from, has none
    far = F.expr(f"int(pmod(xxhash64(42, wallet), {1 << 30}) >= {int((1 << 30) * 0.4096)})")
    rows = spark.range(20000).withColumnRenamed("id", "wallet").select("wallet", (F.rand(1) + 10 * far).alias("a"), F.rand(2).alias("b")).cache()
    model = forest.fit(rows, ["a", "b"], trees=20)
    assert any(lo > 1 for tree in model.trees for leaf in tree for lo, _ in leaf.bounds.values())


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_anomaly_trees_are_those_of_their_lowest_hashes(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "wallet").select("wallet", (F.col("wallet") * 37 % 101).cast("double").alias("a"))
    table = rows.select(F.xxhash64("wallet").alias("order"), "a").toPandas().sort_values("order")
    x, keys = table[["a"]].to_numpy(), table["order"].to_numpy()
    want = [forest.grow(x[np.argsort(forest.places(keys, t, 42), kind="stable")[:8]], 42 + t) for t in range(5)]
    model = forest.fit(rows, ["a"], trees=5, sample=8)
    assert model.trees == want and model.size == min(8, n)
