"""The generator's invariants, files read back, and alerts from the models over a generated ledger."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import graph, metrics
from ledgerweave.plans import catalog
from ledgerweave.sources import files, generator
from ledgerweave.sources.ledger import RECORD, from_records, read_json


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger") / "documents")
    files.write_parquet(generator.generate(spark, 1), path)
    return spark.read.parquet(path)


def test_markets_keep_the_ledger_invariants(spark, documents):
    rows = documents.collect()
    assert 900 < len(rows) < 1300 and len({r.txid for r in rows}) == len(rows)
    assert {r.pattern_type for r in rows} == {"normal", "peeling", "fanout", "fanin", "coinjoin"}
    spent = [p for r in rows for p in r.input_prevouts]
    assert len(spent) == len(set(spent))
    made = {f"{r.txid}:{n}": (a, x) for r in rows for n, (a, x) in enumerate(zip(r.output_addresses, r.output_amounts, strict=True))}
    for r in rows:
        assert r.src_ip != r.dst_ip and r.fee >= 0 and abs(r.fee - (sum(r.input_amounts) - sum(r.output_amounts))) < 1e-6
        assert len(r.input_addresses) == len(r.input_amounts) == len(r.input_prevouts)
        for p, a, x in zip(r.input_prevouts, r.input_addresses, r.input_amounts, strict=True):
            assert made.get(p, (a, x)) == (a, x)
    assert len({r.chain_id for r in rows if r.chain_id}) == 18 and sum(r.pattern_type == "coinjoin" for r in rows) == 5
    again = generator.generate(spark, 2)
    assert again.join(documents, "txid", "left_semi").count() == len(rows) and again.count() > len(rows)
    times = [r.timestamp for r in generator.in_time_order(documents).collect()]
    assert times == sorted(times)


def test_json_csv_and_parquet_are_read_back(spark, documents, tmp_path):
    files.write_json(documents, f"{tmp_path}/lines")
    assert files.read_json_lines(spark, f"{tmp_path}/lines", RECORD).exceptAll(documents).count() == 0
    array = tmp_path / "array.json"
    array.write_text(json.dumps([json.loads(x.value) for x in spark.read.text(f"{tmp_path}/lines").limit(20).collect()]))
    assert read_json(spark, str(array)).count() == 20
    files.write_csv(documents, f"{tmp_path}/table")
    assert files.read_csv(spark, f"{tmp_path}/table", RECORD).exceptAll(documents).count() == 0
    odd = spark.createDataFrame([("a,\"b\"\nc", None, [1.5, None]), ("", "x", None), (None, "", [])], "s string, t string, l array<double>")
    files.write_csv(odd, f"{tmp_path}/odd")
    back = {(r.s, r.t, None if r.l is None else tuple(r.l)) for r in files.read_csv(spark, f"{tmp_path}/odd", odd.schema, empty="").collect()}
    assert back == {('a,"b"\nc', "", (1.5, None)), ("", "x", None), ("", "", ())}


def test_detection_over_a_generated_ledger(spark, documents):
    led = from_records(documents)
    mixes = metrics.mix_detection(led, graph.coinjoin_like(led)).first()
    assert (mixes.mixes, mixes.recall) == (5, 1.0)
    merges = metrics.false_merges(led).first()
    assert merges.merge_pairs > 0 and merges.false_merge_pairs <= merges.merge_pairs
    change = metrics.change_detection(led, graph.change_predictions(led)).first()
    assert change.precision > 0.7 and 0 < change.recall <= 1


def test_final_alerts_fuse_and_explain_the_models(spark):
    rows = catalog.QUERIES["final_alerts"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.wallet for r in rows})
    key = [(-r.final_risk, -r.tie_break_score) for r in rows]
    assert key == sorted(key)
    for r in rows:
        assert abs(r.final_risk - (1 - (1 - r.risk_propagated) * (1 - r.risk_anomaly) * (1 - r.risk_peeling))) < 1e-9
        assert ("[Anomaly]" in r.final_explanation) == (r.risk_anomaly > 0.5)
        assert ("[Peeling-chain" in r.final_explanation) == (r.risk_peeling > 0.5)
    assert max(r.risk_anomaly for r in rows) == 1.0 and any(r.peeling_reason for r in rows)
