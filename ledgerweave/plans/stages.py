"""Named stages run in order in one session: each writes Parquet tables for the next, the first failure ends the run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import alerts, features, forest, graph, risk, validation
from ledgerweave.sources import files, generator
from ledgerweave.sources.ledger import Ledger, from_records

SEED_ENTITIES = [0, 1, 2, 3, 4]
Stage = Callable[[SparkSession, str], dict[str, DataFrame]]


@dataclass
class Outcome:
    name: str
    ok: bool
    seconds: float
    error: str = ""


class StageFailed(RuntimeError):
    """A stage failed; ``outcomes`` are those of all stages begun, the failed one last."""

    def __init__(self, outcomes: list[Outcome]) -> None:
        super().__init__(f"stage {outcomes[-1].name!r} failed: {outcomes[-1].error}")
        self.outcomes = outcomes


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Stage]], say: Callable[[str], None] = print) -> list[Outcome]:
    """Run ``stages`` over ``folder``, which all executors must share. A table is written as ``folder/name``.

    The outcomes of a run without a failure; otherwise :class:`StageFailed`, and later stages are not begun.
    """
    done: list[Outcome] = []
    for name, stage in stages:
        begun = time.monotonic()
        try:
            for table, frame in stage(spark, folder).items():
                files.write_parquet(frame, f"{folder.rstrip('/')}/{table}")
        except Exception as error:
            done.append(Outcome(name, False, time.monotonic() - begun, str(error)))
            say(f"[FAILED] {name} ({done[-1].seconds:.1f} s)")
            raise StageFailed(done) from error
        done.append(Outcome(name, True, time.monotonic() - begun))
        say(f"[OK] {name} ({done[-1].seconds:.1f} s)")
    return done


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}")


def _ledger(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(*[_read(spark, folder, t) for t in ("txs", "tx_inputs", "tx_outputs", "tx_relay")])


def _dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"documents": generator.generate(spark)}


def _graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    ledger = from_records(_read(spark, folder, "documents"))
    return {"txs": ledger.txs, "tx_inputs": ledger.inputs, "tx_outputs": ledger.outputs, "tx_relay": ledger.relay, "wallets": graph.wallet_nodes(ledger)}


def _clusters(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    ledger = _ledger(spark, folder)
    return {"clusters": graph.clusters(ledger, graph.combined_edges(ledger)), "change": graph.change_predictions(ledger)}


def _features(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"wallet_features": features.with_logs(features.wallet_features(_ledger(spark, folder)))}


def _anomaly(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    data = _read(spark, folder, "wallet_features")
    model = forest.fit(data, list(features.MODEL))
    return {"anomaly_scores": forest.score(data, model, "anomaly_score"), "anomaly_reasons": forest.explain(data, model)}


def _chains(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    ledger = _ledger(spark, folder)
    return {"chains": graph.peeling_chains(ledger), "mixes": graph.coinjoin_like(ledger)}


def _classifier(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    rows = graph.chain_features(_ledger(spark, folder), _read(spark, folder, "chains"))
    return {"chain_scores": validation.explain_chains(rows)}


def _risk(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    ledger = _ledger(spark, folder)
    seeds = risk.select_seeds(_read(spark, folder, "wallets"), SEED_ENTITIES)
    ranks = graph.pagerank(graph.flow_edges(ledger), seeds.select(F.concat(F.lit("w"), "wallet").alias("node"))).where(F.col("node").startswith("w"))
    wallets = ranks.select(F.expr("substring(node, 2)").alias("wallet"), "rank")
    top = wallets.agg(F.max("rank").alias("top"))  # one row
    return {"seeds": seeds, "propagated": wallets.crossJoin(F.broadcast(top)).select("wallet", (F.col("rank") / F.col("top")).alias("risk_propagated"))}


def _alerts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = alerts.final_alerts(_ledger(spark, folder), _read(spark, folder, "propagated"), _read(spark, folder, "seeds"))
    return {"alerts": risk.ranked(found)}


#: The ledger's stages, from generated documents to explained alerts.
LEDGER_STAGES: list[tuple[str, Stage]] = [
    ("dataset", _dataset),
    ("graph", _graph),
    ("clusters", _clusters),
    ("wallet features", _features),
    ("anomalies", _anomaly),
    ("chains", _chains),
    ("chain classifier", _classifier),
    ("risk", _risk),
    ("alerts", _alerts),
]
