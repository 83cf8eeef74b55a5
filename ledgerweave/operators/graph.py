"""Clusters, change addresses, peeling chains, mixes, neighbourhoods and PageRank over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerweave.operators.components import connected_components
from ledgerweave.plans.checkpoint import cut
from ledgerweave.sources.ledger import Ledger


def wallet_nodes(ledger: Ledger) -> DataFrame:
    """Wallets with the entity first seen (inputs before outputs in a transaction) and whether a later input differs."""
    order = F.struct("ts", "txid", F.when(F.col("side") == "in", 0).otherwise(1).alias("s"), "pos")
    seen = ledger.edges().withColumn("o", order).groupBy("wallet").agg(F.min_by("entity", "o").alias("entity"), F.collect_set(F.when(F.col("side") == "in", F.coalesce("entity", F.lit(-1)))).alias("inputs"))
    return seen.select("wallet", "entity", F.exists("inputs", lambda x: x != F.coalesce("entity", F.lit(-1))).alias("conflict"))


def peel_shaped(ledger: Ledger, ratio: float = 0.3) -> DataFrame:
    """Transactions of exactly two outputs of which the small is under ``ratio`` of the large; amount ties keep vout order."""
    end = F.struct("amount", "vout", "wallet")
    both = ledger.outputs.groupBy("txid", "ts").agg(F.count("*").alias("n"), F.min(end).alias("s"), F.max(end).alias("l")).where("n = 2 and l.amount > 0")
    both = both.withColumn("ratio", F.col("s.amount") / F.col("l.amount")).where(F.col("ratio") < ratio)
    return both.select("txid", "ts", F.col("s.wallet").alias("small_wallet"), F.col("s.amount").alias("small_amount"), F.col("l.wallet").alias("large_wallet"), F.col("l.amount").alias("large_amount"), "ratio")


def coinjoin_like(ledger: Ledger, cv: float = 0.05, min_outputs: int = 3, min_inputs: int = 2) -> DataFrame:
    outs = ledger.outputs.groupBy("txid").agg(F.count("*").alias("n_outputs"), F.avg("amount").alias("m"), F.stddev_pop("amount").alias("sd")).where(F.col("n_outputs") >= min_outputs)
    ins = ledger.inputs.groupBy("txid").agg(F.count("*").alias("n_inputs")).where(F.col("n_inputs") >= min_inputs)
    return outs.join(ins, "txid").where((F.col("m") > 0) & (F.col("sd") / F.col("m") < cv)).select("txid", "n_outputs", "n_inputs", (F.col("sd") / F.col("m")).alias("cv"))


def next_spend(spots: DataFrame, ledger: Ledger, wallet: str, ts: str = "ts") -> DataFrame:
    """Adds ``next_txid``, ``next_ts``: the wallet's first spend strictly later, ties by txid.

    A window over spots and spends of a wallet in time order, so a busy wallet costs a sort, not a product.
    """
    spends = ledger.inputs.select(F.col("wallet").alias("w"), F.col("ts").alias("t"), F.struct("ts", "txid").alias("spend")).distinct()
    marks = spots.select(F.col(wallet).alias("w"), F.col(ts).alias("t"), F.struct(*spots.columns).alias("spot"))
    both = marks.withColumn("spend", F.lit(None).cast(spends.schema["spend"].dataType)).unionByName(spends.withColumn("spot", F.lit(None).cast(marks.schema["spot"].dataType)))
    # backwards in time; a spend at the spot's own time is no successor, so spots come before the spends of their instant
    rank = Window.partitionBy("w").orderBy(F.col("t").desc(), F.col("spot").isNotNull().desc(), F.col("spend.txid").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("next", F.last("spend", ignorenulls=True).over(rank)).where("spot is not null")
    return found.select("spot.*", F.col("next.txid").alias("next_txid"), F.col("next.ts").alias("next_ts"))


def peeling_chains(ledger: Ledger, min_hops: int = 2, ratio: float = 0.3, max_rounds: int = 40) -> DataFrame:
    """(chain, hop, txid): maximal walks from qualifying transactions that none precedes, ``chain`` being the first txid.

    The successor is the first later spend of the large output; it counts only if it qualifies itself. Positions come
    from pointer doubling, so a chain of n hops takes log2(n) rounds.
    """
    shaped = peel_shaped(ledger, ratio)
    step = next_spend(shaped.select("txid", "ts", "large_wallet"), ledger, "large_wallet")
    qualified = shaped.select(F.col("txid").alias("next_txid"))
    links = cut(step.join(qualified, "next_txid").select("txid", "next_txid"))
    starts = shaped.select("txid").join(links.select(F.col("next_txid").alias("txid")), "txid", "left_anti")
    walks = starts.select(F.col("txid").alias("chain"), F.lit(0).alias("hop"), "txid")
    jump, span = links, 1
    for _ in range(max_rounds):
        more = walks.join(jump, "txid").select("chain", (F.col("hop") + span).alias("hop"), F.col("next_txid").alias("txid"))
        walks = cut(walks.unionByName(more))
        onward = jump.withColumnRenamed("next_txid", "mid").join(jump.withColumnRenamed("txid", "mid"), "mid").select("txid", "next_txid")
        jump, span = cut(onward), span * 2
        if jump.isEmpty():
            break
    long_enough = walks.groupBy("chain").agg(F.count("*").alias("n")).where(F.col("n") >= min_hops).select("chain")
    return walks.join(long_enough, "chain")


def chain_features(ledger: Ledger, chains: DataFrame, ratio: float = 0.3) -> DataFrame:
    shaped = peel_shaped(ledger, ratio).select("txid", "ts", "ratio", "large_amount", "small_amount")
    hops = chains.join(shaped, "txid").join(ledger.txs.select("txid", "fee", "chain_id"), "txid")
    order = Window.partitionBy("chain").orderBy("hop")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))
    total = F.col("large_amount") + F.col("small_amount")
    hops = hops.withColumns({"gap": gap.cast("double"), "fraction": F.when(F.col("fee") + total > 0, F.col("fee") / (F.col("fee") + total))})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return hops.groupBy("chain").agg(
        F.count("*").alias("hop_count"), zero(F.avg("gap")).alias("mean_time_gap_sec"), zero(F.stddev_pop("gap")).alias("std_time_gap_sec"), zero(F.min("gap")).alias("min_time_gap_sec"), zero(F.max("gap")).alias("max_time_gap_sec"),
        F.avg("ratio").alias("mean_ratio"), F.stddev_pop("ratio").alias("std_ratio"), (1 - F.max_by("large_amount", "hop") / F.min_by(total, "hop")).alias("decline_fraction"), F.log1p(F.min_by(total, "hop")).alias("log_start_amount"),
        zero(F.avg("fraction")).alias("mean_fee_fraction"), F.max(F.col("chain_id").isNotNull()).cast("int").alias("label"),
    )


def co_spend_edges(ledger: Ledger) -> DataFrame:
    """A star per transaction: its first input to each of the others; as connected as all pairs, and linear."""
    first = ledger.inputs.groupBy("txid").agg(F.min_by("wallet", "vin").alias("src"))
    return ledger.inputs.join(first, "txid").where("wallet <> src").select("src", F.col("wallet").alias("dst")).distinct()


def clusters(ledger: Ledger, edges: DataFrame) -> DataFrame:
    """(wallet, cluster): the component's smallest wallet, singletons their own."""
    labels = connected_components(edges).withColumnRenamed("node", "wallet")
    every = ledger.edges().select("wallet").distinct()
    return every.join(labels, "wallet", "left").select("wallet", F.coalesce("component", "wallet").alias("cluster"))


def fresh_outputs(ledger: Ledger) -> DataFrame:
    """Outputs with ``fresh``: the first transaction, by time, that pays the wallet."""
    first = F.min(F.struct("ts", "txid")).over(Window.partitionBy("wallet"))
    return ledger.outputs.withColumn("fresh", F.struct("ts", "txid") == first)


def change_predictions(ledger: Ledger) -> DataFrame:
    """(txid, wallet): of two outputs the one that is fresh, if the other is not."""
    two = fresh_outputs(ledger).groupBy("txid").agg(F.count("*").alias("n"), F.sum(F.col("fresh").cast("int")).alias("k"), F.max_by("wallet", F.col("fresh").cast("int")).alias("wallet"))
    return two.where("n = 2 and k = 1").select("txid", "wallet")


def combined_edges(ledger: Ledger) -> DataFrame:
    change = ledger.inputs.select("txid", F.col("wallet").alias("src")).join(change_predictions(ledger).withColumnRenamed("wallet", "dst"), "txid").where("src <> dst").select("src", "dst")
    return co_spend_edges(ledger).unionByName(change).distinct()


def input_pairs(ledger: Ledger) -> DataFrame:
    """Pairs of inputs of each transaction and whether both entities are known and differ."""
    a, b = ledger.inputs.alias("a"), ledger.inputs.alias("b")
    wrong = (F.col("a.entity") != F.col("b.entity")) & F.col("a.entity").isNotNull() & F.col("b.entity").isNotNull()
    return a.join(b, (F.col("a.txid") == F.col("b.txid")) & (F.col("a.vin") < F.col("b.vin"))).select(F.col("a.txid").alias("txid"), F.col("a.wallet").alias("a"), F.col("b.wallet").alias("b"), F.coalesce(wrong, F.lit(False)).alias("false_merge"))


def flow_edges(ledger: Ledger) -> DataFrame:
    """Weighted directed edges of the wallet and transaction graph, parallel ones summed."""
    w, t = F.concat(F.lit("w"), F.col("wallet").cast("string")), F.concat(F.lit("t"), F.col("txid").cast("string"))
    both = ledger.inputs.select(w.alias("src"), t.alias("dst"), "amount").unionByName(ledger.outputs.select(t.alias("src"), w.alias("dst"), "amount"))
    return both.groupBy("src", "dst").agg(F.sum("amount").alias("amount"))


def pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.55, rounds: int | None = None, tolerance: float = 1e-6, limit: int = 100) -> DataFrame:
    """(node, rank): personalised, amount-weighted PageRank; ``seeds`` has ``node``.

    Runs ``rounds`` rounds, or until the ranks move less than ``tolerance`` per node; sinks send their mass to the seeds.
    """
    k = seeds.count()
    if not k:
        raise ValueError("PageRank needs at least one seed")
    total = edges.groupBy("src").agg(F.sum("amount").alias("total"))
    share = cut(edges.join(total, "src").select("src", "dst", (F.col("amount") / F.col("total")).alias("share")))
    nodes = share.select(F.col("src").alias("node")).union(share.select("dst")).distinct()
    nodes = nodes.join(seeds.select("node", F.lit(1.0 / k).alias("p")), "node", "left").join(total.select(F.col("src").alias("node"), F.lit(True).alias("out")), "node", "left")
    nodes = cut(nodes.select("node", F.coalesce("p", F.lit(0.0)).alias("p"), F.col("out").isNull().alias("sink")))
    n = nodes.count()
    ranks = nodes.select("*", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds or limit):
        lost = ranks.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = share.join(ranks, share["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got")).withColumnRenamed("dst", "node")
        ranks = cut(ranks.join(sent, "node", "left").select("node", "p", "sink", (alpha * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p")) + (1 - alpha) * F.col("p")).alias("new"), F.col("rank").alias("old")))
        moved = ranks.agg(F.sum(F.abs(F.col("new") - F.col("old")))).first()[0] if rounds is None else None
        ranks = ranks.select("node", "p", "sink", F.col("new").alias("rank"))
        if moved is not None and moved < n * tolerance:
            break
    return ranks.select("node", "rank")


def neighbourhood(ledger: Ledger, wallets: DataFrame) -> DataFrame:
    """(node, kind): the wallets, all their transactions and all wallets of those."""
    edges = ledger.edges().select("wallet", "txid")
    txs = edges.join(wallets, "wallet", "left_semi").select("txid").distinct()
    near = edges.join(txs, "txid", "left_semi").select("wallet").union(wallets.select("wallet")).distinct()
    return near.select(F.col("wallet").alias("node"), F.lit("wallet").alias("kind")).unionByName(txs.select(F.col("txid").alias("node"), F.lit("tx").alias("kind")))


def subgraph(ledger: Ledger, risks: DataFrame, k: int = 12, most: int = 150) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the view around the ``k`` riskiest wallets.

    Nodes: id, kind, label, size, risk, is_seed, pattern_type. Beyond ``most`` nodes, half as many wallets stay, the
    riskiest, and half as many transactions, the smallest ids. Edges join the nodes that stay.
    """
    rated = risks.select("wallet", F.round("final_risk", 6).alias("risk"))
    top = rated.orderBy(F.col("risk").desc(), "wallet").limit(k).select("wallet")
    near = cut(neighbourhood(ledger, top))
    wallets = near.where("kind = 'wallet'").select(F.col("node").alias("wallet")).join(rated, "wallet", "left").fillna(0.0, ["risk"])
    txs = near.where("kind = 'tx'").select(F.col("node").alias("txid"))
    if near.count() > most:
        wallets = wallets.orderBy(F.col("risk").desc(), "wallet").limit(most // 2)
        txs = txs.orderBy("txid").limit(most // 2)
    seeds = top.withColumn("is_seed", F.lit(True))
    wallets, txs = cut(wallets.join(seeds, "wallet", "left").fillna(False, ["is_seed"])), cut(txs.join(ledger.txs.select("txid", "pattern_type"), "txid"))
    name = F.col("wallet").cast("string")
    shown = wallets.select(name.alias("id"), F.lit("wallet").alias("kind"), F.concat(F.substring(name, 1, 10), F.lit("...")).alias("label"), (15 + 20 * F.col("risk") + F.when(F.col("is_seed"), 8).otherwise(0)).alias("size"), "risk", "is_seed", F.lit(None).cast("string").alias("pattern_type"))
    tx = F.col("txid").cast("string")
    nodes = shown.unionByName(txs.select(tx.alias("id"), F.lit("tx").alias("kind"), F.concat(F.lit("TX:"), F.substring(tx, 1, 8)).alias("label"), F.lit(10.0).alias("size"), F.lit(None).cast("double").alias("risk"), F.lit(False).alias("is_seed"), "pattern_type"))
    inside = ledger.edges().join(txs, "txid", "left_semi").join(wallets, "wallet", "left_semi")
    spends = F.col("side") == "in"
    edges = inside.select(F.when(spends, name).otherwise(tx).alias("source"), F.when(spends, tx).otherwise(name).alias("target"), F.when(spends, "spends").otherwise("pays").alias("label"))
    return nodes, edges
