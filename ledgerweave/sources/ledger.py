"""Ledger sources: transaction documents, the order adaptor, and the edge tables all operators read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

RECORD = (
    "timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, txid string, "
    "input_addresses array<string>, input_prevouts array<string>, input_amounts array<double>, output_addresses array<string>, output_amounts array<double>, "
    "fee double, geo_country string, asn string, label string, pattern_type string, sender_entity_ground_truth int, output_entity_ground_truth array<int>, "
    "is_change_ground_truth array<boolean>, coinjoin_ground_truth boolean, geo_exception_ground_truth boolean, chain_id string, group_id string, hop_index int, "
    "chain_style string, hard_negative_chain_id string, mix_size int"
)


@dataclass
class Ledger:
    """txs(txid, ts, fee, pattern_type, chain_id, is_mix), inputs(txid, ts, vin, wallet, amount, entity),
    outputs(txid, ts, vout, wallet, amount, entity, is_change), relay(txid, ts, ip, role)."""

    txs: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    relay: DataFrame

    def edges(self) -> DataFrame:
        side = lambda df, s, pos: df.select("txid", "ts", F.lit(s).alias("side"), F.col(pos).alias("pos"), "wallet", "amount", "entity")
        return side(self.inputs, "in", "vin").unionByName(side(self.outputs, "out", "vout"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of transaction documents, with the fixed schema; malformed documents fail the read."""
    return spark.read.schema(RECORD).option("multiLine", True).option("mode", "FAILFAST").json(path)


def from_records(records: DataFrame) -> Ledger:
    txs = records.select("txid", F.col("timestamp").alias("ts"), "fee", F.coalesce("pattern_type", "label", F.lit("unknown")).alias("pattern_type"), "chain_id", F.coalesce("coinjoin_ground_truth", F.lit(False)).alias("is_mix"))
    ins = records.select("txid", F.col("timestamp").alias("ts"), F.col("sender_entity_ground_truth").alias("entity"), F.posexplode(F.arrays_zip("input_addresses", "input_amounts", "input_prevouts")).alias("vin", "x"))
    outs = records.select("txid", F.col("timestamp").alias("ts"), F.posexplode(F.arrays_zip("output_addresses", "output_amounts", "output_entity_ground_truth", "is_change_ground_truth")).alias("vout", "x"))
    relay = records.select("txid", F.col("timestamp").alias("ts"), F.inline(F.array(F.struct(F.col("src_ip").alias("ip"), F.lit("by").alias("role")), F.struct(F.col("dst_ip").alias("ip"), F.lit("to").alias("role")))))
    return Ledger(
        txs,
        ins.select("txid", "ts", "vin", F.col("x.input_addresses").alias("wallet"), F.col("x.input_amounts").alias("amount"), "entity", F.col("x.input_prevouts").alias("prevout")),
        outs.select("txid", "ts", "vout", F.col("x.output_addresses").alias("wallet"), F.col("x.output_amounts").alias("amount"), F.col("x.output_entity_ground_truth").alias("entity"), F.col("x.is_change_ground_truth").alias("is_change")),
        relay,
    )


def flat_csv(records: DataFrame) -> DataFrame:
    """Documents with their list columns as JSON text, as a CSV can hold them."""
    return records.select(*[F.to_json(c).alias(c) if isinstance(records.schema[c].dataType, T.ArrayType) else F.col(c) for c in records.columns])


def from_orders(spark: SparkSession, sf_dir: str) -> Ledger:
    """The order tables read as a ledger: orders pay the parts of their lines, customers fund them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("wallet"), F.col("c_nationkey").cast("int").alias("entity"))
    key = F.col("o_orderkey")
    ts = F.expr("timestampadd(SECOND, cast(o_orderkey * 7919 % 86400 as int), o_orderdate)")
    kind = F.when(key % 50 != 0, "normal").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("peeling", "fanin", "fanout", "coinjoin", "coinjoin")]), F.substring("o_orderpriority", 1, 1).cast("int")))
    base = orders.select(key.alias("txid"), ts.alias("ts"), F.round(F.col("o_totalprice") * 0.001, 2).alias("fee"), kind.alias("pattern_type"), "o_custkey", "o_totalprice", "o_orderpriority")
    txs = base.select("txid", "ts", "fee", "pattern_type", F.when(F.col("pattern_type") == "peeling", F.concat(F.lit("chain_"), F.col("o_custkey").cast("string"))).alias("chain_id"), (F.col("pattern_type") == "coinjoin").alias("is_mix"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    placed = lines.select(F.col("l_orderkey").alias("txid"), (F.row_number().over(order) - 1).alias("vout"), F.col("l_partkey").alias("wallet"), F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") == "R").alias("is_change"))
    outputs = placed.join(base.select("txid", "ts"), "txid").join(customers, "wallet", "left").select("txid", "ts", "vout", "wallet", "amount", "entity", "is_change")
    own = base.select("txid", "ts", F.lit(0).alias("vin"), F.col("o_custkey").alias("wallet"), F.col("o_totalprice").alias("amount"))
    first_part = lines.groupBy(F.col("l_orderkey").alias("txid")).agg(F.min("l_partkey").alias("wallet"))
    joint = base.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("txid") % 4 == 0)).join(first_part, "txid").select("txid", "ts", F.lit(1).alias("vin"), "wallet", (F.col("o_totalprice") / 2).alias("amount"))
    inputs = own.unionByName(joint).join(customers, "wallet", "left").select("txid", "ts", "vin", "wallet", "amount", "entity")
    peer = F.when(F.col("txid") % 20 == 0, F.col("txid") % 50).otherwise(F.col("o_custkey") % 50)
    ip = lambda p: F.concat(F.lit("45."), p.cast("string"), F.lit(".7.1"))
    relay = base.select("txid", "ts", F.inline(F.array(F.struct(ip(peer).alias("ip"), F.lit("by").alias("role")), F.struct(ip((peer + 1) % 50).alias("ip"), F.lit("to").alias("role")))))
    return Ledger(txs, inputs, outputs, relay)
