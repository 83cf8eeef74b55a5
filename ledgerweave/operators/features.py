"""Per-wallet behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerweave.functions.scalar import haversine_km, ip_geo, signed_log1p
from ledgerweave.sources.geo import place
from ledgerweave.sources.ledger import Ledger

SKEWED = ("avg_amount_zscore", "max_abs_amount_zscore", "tx_frequency_per_day", "max_geo_velocity_kmh", "avg_geo_velocity_kmh")
MODEL = ("avg_amount_zscore_log", "max_abs_amount_zscore_log", "tx_count", "tx_frequency_per_day_log", "fan_in_degree", "fan_out_degree", "max_geo_velocity_kmh_log", "avg_geo_velocity_kmh_log", "time_of_day_entropy")


def amount_features(ledger: Ledger) -> DataFrame:
    """Degrees, counts, frequency and z-scores; counts are of edges, but ``tx_count`` of transactions."""
    edges = ledger.edges()
    scale = edges.agg(F.avg("amount").alias("mu"), F.stddev_pop("amount").alias("sd")).select("mu", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9).alias("sd"))
    z = (F.col("amount") - F.col("mu")) / F.col("sd")
    span = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400.0
    return edges.crossJoin(F.broadcast(scale)).groupBy("wallet").agg(  # one row of scale
        F.avg(z).alias("avg_amount_zscore"), F.max(F.abs(z)).alias("max_abs_amount_zscore"), F.countDistinct("txid").alias("tx_count"),
        F.when(F.count("*") > 1, F.countDistinct("txid") / F.greatest(span, F.lit(1e-6))).otherwise(F.countDistinct("txid").cast("double")).alias("tx_frequency_per_day"),
        F.sum(F.when(F.col("side") == "out", 1).otherwise(0)).alias("fan_in_degree"), F.sum(F.when(F.col("side") == "in", 1).otherwise(0)).alias("fan_out_degree"),
    )


def entropy(ledger: Ledger) -> DataFrame:
    counts = ledger.edges().groupBy("wallet", F.hour("ts").alias("h")).count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy("wallet"))
    return counts.select("wallet", (-p * F.log2(p)).alias("term")).groupBy("wallet").agg(F.sum("term").alias("time_of_day_entropy"))


def ips(ledger: Ledger, database: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Each relaying address with its place, by a GeoIP database (its tables of cities and ASNs) where one is given."""
    if database:
        return place(ledger.relay, *database).drop("geo_source")
    return ledger.relay.select("ip").distinct().select("ip", ip_geo(F.col("ip")).alias("geo")).select("ip", "geo.*")


def velocity(ledger: Ledger, database: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Speeds between the relaying peers of a wallet's consecutive transactions; pairs without a time step are skipped."""
    places = ledger.relay.where("role = 'by'").join(ips(ledger, database), "ip").select("txid", "lat", "lon")
    visits = ledger.edges().select("wallet", "txid", "ts").distinct().join(places, "txid")
    order = Window.partitionBy("wallet").orderBy("ts", "txid")
    hours = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))) / 3600.0
    km = haversine_km(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    steps = visits.select("wallet", hours.alias("hours"), km.alias("km")).where("hours > 1e-6 and km is not null")
    return steps.groupBy("wallet").agg(F.max(F.col("km") / F.col("hours")).alias("max_geo_velocity_kmh"), F.avg(F.col("km") / F.col("hours")).alias("avg_geo_velocity_kmh"))


def pattern_touch(ledger: Ledger) -> DataFrame:
    marked = ledger.txs.where("pattern_type is not null and pattern_type <> 'normal'").select("txid", "pattern_type")
    touched = ledger.edges().select("wallet", "txid").join(marked, "txid").groupBy("wallet").agg(F.array_join(F.sort_array(F.collect_set("pattern_type")), ",").alias("pattern_types_involved"))
    every = ledger.edges().select("wallet").distinct()
    return every.join(touched, "wallet", "left").select("wallet", F.coalesce("pattern_types_involved", F.lit("")).alias("pattern_types_involved"), F.col("pattern_types_involved").isNotNull().alias("involved_in_illicit_pattern"))


def wallet_features(ledger: Ledger) -> DataFrame:
    out = amount_features(ledger).join(entropy(ledger), "wallet").join(velocity(ledger), "wallet", "left").join(pattern_touch(ledger), "wallet")
    return out.fillna(0.0, ["max_geo_velocity_kmh", "avg_geo_velocity_kmh"])


def with_logs(features: DataFrame) -> DataFrame:
    return features.withColumns({f"{c}_log": signed_log1p(F.col(c)) for c in SKEWED})
