"""Scalar expressions: geography, entropy terms, scores and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fallback countries in order, with centroid latitude and longitude.
COUNTRIES = [("US", 39.8, -98.6), ("DE", 51.2, 10.4), ("IN", 22.4, 78.6), ("SG", 1.35, 103.8), ("NL", 52.1, 5.3), ("RU", 61.5, 105.3), ("BR", -10.3, -53.2), ("JP", 36.2, 138.3), ("GB", 54.0, -2.9), ("FR", 46.6, 2.5)]
EARTH_KM = 6371.0


def md5_mod(value: Column, m: int) -> Column:
    """The MD5 digest as a 128-bit number modulo ``m``, by Horner's rule over 32-bit parts."""
    out = F.lit(0).cast("long")
    for i in range(4):
        out = (out * 4294967296 + F.conv(F.substring(F.md5(value), 8 * i + 1, 8), 16, 10).cast("long")) % m
    return out


def ip_geo(ip: Column) -> Column:
    """struct(geo_country, asn, lat, lon) of an address without a database: always the same place."""
    spot = F.element_at(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(a).alias("a"), F.lit(o).alias("o")) for c, a, o in COUNTRIES]), (md5_mod(ip, 10) + 1).cast("int"))
    jitter = (md5_mod(ip, 1000) / 1000.0 - 0.5) * 4
    return F.struct(spot["c"].alias("geo_country"), F.concat(F.lit("AS"), (md5_mod(ip, 64000) + 1000).cast("string")).alias("asn"), (spot["a"] + jitter).alias("lat"), (spot["o"] + jitter).alias("lon"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def noisy_or(*risks: Column) -> Column:
    """1 minus the product of the complements."""
    left = F.lit(1.0)
    for r in risks:
        left = left * (1 - r)
    return 1 - left


def risk_color(risk: Column) -> Column:
    """#rrggbb from green to red; risks outside 0 to 1 are clamped, channels truncated."""
    r = F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0))
    channel = lambda x: F.lower(F.lpad(F.hex(x.cast("int")), 2, "0"))
    return F.concat(F.lit("#"), channel(40 + 190 * r), channel(180 - 150 * r), F.lit("3c"))


NOTHING = "No single strong signal; flagged only due to combined weak evidence."


def explain(propagated: Column, anomaly: Column, peeling: Column) -> Column:
    """The signals above their thresholds, in words."""
    parts = F.concat_ws(
        "; ",
        F.when(propagated > 0.3, F.format_string("network proximity to known cash-out wallets (propagated risk %.2f)", propagated)),
        F.when(anomaly > 0.5, F.format_string("statistically anomalous behavior (anomaly score %.2f)", anomaly)),
        F.when(peeling > 0.5, F.format_string("participation in a high-confidence peeling chain (probability %.2f)", peeling)),
    )
    return F.when(parts == "", NOTHING).otherwise(F.concat(F.lit("Flagged for: "), parts, F.lit(".")))


def final_explanation(propagated: Column, anomaly: Column, peeling: Column, anomaly_reason: Column, peeling_reason: Column) -> Column:
    parts = F.concat_ws(
        " ",
        F.when(propagated > 0.3, F.format_string("[Network] Proximity to known cash-out wallets (propagated risk %.2f).", propagated)),
        F.when((anomaly > 0.5) & anomaly_reason.isNotNull(), F.concat(F.lit("[Anomaly] "), anomaly_reason)),
        F.when((peeling > 0.5) & peeling_reason.isNotNull(), F.concat(F.format_string("[Peeling-chain, P=%.2f] ", peeling), peeling_reason)),
    )
    return F.when(parts == "", NOTHING).otherwise(parts)
