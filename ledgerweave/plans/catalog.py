"""All ledger queries by name, with independent DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions.scalar import COUNTRIES, risk_color
from ledgerweave.operators import alerts, features, forest, graph, metrics, risk, validation
from ledgerweave.plans.checkpoint import cut
from ledgerweave.sources import geo
from ledgerweave.sources.ledger import Ledger, from_orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LEDGER_SQL = """WITH RECURSIVE txs AS (
  SELECT o_orderkey AS txid, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS ts, round(o_totalprice * 0.001, 2) AS fee,
    CASE WHEN o_orderkey % 50 <> 0 THEN 'normal' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'peeling' WHEN '2' THEN 'fanin' WHEN '3' THEN 'fanout' ELSE 'coinjoin' END END AS pattern_type,
    o_custkey, o_totalprice, o_orderpriority FROM orders
), entities AS (SELECT c_custkey AS wallet, CAST(c_nationkey AS INTEGER) AS entity FROM customer),
outs AS (
  SELECT l_orderkey AS txid, t.ts, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS vout,
    l_partkey AS wallet, l_extendedprice AS amount, e.entity, l_returnflag = 'R' AS is_change FROM lineitem JOIN txs t ON t.txid = l_orderkey LEFT JOIN entities e ON e.wallet = l_partkey
), ins AS (
  SELECT a.txid, a.ts, a.vin, a.wallet, a.amount, e.entity FROM (
    SELECT txid, ts, 0 AS vin, o_custkey AS wallet, o_totalprice AS amount FROM txs UNION ALL
    SELECT t.txid, t.ts, 1, min(l_partkey), any_value(t.o_totalprice) / 2 FROM txs t JOIN lineitem ON l_orderkey = t.txid WHERE o_orderpriority = '1-URGENT' AND t.txid % 4 = 0 GROUP BY ALL
  ) a LEFT JOIN entities e ON e.wallet = a.wallet
), edges AS (
  SELECT txid, ts, 'in' AS side, vin AS pos, wallet, amount, entity FROM ins UNION ALL SELECT txid, ts, 'out', vout, wallet, amount, entity FROM outs
), peers AS (SELECT txid, ts, CASE WHEN txid % 20 = 0 THEN txid % 50 ELSE o_custkey % 50 END AS peer FROM txs
), relay AS (
  SELECT txid, ts, '45.' || peer || '.7.1' AS ip, 'by' AS role FROM peers UNION ALL SELECT txid, ts, '45.' || ((peer + 1) % 50) || '.7.1', 'to' FROM peers
), digests AS (SELECT ip, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(md5(ip), i, 8) AS BIGINT)) AS c FROM (SELECT DISTINCT ip FROM relay)
), mods AS (
  SELECT ip, list_reduce(list_prepend(0, c), lambda a, x: (a * 4294967296 + x) % 10) AS m10, list_reduce(list_prepend(0, c), lambda a, x: (a * 4294967296 + x) % 1000) AS m1000, list_reduce(list_prepend(0, c), lambda a, x: (a * 4294967296 + x) % 64000) AS m64 FROM digests
), ips AS (
  SELECT ip, (['US','DE','IN','SG','NL','RU','BR','JP','GB','FR'])[m10 + 1] AS geo_country, 'AS' || (m64 + 1000) AS asn,
    CAST((['39.8','51.2','22.4','1.35','52.1','61.5','-10.3','36.2','54.0','46.6'])[m10 + 1] AS DOUBLE) + (m1000 / 1000.0::DOUBLE - 0.5::DOUBLE) * 4 AS lat,
    CAST((['-98.6','10.4','78.6','103.8','5.3','105.3','-53.2','138.3','-2.9','2.5'])[m10 + 1] AS DOUBLE) + (m1000 / 1000.0::DOUBLE - 0.5::DOUBLE) * 4 AS lon FROM mods
), peel AS (
  SELECT txid, ts, s.wallet AS small_wallet, s.amount AS small_amount, l.wallet AS large_wallet, l.amount AS large_amount, s.amount / l.amount AS ratio FROM (
    SELECT txid, ts, count(*) AS n, min({'amount': amount, 'vout': vout, 'wallet': wallet}) AS s, max({'amount': amount, 'vout': vout, 'wallet': wallet}) AS l FROM outs GROUP BY ALL
  ) WHERE n = 2 AND l.amount > 0 AND s.amount / l.amount < 0.3
), spend AS (
  SELECT p.txid, arg_min(i.txid, {'ts': i.ts, 'txid': i.txid}) AS next_txid FROM peel p JOIN ins i ON i.wallet = p.large_wallet AND i.ts > p.ts GROUP BY p.txid
), links AS (SELECT txid, next_txid FROM spend WHERE next_txid IN (SELECT txid FROM peel)
), walk AS (
  SELECT txid AS chain, 0 AS hop, txid FROM peel WHERE txid NOT IN (SELECT next_txid FROM links) UNION ALL
  SELECT w.chain, w.hop + 1, l.next_txid FROM walk w JOIN links l ON l.txid = w.txid
), chains AS (SELECT chain, CAST(hop AS INTEGER) AS hop, txid FROM walk WHERE chain IN (SELECT chain FROM walk GROUP BY chain HAVING count(*) >= 2)
), firsts AS (SELECT txid, arg_min(wallet, vin) AS src FROM ins GROUP BY txid
), fresh AS (
  SELECT *, {'ts': ts, 'txid': txid} = min({'ts': ts, 'txid': txid}) OVER (PARTITION BY wallet) AS fresh FROM outs
), change AS (
  SELECT txid, max(CASE WHEN fresh THEN wallet END) AS wallet FROM fresh GROUP BY txid HAVING count(*) = 2 AND sum(CAST(fresh AS INTEGER)) = 1
), cospend AS (SELECT DISTINCT f.src, i.wallet AS dst FROM ins i JOIN firsts f USING (txid) WHERE i.wallet <> f.src
), joint AS (SELECT * FROM cospend UNION SELECT DISTINCT i.wallet, c.wallet FROM ins i JOIN change c USING (txid) WHERE i.wallet <> c.wallet
), reach AS (SELECT src AS a, dst AS b FROM cospend UNION SELECT dst, src FROM cospend UNION SELECT r.a, e.b FROM reach r JOIN (SELECT src AS a, dst AS b FROM cospend UNION SELECT dst, src FROM cospend) e ON r.b = e.a
), walletset AS (SELECT DISTINCT wallet FROM edges
), cioh AS (SELECT wallet, least(wallet, coalesce(min(b), wallet)) AS cluster FROM walletset LEFT JOIN reach ON a = wallet GROUP BY wallet
), firstseen AS (
  SELECT wallet, arg_min(coalesce(entity, -1), {'ts': ts, 'txid': txid, 's': CASE side WHEN 'in' THEN 0 ELSE 1 END, 'pos': pos}) AS e FROM edges GROUP BY wallet
), truth AS (SELECT wallet, nullif(e, -1) AS entity FROM firstseen
), scale AS (SELECT avg(amount) AS mu, CASE WHEN stddev_pop(amount) > 0 THEN stddev_pop(amount) ELSE 1e-9 END AS sd FROM edges
), amounts AS (
  SELECT wallet, avg((amount - mu) / sd) AS avg_z, max(abs((amount - mu) / sd)) AS max_z, count(DISTINCT txid) AS tx_count,
    CASE WHEN count(*) > 1 THEN count(DISTINCT txid) / greatest((epoch(max(ts)) - epoch(min(ts))) / 86400.0::DOUBLE, 1e-6::DOUBLE) ELSE CAST(count(DISTINCT txid) AS DOUBLE) END AS freq,
    sum(CASE side WHEN 'out' THEN 1 ELSE 0 END) AS fan_in, sum(CASE side WHEN 'in' THEN 1 ELSE 0 END) AS fan_out FROM edges, scale GROUP BY wallet
), hours AS (SELECT wallet, hour(ts) AS h, count(*) AS n FROM edges GROUP BY ALL
), ent AS (SELECT wallet, sum(-(n / t) * log2(n / t)) AS entropy FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY wallet) AS DOUBLE) AS t FROM hours) GROUP BY wallet
), visits AS (
  SELECT v.wallet, (epoch(v.ts) - epoch(lag(v.ts) OVER w)) / 3600.0::DOUBLE AS dt, radians(lat) AS la, radians(lon) AS lo, radians(lag(lat) OVER w) AS la0, radians(lag(lon) OVER w) AS lo0
  FROM (SELECT DISTINCT wallet, txid, ts FROM edges) v JOIN relay r ON r.txid = v.txid AND r.role = 'by' JOIN ips USING (ip) WINDOW w AS (PARTITION BY v.wallet ORDER BY v.ts, v.txid)
), vel AS (
  SELECT wallet, max(km / dt) AS max_v, avg(km / dt) AS avg_v FROM (
    SELECT wallet, dt, 2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((la - la0) / 2), 2) + cos(la0) * cos(la) * pow(sin((lo - lo0) / 2), 2)))) AS km FROM visits WHERE dt > 1e-6
  ) GROUP BY wallet
), pats AS (
  SELECT wallet, string_agg(DISTINCT pattern_type, ',' ORDER BY pattern_type) AS p FROM edges JOIN txs USING (txid) WHERE pattern_type <> 'normal' GROUP BY wallet
), touch AS (SELECT wallet, coalesce(p, '') AS pattern_types_involved, p IS NOT NULL AS involved_in_illicit_pattern FROM walletset LEFT JOIN pats USING (wallet)
), scored AS (SELECT wallet, CAST(involved_in_illicit_pattern AS INTEGER) AS y, round(max_z, 6) AS score, pattern_types_involved AS patterns FROM amounts JOIN touch USING (wallet)
), flow AS (
  SELECT src, dst, sum(amount) AS amount FROM (SELECT 'w' || wallet AS src, 't' || txid AS dst, amount FROM ins UNION ALL SELECT 't' || txid, 'w' || wallet, amount FROM outs) GROUP BY ALL
), share AS (SELECT src, dst, amount / sum(amount) OVER (PARTITION BY src) AS share FROM flow
), seeds AS (SELECT 'w' || wallet AS node, wallet FROM truth WHERE entity IN (0, 1, 2, 3, 4) ORDER BY md5('3:' || wallet), wallet LIMIT 6
), pr AS (
  SELECT node, CASE WHEN node IN (SELECT node FROM seeds) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeds) ELSE 0.0::DOUBLE END AS p, node NOT IN (SELECT src FROM flow) AS sink FROM (SELECT src AS node FROM flow UNION SELECT dst FROM flow)
), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM pr) AS rank FROM pr
), r1 AS (SELECT n.node, 0.55 * (coalesce(g.got, 0) + (SELECT sum(rank) FROM r0 JOIN pr USING (node) WHERE sink) * p) + 0.45 * p AS rank FROM pr n LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM share JOIN r0 ON r0.node = src GROUP BY dst) g ON g.dst = n.node
), r2 AS (SELECT n.node, 0.55 * (coalesce(g.got, 0) + (SELECT sum(rank) FROM r1 JOIN pr USING (node) WHERE sink) * p) + 0.45 * p AS rank FROM pr n LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM share JOIN r1 ON r1.node = src GROUP BY dst) g ON g.dst = n.node
), r3 AS (SELECT n.node, 0.55 * (coalesce(g.got, 0) + (SELECT sum(rank) FROM r2 JOIN pr USING (node) WHERE sink) * p) + 0.45 * p AS rank FROM pr n LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM share JOIN r2 ON r2.node = src GROUP BY dst) g ON g.dst = n.node
), prop AS (SELECT CAST(substr(node, 2) AS BIGINT) AS wallet, rank / (SELECT max(rank) FROM r3 WHERE node LIKE 'w%') AS risk_propagated FROM r3 WHERE node LIKE 'w%'
), anom AS (SELECT wallet, (max_z - (SELECT min(max_z) FROM amounts)) / (SELECT max(max_z) - min(max_z) FROM amounts) AS risk_anomaly FROM amounts
), ruled_chains AS (SELECT chain, least(1.0::DOUBLE, count(*) / 5.0::DOUBLE) AS p FROM chains GROUP BY chain
), peels AS (
  SELECT wallet, max(p) AS risk_peeling, arg_min(chain, {'p': -p, 'chain': chain}) AS best FROM chains JOIN ruled_chains USING (chain)
  JOIN (SELECT txid, wallet FROM outs UNION SELECT txid, wallet FROM ins) USING (txid) GROUP BY wallet
), risks AS (
  SELECT t.*, coalesce(risk_propagated, 0) AS rp, coalesce(risk_anomaly, 0) AS ra, coalesce(risk_peeling, 0) AS rc, wallet IN (SELECT wallet FROM seeds) AS is_seed,
    1 - (1 - coalesce(risk_propagated, 0)) * (1 - coalesce(risk_anomaly, 0)) * (1 - coalesce(risk_peeling, 0)) AS final_risk FROM touch t LEFT JOIN prop USING (wallet) LEFT JOIN anom USING (wallet) LEFT JOIN peels USING (wallet)
), near_tx AS (SELECT DISTINCT txid FROM edges WHERE wallet IN (SELECT wallet FROM seeds))
"""


def _query(sql: str | None):
    def add(fn: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(from_orders(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = _LEDGER_SQL + sql
        return fn

    return add


def _r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


@_query("SELECT txid, ts, vin, wallet, amount, entity FROM ins")
def tx_inputs(ledger: Ledger) -> DataFrame:
    return ledger.inputs


@_query("SELECT txid, ts, vout, wallet, amount, entity FROM outs")
def tx_outputs(ledger: Ledger) -> DataFrame:
    return ledger.outputs.drop("is_change")


@_query("SELECT txid, ts, fee, pattern_type FROM txs")
def tx_nodes(ledger: Ledger) -> DataFrame:
    return ledger.txs.select("txid", "ts", "fee", "pattern_type")


@_query("SELECT txid, ts, ip, role FROM relay")
def tx_relay(ledger: Ledger) -> DataFrame:
    return ledger.relay


@_query("SELECT wallet, entity, EXISTS (SELECT 1 FROM edges e WHERE e.wallet = t.wallet AND e.side = 'in' AND e.entity IS DISTINCT FROM t.entity) AS conflict FROM truth t")
def wallet_nodes(ledger: Ledger) -> DataFrame:
    return graph.wallet_nodes(ledger)


@_query("SELECT 'wallet' AS kind, count(*) AS n FROM walletset UNION ALL SELECT 'tx', count(*) FROM txs UNION ALL SELECT 'ip', count(DISTINCT ip) FROM relay")
def graph_node_counts(ledger: Ledger) -> DataFrame:
    kinds = {"wallet": ledger.edges().select("wallet"), "tx": ledger.txs.select("txid"), "ip": ledger.relay.select("ip")}
    parts = [df.distinct().agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("SELECT CASE side WHEN 'in' THEN 'spends_in' ELSE 'pays_to' END AS relation, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT CASE role WHEN 'by' THEN 'observed_relayed_by' ELSE 'observed_relayed_to' END, count(*) FROM relay GROUP BY 1")
def graph_edge_counts(ledger: Ledger) -> DataFrame:
    money = ledger.edges().select(F.when(F.col("side") == "in", "spends_in").otherwise("pays_to").alias("relation"))
    seen = ledger.relay.select(F.concat(F.lit("observed_relayed_"), "role").alias("relation"))
    return money.unionByName(seen).groupBy("relation").agg(F.count("*").alias("n"))


@_query("SELECT txid, small_wallet, large_wallet, round(ratio, 6) AS ratio FROM peel")
def peel_shaped_tx(ledger: Ledger) -> DataFrame:
    return graph.peel_shaped(ledger).select("txid", "small_wallet", "large_wallet", _r("ratio"))


_COIN_SQL = """SELECT o.txid, o.n AS n_outputs, i.n AS n_inputs, round(sd / m, 6) AS cv FROM (SELECT txid, count(*) AS n, avg(amount) AS m, stddev_pop(amount) AS sd FROM outs GROUP BY txid) o
JOIN (SELECT txid, count(*) AS n FROM ins GROUP BY txid) i USING (txid) WHERE o.n >= 3 AND i.n >= 2 AND m > 0 AND sd / m < """


@_query(_COIN_SQL + "0.05")
def coinjoin_like(ledger: Ledger) -> DataFrame:
    return graph.coinjoin_like(ledger).select("txid", "n_outputs", "n_inputs", _r("cv"))


@_query(_COIN_SQL + "0.25")
def coinjoin_like_relaxed(ledger: Ledger) -> DataFrame:
    return graph.coinjoin_like(ledger, 0.25).select("txid", "n_outputs", "n_inputs", _r("cv"))


@_query("SELECT p.txid, s.next_txid FROM peel p LEFT JOIN spend s USING (txid)")
def next_spend(ledger: Ledger) -> DataFrame:
    return graph.next_spend(graph.peel_shaped(ledger).select("txid", "ts", "large_wallet"), ledger, "large_wallet").select("txid", "next_txid")


@_query("SELECT * FROM chains")
def peeling_chains(ledger: Ledger) -> DataFrame:
    return graph.peeling_chains(ledger)


_CHAIN_SQL = """, hopped AS (
  SELECT c.chain, c.hop, p.ratio, large_amount, large_amount + small_amount AS total, fee / (fee + large_amount + small_amount) AS fraction, pattern_type = 'peeling' AS marked,
    epoch(p.ts) - epoch(lag(p.ts) OVER (PARTITION BY chain ORDER BY hop)) AS gap FROM chains c JOIN peel p USING (txid) JOIN txs t USING (txid)
)"""


@_query(
    _CHAIN_SQL
    + """SELECT chain, count(*) AS hop_count, round(coalesce(avg(gap), 0), 3) AS mean_time_gap_sec, round(coalesce(stddev_pop(gap), 0), 3) AS std_time_gap_sec, coalesce(min(gap), 0) AS min_time_gap_sec, coalesce(max(gap), 0) AS max_time_gap_sec,
  round(avg(ratio), 6) AS mean_ratio, round(stddev_pop(ratio), 6) AS std_ratio, round(1 - arg_max(large_amount, hop) / arg_min(total, hop), 6) AS decline_fraction, round(ln(1 + arg_min(total, hop)), 6) AS log_start_amount,
  round(avg(fraction), 6) AS mean_fee_fraction, CAST(max(CAST(marked AS INTEGER)) AS INTEGER) AS label FROM hopped GROUP BY chain"""
)
def chain_features(ledger: Ledger) -> DataFrame:
    out = graph.chain_features(ledger, graph.peeling_chains(ledger))
    digits = {"mean_time_gap_sec": 3, "std_time_gap_sec": 3}
    return out.select(*[_r(c, digits.get(c, 6)) if t == "double" else F.col(c) for c, t in out.dtypes])


@_query(_CHAIN_SQL + "SELECT count(DISTINCT chain) AS chains, count(DISTINCT CASE WHEN marked THEN chain END) AS true_chains FROM hopped")
def chain_detection_quality(ledger: Ledger) -> DataFrame:
    marked = graph.peeling_chains(ledger).join(ledger.txs, "txid")
    return marked.agg(F.countDistinct("chain").alias("chains"), F.countDistinct(F.when(F.col("chain_id").isNotNull(), F.col("chain"))).alias("true_chains"))


@_query("SELECT a.txid, a.wallet AS a, b.wallet AS b, coalesce(a.entity <> b.entity, FALSE) AS false_merge FROM ins a JOIN ins b ON a.txid = b.txid AND a.vin < b.vin")
def cioh_pairs(ledger: Ledger) -> DataFrame:
    return graph.input_pairs(ledger)


@_query("SELECT * FROM cioh")
def cioh_clusters(ledger: Ledger) -> DataFrame:
    return graph.clusters(ledger, graph.co_spend_edges(ledger))


@_query("""SELECT wallet, least(wallet, coalesce(min(b), wallet)) AS cluster FROM walletset LEFT JOIN (
  WITH RECURSIVE both_ways AS (SELECT src AS a, dst AS b FROM joint UNION SELECT dst, src FROM joint), far AS (SELECT a, b FROM both_ways UNION SELECT f.a, e.b FROM far f JOIN both_ways e ON f.b = e.a) SELECT * FROM far
) ON a = wallet GROUP BY wallet""")
def combined_clusters(ledger: Ledger) -> DataFrame:
    return graph.clusters(ledger, graph.combined_edges(ledger))


@_query("SELECT cluster, count(*) AS size FROM cioh GROUP BY cluster ORDER BY size DESC, cluster LIMIT 5")
def component_sizes(ledger: Ledger) -> DataFrame:
    return graph.clusters(ledger, graph.co_spend_edges(ledger)).groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(5)


@_query("SELECT txid, vout, wallet, fresh FROM fresh")
def fresh_outputs(ledger: Ledger) -> DataFrame:
    return graph.fresh_outputs(ledger).select("txid", "vout", "wallet", "fresh")


@_query("SELECT * FROM change")
def change_predictions(ledger: Ledger) -> DataFrame:
    return graph.change_predictions(ledger)


_PAIRS_SQL = """, lab AS (SELECT entity AS truth, cluster AS pred FROM cioh JOIN truth USING (wallet) WHERE entity IS NOT NULL),
pc AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM lab GROUP BY truth, pred)) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM lab GROUP BY pred)) AS q, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM lab GROUP BY truth)) AS t)
"""


def _labels(ledger: Ledger, edges: DataFrame | None = None) -> DataFrame:
    found = graph.clusters(ledger, graph.co_spend_edges(ledger) if edges is None else edges)
    return found.join(graph.wallet_nodes(ledger), "wallet").select(F.col("entity").alias("truth"), F.col("cluster").alias("pred"))


@_query(_PAIRS_SQL + "SELECT round(CASE WHEN q > 0 THEN b / q ELSE 0 END, 6) AS precision, round(CASE WHEN t > 0 THEN b / t ELSE 0 END, 6) AS recall, round(CASE WHEN b > 0 THEN 2 * (b / q) * (b / t) / (b / q + b / t) ELSE 0 END, 6) AS f1 FROM pc")
def pair_counting(ledger: Ledger) -> DataFrame:
    return metrics.pair_counting(_labels(ledger)).select(_r("precision"), _r("recall"), _r("f1"))


@_query(_PAIRS_SQL + """, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lab), cell AS (SELECT *, sum(c) OVER (PARTITION BY truth) AS a, sum(c) OVER (PARTITION BY pred) AS bb FROM (SELECT truth, pred, count(*) AS c FROM lab GROUP BY ALL))
SELECT round((b - q * t / (n * (n - 1) / 2)) / ((q + t) / 2 - q * t / (n * (n - 1) / 2)), 6) AS ari,
 round((SELECT sum(c / n * ln(c * n / (a * bb))) FROM cell) / (((SELECT -sum(k / n * ln(k / n)) FROM (SELECT count(*) AS k FROM lab GROUP BY truth)) + (SELECT -sum(k / n * ln(k / n)) FROM (SELECT count(*) AS k FROM lab GROUP BY pred))) / 2), 6) AS nmi FROM pc, n""")
def ari_nmi(ledger: Ledger) -> DataFrame:
    return metrics.rand_and_information(_labels(ledger)).select(_r("ari"), _r("nmi"))


@_query("SELECT ip, geo_country, asn, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ips")
def ip_geo_lookup(ledger: Ledger) -> DataFrame:
    return features.ips(ledger).select("ip", "geo_country", "asn", _r("lat"), _r("lon"))


def _database(ledger: Ledger) -> tuple[DataFrame, DataFrame]:
    """A small GeoIP database over the ledger's networks: nested networks, one without a country, some without an ASN."""
    codes = F.array(*[F.lit(c) for c, _, _ in COUNTRIES])
    n = F.col("id")
    net = lambda tail: F.concat(F.lit("45."), n.cast("string"), F.lit(tail))
    wide = ledger.relay.sparkSession.range(30)
    cities = wide.select(net(".0.0/16").alias("network"), F.element_at(codes, (n % 10 + 1).cast("int")).alias("geo_country"), n.cast("double").alias("lat"), (-n).cast("double").alias("lon"))
    inner = wide.where("id % 3 = 0").select(net(".7.0/24").alias("network"), F.lit(None).cast("string").alias("geo_country"), (n + 0.5).cast("double").alias("lat"), (-n - 0.5).cast("double").alias("lon"))
    return cities.unionByName(inner), wide.where("id < 20").select(net(".0.0/16").alias("network"), F.concat(F.lit("AS"), (n + 64000).cast("string")).alias("asn"))


_PLACED_SQL = """, numbered AS (SELECT ip, 45 * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + 7 * 256 + 1 AS number, count(*) AS n FROM relay GROUP BY ip
), cities AS (
  SELECT 45 * 16777216 + i * 65536 AS lo, 45 * 16777216 + i * 65536 + 65535 AS hi, 16 AS bits, (['US','DE','IN','SG','NL','RU','BR','JP','GB','FR'])[i % 10 + 1] AS c, CAST(i AS DOUBLE) AS lat, CAST(-i AS DOUBLE) AS lon FROM range(30) t(i)
  UNION ALL SELECT 45 * 16777216 + i * 65536 + 1792, 45 * 16777216 + i * 65536 + 2047, 24, NULL, i + 0.5::DOUBLE, -i - 0.5::DOUBLE FROM range(0, 30, 3) t(i)
), systems AS (SELECT 45 * 16777216 + i * 65536 AS lo, 45 * 16777216 + i * 65536 + 65535 AS hi, 'AS' || (64000 + i) AS asn FROM range(20) t(i)
), longest AS (SELECT ip, arg_max({'c': c, 'lat': lat, 'lon': lon}, bits) AS city FROM numbered JOIN cities ON number BETWEEN lo AND hi GROUP BY ip
), placed AS (
  SELECT i.ip, n, CASE WHEN s.asn IS NULL THEN i.geo_country ELSE coalesce(city.c, 'UNKNOWN') END AS geo_country, coalesce(s.asn, i.asn) AS asn,
    CASE WHEN s.asn IS NULL THEN i.lat ELSE city.lat END AS lat, CASE WHEN s.asn IS NULL THEN i.lon ELSE city.lon END AS lon, CASE WHEN s.asn IS NULL THEN 'fallback' ELSE 'real' END AS geo_source
  FROM numbered JOIN ips i USING (ip) LEFT JOIN longest USING (ip) LEFT JOIN systems s ON number BETWEEN s.lo AND s.hi
) """


@_query(_PLACED_SQL + "SELECT ip, geo_country, asn, round(lat, 6) AS lat, round(lon, 6) AS lon, geo_source FROM placed")
def geo_database_lookup(ledger: Ledger) -> DataFrame:
    return geo.place(ledger.relay, *_database(ledger)).select("ip", "geo_country", "asn", _r("lat"), _r("lon"), "geo_source")


@_query(_PLACED_SQL + "SELECT geo_source, CAST(sum(n) AS BIGINT) AS lookups FROM placed GROUP BY geo_source")
def geo_source_counts(ledger: Ledger) -> DataFrame:
    return geo.source_counts(ledger.relay, geo.place(ledger.relay, *_database(ledger)))


@_query("SELECT wallet, round(max_v, 2) AS max_geo_velocity_kmh, round(avg_v, 2) AS avg_geo_velocity_kmh FROM vel")
def geo_velocity(ledger: Ledger) -> DataFrame:
    return features.velocity(ledger).select("wallet", _r("max_geo_velocity_kmh", 2), _r("avg_geo_velocity_kmh", 2))


@_query("SELECT * FROM touch")
def pattern_touch(ledger: Ledger) -> DataFrame:
    return features.pattern_touch(ledger)


@_query("""SELECT wallet, round(avg_z, 6) AS avg_amount_zscore, round(max_z, 6) AS max_abs_amount_zscore, tx_count, round(freq, 4) AS tx_frequency_per_day, CAST(fan_in AS BIGINT) AS fan_in_degree, CAST(fan_out AS BIGINT) AS fan_out_degree,
 round(coalesce(max_v, 0), 2) AS max_geo_velocity_kmh, round(coalesce(avg_v, 0), 2) AS avg_geo_velocity_kmh, round(entropy, 6) AS time_of_day_entropy, pattern_types_involved, involved_in_illicit_pattern
FROM amounts JOIN ent USING (wallet) LEFT JOIN vel USING (wallet) JOIN touch USING (wallet)""")
def wallet_features(ledger: Ledger) -> DataFrame:
    digits = {"tx_frequency_per_day": 4, "max_geo_velocity_kmh": 2, "avg_geo_velocity_kmh": 2}
    out = features.wallet_features(ledger)
    return out.select(*[(F.abs(_r(c)).alias(c) if c == "time_of_day_entropy" else _r(c, digits.get(c, 6))) if t == "double" else F.col(c) for c, t in out.dtypes])


@_query("SELECT wallet, round(sign(avg_z) * ln(1 + abs(avg_z)), 6) AS avg_amount_zscore_log, round(ln(1 + freq), 6) AS tx_frequency_per_day_log FROM amounts")
def signed_log(ledger: Ledger) -> DataFrame:
    out = features.with_logs(features.wallet_features(ledger))
    return out.select("wallet", _r("avg_amount_zscore_log"), _r("tx_frequency_per_day_log"))


def _seeds(ledger: Ledger) -> DataFrame:
    return risk.select_seeds(graph.wallet_nodes(ledger), [0, 1, 2, 3, 4])


def _propagated(ledger: Ledger, seeds: DataFrame | None = None) -> DataFrame:
    chosen = _seeds(ledger) if seeds is None else seeds
    ranks = graph.pagerank(graph.flow_edges(ledger), chosen.select(F.concat(F.lit("w"), F.col("wallet").cast("string")).alias("node")), rounds=3)
    wallets = ranks.where(F.col("node").startswith("w"))
    top = wallets.agg(F.max("rank").alias("top"))
    return wallets.crossJoin(F.broadcast(top)).select(F.substring("node", 2, 30).cast("long").alias("wallet"), (F.col("rank") / F.col("top")).alias("risk_propagated"))  # one row


@_query("SELECT wallet, entity FROM truth WHERE wallet IN (SELECT wallet FROM seeds)")
def seed_wallets(ledger: Ledger) -> DataFrame:
    return _seeds(ledger).select("wallet", "entity")


@_query("SELECT wallet, round(risk_propagated, 6) AS risk_propagated FROM prop")
def pagerank_k(ledger: Ledger) -> DataFrame:
    return _propagated(ledger).select("wallet", _r("risk_propagated"))


def _ruled_peeling(ledger: Ledger) -> DataFrame:
    """Peeling risk by a rule that SQL can state, in place of the forest: a fifth for each hop of the longest chain."""
    chains = cut(graph.peeling_chains(ledger))
    ruled = chains.groupBy("chain").agg(F.least(F.lit(1.0), F.count("*") / 5.0).alias("probability"))
    return alerts.wallet_peeling(ledger, chains, ruled.withColumn("reason", F.concat(F.lit("chain "), F.col("chain").cast("string"))))


@_query("SELECT wallet, round(risk_peeling, 6) AS risk_peeling, 'chain ' || best AS reason FROM peels")
def wallet_peeling(ledger: Ledger) -> DataFrame:
    return _ruled_peeling(ledger).select("wallet", _r("risk_peeling"), F.col("peeling_reason").alias("reason"))


def _risks(ledger: Ledger) -> DataFrame:
    """The fused risk over signals that SQL can state; :func:`final_alerts` fuses the models'."""
    scaled = risk.min_max(features.amount_features(ledger), "max_abs_amount_zscore", "risk_anomaly")
    peels = _ruled_peeling(ledger)
    seeds = _seeds(ledger).select("wallet", F.lit(True).alias("is_seed"))
    wallets = features.pattern_touch(ledger).join(seeds, "wallet", "left").fillna(False, ["is_seed"])
    return risk.combine(wallets, _propagated(ledger), scaled, peels)


_ALERT_SQL = "SELECT wallet, round(rp, 6) AS risk_propagated, round(ra, 6) AS risk_anomaly, rc AS risk_peeling, round(final_risk, 6) AS final_risk, is_seed FROM risks"


def _alert(risks: DataFrame) -> DataFrame:
    return risks.select("wallet", _r("risk_propagated"), _r("risk_anomaly"), "risk_peeling", _r("final_risk"), "is_seed")


@_query(_ALERT_SQL)
def risk_noisy_or(ledger: Ledger) -> DataFrame:
    return _alert(_risks(ledger))


@_query(_ALERT_SQL + " ORDER BY risks.final_risk DESC, rp + ra + rc DESC, wallet LIMIT 10")
def ranked_alerts(ledger: Ledger) -> DataFrame:
    return _alert(risk.ranked(_risks(ledger)).limit(10))


@_query(_ALERT_SQL + " WHERE risks.final_risk >= 0.5 AND regexp_matches(pattern_types_involved, 'coin|peel')")
def alert_search(ledger: Ledger) -> DataFrame:
    return _alert(risk.search(_risks(ledger), 0.5, "coin|peel"))


@_query("SELECT count(*) AS wallets, CAST(sum(CASE WHEN final_risk >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, CAST(sum(CASE WHEN final_risk >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS critical, round(avg(CASE WHEN final_risk >= 0.5 THEN final_risk END), 6) AS avg_flagged_risk FROM risks")
def summary_metrics(ledger: Ledger) -> DataFrame:
    return risk.summary(_risks(ledger)).select("wallets", "flagged", "critical", _r("avg_flagged_risk"))


@_query("SELECT wallet, '#' || lower(lpad(printf('%x', CAST(floor(40 + 190 * round(final_risk, 6)) AS INTEGER)), 2, '0') || lpad(printf('%x', CAST(floor(180 - 150 * round(final_risk, 6)) AS INTEGER)), 2, '0')) || '3c' AS color FROM risks")
def risk_colors(ledger: Ledger) -> DataFrame:
    return _risks(ledger).select("wallet", risk_color(F.round("final_risk", 6)).alias("color"))


@_query("SELECT p AS pattern, count(*) AS wallets FROM (SELECT unnest(string_split(pattern_types_involved, ',')) AS p FROM touch) WHERE p <> '' GROUP BY p")
def pattern_counts(ledger: Ledger) -> DataFrame:
    return risk.pattern_counts(features.pattern_touch(ledger))


@_query("SELECT involved_in_illicit_pattern, round(avg(max_z), 6) AS mean_z, round(stddev_samp(max_z), 6) AS std_z, round(max(max_z), 6) AS max_z FROM amounts JOIN touch USING (wallet) GROUP BY 1")
def describe_by_flag(ledger: Ledger) -> DataFrame:
    z = features.amount_features(ledger).join(features.pattern_touch(ledger), "wallet").withColumn("z", F.col("max_abs_amount_zscore"))
    return z.groupBy("involved_in_illicit_pattern").agg(F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.stddev_samp("z"), 6).alias("std_z"), F.round(F.max("z"), 6).alias("max_z"))


def _scored(ledger: Ledger) -> DataFrame:
    joined = features.amount_features(ledger).join(features.pattern_touch(ledger), "wallet")
    return joined.select("wallet", F.col("involved_in_illicit_pattern").cast("int").alias("y"), F.round("max_abs_amount_zscore", 6).alias("score"), F.col("pattern_types_involved").alias("patterns"))


_CURVE_SQL = ", cum AS (SELECT score, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM (SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC))"


@_query(_CURVE_SQL + "SELECT round(sum(pos * tp / al) / sum(pos), 6) AS average_precision FROM cum")
def average_precision(ledger: Ledger) -> DataFrame:
    return metrics.average_precision(_scored(ledger)).select(_r("average_precision"))


@_query(_CURVE_SQL + "SELECT round(sum((n - pos) * (tp - pos / 2)) / (sum(n - pos) * sum(pos)), 6) AS roc_auc FROM cum")
def roc_auc(ledger: Ledger) -> DataFrame:
    return metrics.roc_auc(_scored(ledger)).select(_r("roc_auc"))


_TOP_SQL = ", placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, wallet) AS place, count(*) OVER () AS total FROM scored)"


@_query(_TOP_SQL + ", cuts AS (SELECT share, CAST(greatest(1, round_even((SELECT count(*) FROM scored) * share, 0)) AS BIGINT) AS k FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(share)) SELECT share, k AS flagged, round(sum(y) FILTER (place <= k) / k, 6) AS precision, round(sum(y) FILTER (place <= k) / sum(y), 6) AS recall FROM placed, cuts GROUP BY share, k")
def topk_precision(ledger: Ledger) -> DataFrame:
    return metrics.precision_recall_at(_scored(ledger)).select("share", "flagged", _r("precision"), _r("recall"))


@_query(_TOP_SQL + " SELECT p AS pattern, count(*) AS wallets, round(avg(CAST(place <= k AS INTEGER)), 6) AS recall FROM (SELECT place, greatest(1, round_even(total * 0.2::DOUBLE, 0)) AS k, unnest(string_split(patterns, ',')) AS p FROM placed) WHERE p <> '' GROUP BY p")
def pattern_recall_at_k(ledger: Ledger) -> DataFrame:
    return metrics.pattern_recall(_scored(ledger)).select("pattern", "wallets", _r("recall"))


@_query("SELECT DISTINCT wallet AS node, 'wallet' AS kind FROM edges WHERE txid IN (SELECT txid FROM near_tx) UNION ALL SELECT txid, 'tx' FROM near_tx")
def neighborhood_nodes(ledger: Ledger) -> DataFrame:
    return graph.neighbourhood(ledger, _seeds(ledger).select("wallet"))


@_query("SELECT txid, side, pos, wallet, amount FROM edges WHERE txid IN (SELECT txid FROM near_tx)")
def neighborhood_edges(ledger: Ledger) -> DataFrame:
    near = graph.neighbourhood(ledger, _seeds(ledger).select("wallet")).where("kind = 'tx'").select(F.col("node").alias("txid"))
    return ledger.edges().join(near, "txid", "left_semi").select("txid", "side", "pos", "wallet", "amount")


@_query(None)
def anomaly_scores(ledger: Ledger) -> DataFrame:
    data = features.with_logs(features.wallet_features(ledger))
    return forest.score(data, forest.fit(data, list(features.MODEL)), "anomaly_score").select("wallet", "anomaly_score")


@_query(None)
def anomaly_reasons(ledger: Ledger) -> DataFrame:
    data = features.with_logs(features.wallet_features(ledger))
    return forest.explain(data, forest.fit(data, list(features.MODEL))).select("wallet", "shap_reason", *[f"shap_{c}" for c in features.MODEL])


@_query(None)
def chain_probabilities(ledger: Ledger) -> DataFrame:
    rows = graph.chain_features(ledger, graph.peeling_chains(ledger))
    return forest.classify(rows).select("chain", "label", "probability")


_VIEW_SQL = """, rated AS (SELECT wallet, round(final_risk, 6) AS risk FROM risks), top12 AS (SELECT wallet FROM rated ORDER BY risk DESC, wallet LIMIT 12),
vtx AS (SELECT txid, row_number() OVER (ORDER BY txid) AS place FROM (SELECT DISTINCT txid FROM edges WHERE wallet IN (SELECT wallet FROM top12))),
vw AS (SELECT wallet, risk, row_number() OVER (ORDER BY risk DESC, wallet) AS place FROM rated WHERE wallet IN (SELECT wallet FROM edges WHERE txid IN (SELECT txid FROM vtx))),
big AS (SELECT (SELECT count(*) FROM vtx) + (SELECT count(*) FROM vw) > 150 AS b),
kw AS (SELECT wallet, risk, wallet IN (SELECT wallet FROM top12) AS is_seed FROM vw, big WHERE NOT b OR place <= 75), kt AS (SELECT txid FROM vtx, big WHERE NOT b OR place <= 75)
"""


@_query(
    _VIEW_SQL
    + """SELECT CAST(wallet AS VARCHAR) AS id, 'wallet' AS kind, substr(CAST(wallet AS VARCHAR), 1, 10) || '...' AS label, round(15 + 20 * risk + CASE WHEN is_seed THEN 8 ELSE 0 END, 4) AS size,
  '#' || lower(lpad(printf('%x', CAST(floor(40 + 190 * risk) AS INTEGER)), 2, '0') || lpad(printf('%x', CAST(floor(180 - 150 * risk) AS INTEGER)), 2, '0')) || '3c' AS color, CASE WHEN is_seed THEN 3 ELSE 1 END AS border FROM kw
UNION ALL SELECT CAST(txid AS VARCHAR), 'tx', 'TX:' || substr(CAST(txid AS VARCHAR), 1, 8), 10, CASE WHEN coalesce(pattern_type, 'normal') = 'normal' THEN '#999999' ELSE '#333333' END, 1 FROM kt JOIN txs USING (txid)"""
)
def subgraph_nodes(ledger: Ledger) -> DataFrame:
    nodes, _ = graph.subgraph(ledger, _risks(ledger))
    plain = F.when(F.coalesce("pattern_type", F.lit("normal")) == "normal", "#999999").otherwise("#333333")
    return nodes.select("id", "kind", "label", _r("size", 4), F.when(F.col("kind") == "wallet", risk_color(F.col("risk"))).otherwise(plain).alias("color"), F.when(F.col("is_seed"), 3).otherwise(1).alias("border"))


@_query(
    _VIEW_SQL
    + """SELECT CASE side WHEN 'in' THEN CAST(wallet AS VARCHAR) ELSE CAST(txid AS VARCHAR) END AS source, CASE side WHEN 'in' THEN CAST(txid AS VARCHAR) ELSE CAST(wallet AS VARCHAR) END AS target, CASE side WHEN 'in' THEN 'spends' ELSE 'pays' END AS label
FROM edges WHERE wallet IN (SELECT wallet FROM kw) AND txid IN (SELECT txid FROM kt)"""
)
def subgraph_edges(ledger: Ledger) -> DataFrame:
    return graph.subgraph(ledger, _risks(ledger))[1]


def _chain_rows(ledger: Ledger) -> DataFrame:
    return cut(graph.chain_features(ledger, graph.peeling_chains(ledger)))


@_query(
    _CHAIN_SQL
    + """, ruled AS (SELECT chain, max(CAST(marked AS INTEGER)) AS y, CAST(count(*) >= 3 AS INTEGER) AS p FROM hopped GROUP BY chain),
c AS (SELECT count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM ruled)
SELECT tn, fp, fn, tp, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c"""
)
def chain_rule_report(ledger: Ledger) -> DataFrame:
    """The report over a rule in place of a model: chains of three hops or more."""
    rows = graph.chain_features(ledger, graph.peeling_chains(ledger)).withColumn("predicted", (F.col("hop_count") >= 3).cast("int"))
    return validation.report(rows).select("tn", "fp", "fn", "tp", _r("precision"), _r("recall"), _r("f1"))


@_query(None)
def chain_hold_out(ledger: Ledger) -> DataFrame:
    return validation.report(validation.hold_out(_chain_rows(ledger)))


@_query(None)
def chain_leave_one_out(ledger: Ledger) -> DataFrame:
    return validation.report(validation.leave_one_out(_chain_rows(ledger)))


@_query(None)
def chain_importances(ledger: Ledger) -> DataFrame:
    return validation.importances(_chain_rows(ledger))


@_query(None)
def chain_reasons(ledger: Ledger) -> DataFrame:
    return validation.explain_chains(_chain_rows(ledger))


@_query("""SELECT CAST(coalesce(sum(n * (n - 1) / 2), 0) AS BIGINT) AS merge_pairs, CAST(coalesce(sum(wrong), 0) AS BIGINT) AS false_merge_pairs FROM (
  SELECT a.txid, count(*) AS n, (SELECT count(*) FROM ins x JOIN truth tx ON tx.wallet = x.wallet JOIN ins y ON y.txid = x.txid AND x.vin < y.vin JOIN truth ty ON ty.wallet = y.wallet WHERE x.txid = a.txid AND tx.entity <> ty.entity) AS wrong
  FROM ins a JOIN txs ON txs.txid = a.txid WHERE pattern_type = 'coinjoin' GROUP BY a.txid)""")
def mix_false_merges(ledger: Ledger) -> DataFrame:
    return metrics.false_merges(ledger)


@_query("""SELECT hits, flagged, mixes, round(CASE WHEN flagged > 0 THEN hits / flagged ELSE 0 END, 6) AS precision, round(CASE WHEN mixes > 0 THEN hits / mixes ELSE 0 END, 6) AS recall FROM (
  SELECT count(*) FILTER (m AND f) AS hits, count(*) FILTER (f) AS flagged, count(*) FILTER (m) AS mixes FROM (SELECT pattern_type = 'coinjoin' AS m, txid IN (SELECT txid FROM ("""
    + _COIN_SQL + """0.5)) AS f FROM txs))""")
def mix_detection_quality(ledger: Ledger) -> DataFrame:
    return metrics.mix_detection(ledger, graph.coinjoin_like(ledger, 0.5)).select("hits", "flagged", "mixes", _r("precision"), _r("recall"))


@_query("""SELECT predictions, correct, real_cases, round(CASE WHEN predictions > 0 THEN correct / predictions ELSE 0 END, 6) AS precision, round(CASE WHEN real_cases > 0 THEN correct / real_cases ELSE 0 END, 6) AS recall FROM (
  SELECT (SELECT count(*) FROM change) AS predictions, (SELECT count(*) FROM change c WHERE EXISTS (SELECT 1 FROM outs o WHERE o.txid = c.txid AND o.wallet = c.wallet AND o.is_change)) AS correct,
    (SELECT count(*) FROM (SELECT txid FROM outs GROUP BY txid HAVING count(*) = 2 AND bool_or(is_change))) AS real_cases)""")
def change_detection_quality(ledger: Ledger) -> DataFrame:
    return metrics.change_detection(ledger, graph.change_predictions(ledger)).select("predictions", "correct", "real_cases", _r("precision"), _r("recall"))


_BOTH_SQL = """, both_ways AS (SELECT src AS a, dst AS b FROM joint UNION SELECT dst, src FROM joint), far AS (SELECT a, b FROM both_ways UNION SELECT f.a, e.b FROM far f JOIN both_ways e ON f.b = e.a),
joined AS (SELECT wallet, least(wallet, coalesce(min(b), wallet)) AS cluster FROM walletset LEFT JOIN far ON a = wallet GROUP BY wallet)
""" + _PAIRS_SQL.replace("FROM cioh JOIN", "FROM joined JOIN")


@_query(_BOTH_SQL + "SELECT round(CASE WHEN q > 0 THEN b / q ELSE 0 END, 6) AS precision, round(CASE WHEN t > 0 THEN b / t ELSE 0 END, 6) AS recall, round(CASE WHEN b > 0 THEN 2 * (b / q) * (b / t) / (b / q + b / t) ELSE 0 END, 6) AS f1 FROM pc")
def combined_pair_counting(ledger: Ledger) -> DataFrame:
    return metrics.pair_counting(_labels(ledger, graph.combined_edges(ledger))).select(_r("precision"), _r("recall"), _r("f1"))


@_query(None)
def final_alerts(ledger: Ledger) -> DataFrame:
    ledger = replace(ledger, inputs=cut(ledger.inputs), outputs=cut(ledger.outputs))  # a dozen steps read them
    seeds = cut(_seeds(ledger))
    found = alerts.final_alerts(ledger, cut(_propagated(ledger, seeds)), seeds)
    return risk.ranked(found).select("wallet", "risk_propagated", "risk_anomaly", "risk_peeling", "final_risk", "tie_break_score", "is_seed", "explanation", "anomaly_reason", "peeling_reason", "final_explanation")
