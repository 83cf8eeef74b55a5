"""GeoIP tables against Python's own address arithmetic, and the stage runner."""

import ipaddress
import random

import pytest

from ledgerweave.plans import stages
from ledgerweave.sources import files, geo


def test_longest_network_wins_as_in_brute_force(spark):
    rng = random.Random(5)
    networks = {"0.0.0.0/0", "10.0.0.0/8", "10.0.0.1", "255.255.255.255/32"}
    networks |= {str(ipaddress.ip_network((f"10.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}", rng.choice([9, 14, 16, 22, 24, 30])), strict=False)) for _ in range(60)}
    ips = ["10.0.0.1", "255.255.255.255", "0.0.0.0", *[f"10.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(200)]]
    table = spark.createDataFrame([(n, n) for n in sorted(networks)] + [("300.1.1.1/8", "x"), ("10.0.0.0/40", "x"), ("10.0.0.0/y", "x"), (None, "x"), ("2001:db8::/32", "x")], "network string, name string")
    known = [(ipaddress.ip_network(n), n) for n in networks]
    want = {ip: max((k.prefixlen, n) for k, n in known if ipaddress.ip_address(ip) in k)[1] for ip in ips}
    asked = spark.createDataFrame([(ip,) for ip in [*set(ips), "256.1.1.1", "1.2.3", "::1", "", " 10.0.0.1"]], "ip string")
    assert {r.ip: r.found.name for r in geo.longest_match(asked, table).collect()} == want


def test_places_and_counts(spark, tmp_path):
    header = "network,geoname_id,latitude,longitude\n"
    (tmp_path / geo.CITY_FILE).write_text(header + "1.0.0.0/8,7,10.5,-20.25\n2.0.0.0/8,9,1,2\n3.0.0.0/8,7,3,4\n")
    (tmp_path / geo.PLACE_FILE).write_text('geoname_id,country_iso_code,city_name\n7,FR,"A ""b"", c"\n9,,\n')
    (tmp_path / geo.ASN_FILE).write_text("network,autonomous_system_number,autonomous_system_organization\n1.0.0.0/8,13335,X\n2.2.0.0/16,77,Y\n")
    cities, asns = geo.read_database(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("1.2.3.4", 1), ("1.2.3.4", 2), ("2.2.0.9", 3), ("2.3.0.9", 4), ("3.1.1.1", 5), ("8.8.8.8", 6), ("::1", 7), (None, 8)], "ip string, geo_source long")
    placed = geo.place(rows, cities, asns)
    got = {r.ip: (r.geo_country, r.asn, r.lat, r.lon, r.geo_source) for r in placed.collect()}
    assert got["1.2.3.4"] == ("FR", "AS13335", 10.5, -20.25, "real")
    assert got["2.2.0.9"] == ("UNKNOWN", "AS77", 1.0, 2.0, "real")
    assert {got[x][4] for x in ("2.3.0.9", "3.1.1.1", "8.8.8.8", "::1")} == {"fallback"} and len(got) == 6
    assert got["8.8.8.8"][1] == "AS46243"
    assert {r.geo_source: r.lookups for r in geo.source_counts(rows.select("ip"), placed).collect()} == {"real": 3, "fallback": 4}
    none = geo.place(rows, cities.limit(0), asns)
    assert {r.geo_source for r in none.collect()} == {"fallback"}
    assert geo.place(rows.limit(0), cities, asns).count() == 0


def test_a_failed_stage_ends_the_run(spark, tmp_path):
    said = []
    steps = [("first", lambda s, f: {"one": s.range(3)}), ("second", lambda s, f: {"two": s.read.parquet(f"{f}/one").selectExpr("raise_error('broken') AS x")}), ("third", lambda s, f: {"three": s.range(1)})]
    with pytest.raises(stages.StageFailed, match="second") as failed:
        stages.run_stages(spark, f"file://{tmp_path}/run", steps, said.append)
    assert [(o.name, o.ok) for o in failed.value.outcomes] == [("first", True), ("second", False)]
    assert "broken" in failed.value.outcomes[-1].error and len(said) == 2
    assert spark.read.parquet(f"{tmp_path}/run/one").count() == 3 and not (tmp_path / "run" / "three").exists()


def test_all_ledger_stages_run_in_order(spark, tmp_path):
    done = stages.run_stages(spark, f"file://{tmp_path}", stages.LEDGER_STAGES, lambda line: None)
    assert [o.name for o in done] == [name for name, _ in stages.LEDGER_STAGES] and all(o.ok and o.seconds > 0 for o in done)
    alerts = spark.read.parquet(f"{tmp_path}/alerts")
    assert alerts.count() == alerts.select("wallet").distinct().count() == spark.read.parquet(f"{tmp_path}/wallet_features").count()
    assert alerts.where("is_seed").count() == spark.read.parquet(f"{tmp_path}/seeds").count() > 0
    assert alerts.where("final_explanation IS NULL").count() == 0
    files.write_csv(alerts, f"{tmp_path}/alerts_csv")
    assert files.read_csv(spark, f"{tmp_path}/alerts_csv", alerts.schema).count() == alerts.count()
