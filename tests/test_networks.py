import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions.columns import ip_to_long, net_bounds
from tracewell.operators import analytics, ioc
from tracewell.operators.analytics import enrich_any, enrich_ip
from tracewell.operators.networks import innermost


def longest(nets, ip):
    """The plain way: every network, the longest prefix."""
    a = ipaddress.ip_address(ip)
    held = [n for n in nets if n.version == a.version and a in n]
    return str(max(held, key=lambda n: n.prefixlen)) if held else None


def some_networks(seed, version):
    rng, bits = random.Random(seed), 32 if version == 4 else 128
    network = ipaddress.IPv4Network if version == 4 else ipaddress.IPv6Network
    base = rng.getrandbits(bits)
    out = {network((base & ~((1 << (bits - k)) - 1), k)) for k in (0, 3, 8, 12, 16, 17, 24, 30, bits)}
    for _ in range(60):
        k = rng.choice([4, 9, 14, 16, 18, 20, 22, 24, 28, bits])
        out.add(network(((base ^ rng.getrandbits(bits - rng.choice([4, 8, 12, 16, 20]))) & ~((1 << (bits - k)) - 1), k)))
    return sorted(out), base


@pytest.mark.parametrize("seed", range(3))
def test_the_longest_prefix_counts(spark, seed):
    (four, a), (six, b) = some_networks(seed, 4), some_networks(seed, 6)
    rng = random.Random(seed)
    ips = [str(ipaddress.IPv4Address(a ^ rng.getrandbits(rng.randint(1, 32)))) for _ in range(200)] + [str(ipaddress.IPv6Address(b ^ rng.getrandbits(rng.randint(1, 128)))) for _ in range(200)]
    for n in [*four, *six]:  # and both ends of every network
        ips += [str(n.network_address), str(n.broadcast_address)]
    nets = spark.createDataFrame([(*net_bounds(str(n)), str(n)) for n in [*four, *six]], "net_start string, net_end string, net string").repartition(5)
    rows = spark.createDataFrame([(i,) for i in [*ips, "x", None]], "ip string").repartition(5)
    got = {r["ip"]: r["net"] for r in enrich_any(rows, F.col("ip"), nets).collect()}
    assert got == {i: longest([*four, *six], i) if i and i != "x" else None for i in [*ips, "x", None]}
    numbers = spark.createDataFrame([(int(n.network_address), int(n.broadcast_address), str(n)) for n in four], "net_start long, net_end long, net string")
    only4 = rows.where("ip not like '%:%'").withColumn("ip_number", ip_to_long(F.col("ip")))
    got = {r["ip"]: r["net"] for r in enrich_ip(only4, numbers).collect()}
    assert got == {i: longest(four, i) for i in ips if ":" not in i} | {"x": None}


def test_addresses_of_one_leading_part_use_several_ranges(spark, monkeypatch):
    written, kept = {}, analytics.persisted
    monkeypatch.setattr(analytics, "persisted", lambda df, label: written.setdefault(label, kept(df, label)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # the wide network begins in the first range and holds in all of them
        nets = spark.createDataFrame([(*net_bounds(n), n) for n in ("2001:db8::/32", "2001:db8:1::/120")], "net_start string, net_end string, net string")
        rows = spark.range(4000).select(F.concat(F.lit("2001:db8:1::"), F.lower(F.hex("id"))).alias("ip"))
        got = enrich_any(rows, F.col("ip"), nets).groupBy("net").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["net"]: r["count"] for r in got} == {"2001:db8:1::/120": 256, "2001:db8::/32": 3744}
    parts = [r["count"] for r in written["ranges"].groupBy("_part").count().collect()]
    assert len(parts) > 4 and max(parts) < 1000


def test_intervals_become_disjoint(spark):
    rows = [("h", 0, 100, "a"), ("h", 10, 20, "b"), ("h", 10, 20, "c"), ("h", 15, 30, "d"), ("h", 100, 100, "e"), ("g", 5, 6, "f")]
    got = innermost(spark.createDataFrame(rows, "head string, net_start long, net_end long, org string"), "head").collect()
    assert sorted(map(tuple, got)) == [("g", 5, 6, "f"), ("h", 0, 9, "a"), ("h", 10, 14, "c"), ("h", 15, 30, "d"), ("h", 31, 99, "a"), ("h", 100, 100, "e")]
    assert innermost(spark.createDataFrame([], "head string, net_start long, net_end long, org string"), "head").count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_sweep_finds_each_indicator_once_a_row(spark, monkeypatch, few):
    monkeypatch.setattr(ioc, "FEW_INDICATORS", few)
    monkeypatch.setattr(ioc, "OUT_ROWS", 3)
    texts = [(1, "abc ABC é É x.y"), (2, None), (3, ""), (4, "aabcabc"), (5, "İstanbul")]
    wanted = ["abc", "ABC", "bc", "É", " x.y ", "", "none", "aab", "abc"]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    got = sorted((r["indicator"], r["id"]) for r in ioc.sweep(df, F.col("text"), wanted).collect())
    assert got == sorted((w, i) for i, t in texts for w in {x.strip() for x in wanted if x.strip()} if t and w.lower() in t.lower())
    assert ioc.sweep(df, F.col("text"), [" "]).count() == 0


def test_ten_thousand_indicators_cost_little_more_than_ten(spark, sf_dir, monkeypatch):
    import time

    monkeypatch.setattr(ioc, "FEW_INDICATORS", 0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet".replace("sf0.001", "sf0.01")).select(F.col("doc_id").alias("id"), F.lit(None).cast("timestamp_ntz").alias("ts"), "text")
    docs = docs.unionByName(docs).unionByName(docs).unionByName(docs).repartition(8).cache()
    docs.count()

    def took(n):
        wanted = [f"{i:06x}zq" for i in range(n)]
        ioc.sweep(docs, F.col("text"), wanted).count()
        began = time.time()
        ioc.sweep(docs, F.col("text"), wanted).count()
        return time.time() - began

    assert took(10_000) < 3 * took(10) + 0.5


def test_indicators_are_grouped_by_shown_type(spark):
    md5, imp = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    texts = [(1, f"at 8.8.8.8 and /etc/a/b {md5} IMPHASH={imp.upper()}"), (2, r"C:\temp\x and 8.8.8.8, me@x.com"), (3, f"10.0.0.1 {imp}")]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    found = ioc.extracted(df, F.col("text"), import_hash_twice=False).cache()
    # what stands as an import hash in a text is no file hash there
    assert sorted((r["id"], r["value"]) for r in found.where("type = 'md5'").collect()) == [(1, md5), (3, imp)]
    got = ioc.totals(found).collect()
    assert [(r["type"], r["label"], r["total"]) for r in got] == [("ipv4", "IPv4", 2), ("email", "Emails", 1), ("md5", "MD5", 2), ("imphash", "Imphash", 1), ("filepath", "File paths", 2)]
    assert {r["grand_total"] for r in got} == {sum(r["total"] for r in got)}
    rows = ioc.grouped(found, 1).collect()
    assert [(r["type"], r["value"], r["n"], r["total"]) for r in rows][0] == ("ipv4", "8.8.8.8", 2, 2) and len(rows) == len(got)
