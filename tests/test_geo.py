"""Addresses and networks of both families against the standard library and a brute-force longest prefix."""

import ipaddress
import random

from pyspark.sql import functions as F

from tallyloom.operators import geo

TEXTS = [
    "10.0.0.1", "255.255.255.255", "0.0.0.0", " 1.2.3.4 ", "1.2.3", "1.2.3.256", "01.2.3.4", "1.2.3.4.5", "", "x", "::", "::1", "1::", "2001:db8::1", "2001:DB8:0:0:8:800:200C:417A", "::ffff:1.2.3.4",
    "::1.2.3.4", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", ":::", "12345::", "g::", "fe80::1%eth0", "[::1]",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::1.2.3", "1.2.3.4::", "::ffff:0:1.2.3.4", None,
]


def plain(text):
    try:
        a = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    if a.version == 4:
        return 0xFFFF << 32 | int(a)
    n = int(a)
    return 0xFFFF << 32 | n if 1 << 16 <= n < 1 << 32 else n


def test_addresses(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t STRING").select("t", geo.address_hex(F.col("t")).alias("h")).collect()
    for r in got:
        want = plain(r["t"])
        assert r["h"] == (None if want is None or "%" in r["t"] else f"{want:032x}"), r["t"]


def test_prefixes(spark):
    rows = [(f"{0x123456789ABCDEF0FEDCBA9876543210 << 0:032x}", n) for n in range(129)]
    for r in spark.createDataFrame(rows, "d STRING, n INT").select("n", geo.prefix_hex(F.col("d"), F.col("n")).alias("p")).collect():
        kept = int(rows[0][0], 16) >> (128 - r["n"]) << (128 - r["n"])
        assert r["p"] == f"{kept:032x}"[: -(-r["n"] // 4)]


def test_longest_prefix_against_brute_force(spark):
    rng = random.Random(2)
    networks = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "10.1.2.3", "2001:db8::/32", "2001:db8:8000::/33", "2001:db8:8000::1/128", "::ffff:10.9.0.0/112", "::/0", "1.2.3.0/33", "bad/8", None]
    networks += [f"{ipaddress.IPv6Address(0x20010DB8 << 96 | rng.getrandbits(96) >> s << s)}/{128 - s}" for s in rng.choices(range(4, 96), k=40)]
    networks += [f"{ipaddress.IPv4Address(10 << 24 | rng.getrandbits(24) >> s << s)}/{32 - s}" for s in rng.choices(range(2, 20), k=40)]
    table = [(n, f"C{k}", None, "x", float(k), 0.0) for k, n in enumerate(networks)]
    known = {}
    for k, n in enumerate(networks):
        try:
            net = ipaddress.ip_network(n or "", strict=False)
        except ValueError:
            continue
        lead = 96 if net.version == 4 else 0
        start = (0xFFFF << 32 | int(net.network_address)) if net.version == 4 else int(net.network_address)
        key = (net.prefixlen + lead, start)
        known[key] = min(known.get(key, f"C{k}"), f"C{k}")
    asked = [str(ipaddress.IPv6Address(0x20010DB8 << 96 | rng.getrandbits(96))) for _ in range(80)] + [str(ipaddress.IPv4Address(10 << 24 | rng.getrandbits(24))) for _ in range(80)]
    asked += [f"::ffff:{a}" for a in asked[80:90]] + [n.split("/")[0] for n in networks if n] + ["9.9.9.9", None, "::5"]
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(asked)], "id INT, ip STRING")
    got = {r["id"]: r["country"] for r in geo.geo_enrich_networks(rows, spark.createDataFrame(table, "network STRING, country STRING, region STRING, city STRING, lat DOUBLE, lon DOUBLE")).collect()}
    for k, a in enumerate(asked):
        n = plain(a)
        fits = [] if n is None else [(length, c) for (length, start), c in known.items() if n >> (128 - length) == start >> (128 - length)]
        assert got[k] == (max(fits)[1] if fits else None), a
    assert len(got) == len(asked)
    assert geo.geo_enrich_networks(rows, spark.createDataFrame([], "network STRING, country STRING, region STRING, city STRING, lat DOUBLE, lon DOUBLE")).where("country is null").count() == len(asked)
