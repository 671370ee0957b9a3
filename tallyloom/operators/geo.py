"""Places of IPv4 and IPv6 addresses: the longest network prefix that an address has.

Addresses of both families become 128 bits as 32 hexadecimal digits; those of IPv4 (and IPv6 addresses that map or only wrap them) lie
in ``::ffff:0:0/96``. For each length that networks have, an address's prefix of it is looked up by an equi-join on
(length, prefix); the longest one found wins. So the work is one join row per distinct address and length, never a range join.
Only distinct addresses and the networks are read by Python.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLACE = ("country", "region", "city", "lat", "lon")
#: The first bits of a digit that stay, by how many are wanted.
_NIBBLES = {1: "0000000088888888", 2: "000044448888cccc", 3: "0022446688aaccee"}
_WRAPPED = 0xFFFF << 32
#: Up to so many networks the table is broadcast (about 100 bytes each).
MAX_BROADCAST_NETWORKS = 500_000


def _digits(text: str | None) -> str | None:
    try:
        address = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    n = int(address)
    if address.version == 4:
        n |= _WRAPPED
    elif address.scope_id is not None:
        return None
    elif 1 << 16 <= n < 1 << 32:  # ::a.b.c.d, but for ::, ::1 and the like, is an old way to write IPv4
        n |= _WRAPPED
    return f"{n:032x}"


def address_hex(ip: Column) -> Column:
    """The 32 digits of an address in either notation, null for what is none (also with a zone or a port)."""

    def digits(texts: pd.Series) -> pd.Series:
        return pd.Series([_digits(t) for t in texts], dtype=object)

    return F.pandas_udf(digits, StringType())(ip)


def prefix_hex(digits: Column, length: Column) -> Column:
    """The first ``length`` bits, as digits: whole ones and, if bits are left, one with the others set to 0."""
    whole = (length / 4).cast("int")
    part = F.substring(digits, whole + 1, F.lit(1))
    cut = F.lit("")
    for bits, mask in _NIBBLES.items():
        cut = F.when(length % 4 == bits, F.translate(part, "0123456789abcdef", mask)).otherwise(cut)
    return F.concat(F.substring(digits, F.lit(1), whole), cut)


def network_prefixes(networks: DataFrame, network: str = "network") -> DataFrame:
    """Replace ``network`` (``address/length``; no length: one address) by ``length`` (of 128) and ``prefix``; what is none goes."""
    address = F.trim(F.substring_index(network, "/", 1))
    most = F.when(address.contains(":"), 128).otherwise(32)
    bits = F.when(F.col(network).contains("/"), F.regexp_extract(network, r"/([0-9]{1,3})$", 1).try_cast("int")).otherwise(most)
    made = networks.withColumns({"_hex": address_hex(address), "length": F.when(bits <= most, bits + 128 - most)}).where("_hex is not null and length is not null")
    return made.withColumn("prefix", prefix_hex(F.col("_hex"), F.col("length"))).drop(network, "_hex")


def geo_enrich_networks(rows: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """Replace the address by the place of its longest network; ``networks`` has ``network`` and PLACE.

    Addresses that are none, null or in no network get nulls. Of networks that are given twice the least place counts.
    """
    place = F.struct(*PLACE)
    known = network_prefixes(networks.select("network", *PLACE)).groupBy("length", "prefix").agg(F.min(place).alias("_g"))
    lengths = [r["length"] for r in known.select("length").distinct().orderBy("length").collect()]  # at most 129
    if known.limit(MAX_BROADCAST_NETWORKS + 1).count() <= MAX_BROADCAST_NETWORKS:
        known = F.broadcast(known)
    addresses = rows.select(ip).where(F.col(ip).isNotNull()).distinct()
    addresses = addresses.withColumn("_hex", address_hex(F.col(ip))).where("_hex is not null")
    tries = addresses.withColumn("length", F.explode(F.lit(lengths).cast("array<int>"))).withColumn("prefix", prefix_hex(F.col("_hex"), F.col("length")))
    found = tries.join(known, ["length", "prefix"]).groupBy(ip).agg(F.max_by("_g", "length").alias("_g"))
    return rows.join(found, ip, "left").select(*(c for c in rows.columns if c != ip), *(F.col(f"_g.{c}").alias(c) for c in PLACE))
