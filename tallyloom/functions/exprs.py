"""Column expressions that several operators share; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U16, U32, I63 = 65_535, 4_294_967_295, 9_223_372_036_854_775_807


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def local_day(at: Column | str, zone: Column | str) -> Column:
    """The store's calendar day of a UTC timestamp; right on days of 23 and 25 hours too."""
    return F.to_date(F.from_utc_timestamp(col(at), col(zone)))


def is_provisional(day: Column, now: Column, zone: Column, days: int) -> Column:
    """1 while the day's midnight is later than ``days`` before now, both in the store's time."""
    return (day.cast("timestamp") > F.from_utc_timestamp(now, zone) - F.expr(f"INTERVAL {days} DAYS")).cast("int")


def percent(part: Column | str, whole: Column | str) -> Column:
    """To one decimal; null where the whole is not positive."""
    return F.when(col(whole) > 0, F.round(col(part) / col(whole) * 100, 1))


def divide(part: Column | str, whole: Column | str) -> Column:
    return F.when(col(whole) > 0, col(part) / col(whole))


def change(now: Column, before: Column) -> Column:
    """Relative change in percent; null without a figure to compare with, or with zero."""
    return F.when(before != 0, F.round((now - before) / F.abs(before) * 100, 1))


def hex_digest(text: Column) -> Column:
    """16 bytes of SHA-256 as 32 hex digits."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(32))


def key63(text: Column) -> Column:
    """The first 8 bytes of SHA-256 without their top bit, as BIGINT."""
    head = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")


def hmac_hex(message: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """HMAC-SHA256, 16 bytes as hex; the pads are binary columns of 64 bytes (see ``hmac_pads``)."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message.cast("binary")), 256))
    return F.left(F.sha2(F.concat(outer_pad, inner), 256), F.lit(32))


def hmac_pads(secret: bytes) -> tuple[bytes, bytes]:
    """A key's inner and outer pad, computed once per tenant on the driver."""
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def minor(amount: Column) -> Column:
    """Money in minor units; what is no number becomes 0."""
    return F.coalesce(F.round(amount.try_cast("double") * 100).cast("bigint"), F.lit(0).cast("bigint"))


def gid_tail(gid: Column) -> Column:
    """The trailing number of a global id."""
    return F.regexp_extract(gid, "([0-9]+)$", 1).try_cast("bigint")


def fitted(text: Column, most: int) -> Column:
    """Trimmed and cut to ``most`` characters; blank is null."""
    cut = F.left(F.trim(text), F.lit(most))
    return F.when(F.length(cut) > 0, cut)


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, part: str) -> Column:
    """By the RFC 3986 grammar: ``host`` (lower case, no user or port), ``path`` or ``query``."""
    got = F.regexp_extract(url, "(?s)" + _URL, {"host": 2, "path": 3, "query": 4}[part])
    if part == "host":
        got = F.lower(F.regexp_replace(F.regexp_replace(got, "^.*@", ""), ":[0-9]*$", ""))
    return F.when(F.length(got) > 0, got)


def query_value(query: Column, name: str) -> Column:
    """The last value of a query parameter, decoded; an undecodable one stays as it is."""
    pairs = F.filter(F.split(query, "&"), lambda x: (x == name) | x.startswith(name + "="))
    raw = F.regexp_replace(F.try_element_at(pairs, F.lit(-1)), f"^{name}=?", "")
    return F.coalesce(F.try_url_decode(raw), raw)


def starts_with_any(text: Column, cases: list[tuple[str, str]], otherwise: str) -> Column:
    return reduce(lambda rest, case: F.when(text.startswith(case[0]), case[1]).otherwise(rest), reversed(cases), F.lit(otherwise))


def contains_any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


# Page types by path prefix.
PAGE_PREFIXES = [
    ("/products/", "product"),
    ("/collections/", "collection"),
    ("/cart", "cart"),
    ("/checkouts/", "checkout"),
    ("/search", "search"),
    ("/pages/", "page"),
    ("/blogs/", "blog"),
    ("/account", "account"),
]


def page_type(path: Column) -> Column:
    return F.when(path.isin("/", ""), "home").otherwise(starts_with_any(path, PAGE_PREFIXES, "other"))


def device_type(agent: Column) -> Column:
    """4 bot, 3 tablet, 1 phone, 2 anything else."""
    low = F.lower(agent)
    return (
        F.when(contains_any(low, "bot", "crawler", "spider", "headless"), 4)
        .when(contains_any(low, "ipad", "tablet"), 3)
        .when(contains_any(low, "mobi", "android", "iphone"), 1)
        .otherwise(2)
    )


def browser(agent: Column) -> Column:
    low = F.lower(agent)
    return (
        F.when(low.contains("edg/"), "Edge")
        .when(contains_any(low, "opr/", "opera"), "Opera")
        .when(low.contains("samsungbrowser"), "Samsung Internet")
        .when(low.contains("firefox"), "Firefox")
        .when(contains_any(low, "chrome", "crios"), "Chrome")
        .when(low.contains("safari"), "Safari")
    )


def operating_system(agent: Column) -> Column:
    low = F.lower(agent)
    return (
        F.when(low.contains("android"), "Android")
        .when(contains_any(low, "iphone", "ipad", "ios"), "iOS")
        .when(low.contains("windows"), "Windows")
        .when(contains_any(low, "mac os", "macos"), "macOS")
        .when(low.contains("linux"), "Linux")
    )


def ip_number(ip: Column) -> Column:
    """An IPv4 address as BIGINT; null for anything else."""
    parts = F.split(ip, r"\.")
    value = reduce(lambda a, k: a * 256 + F.get(parts, F.lit(k)).try_cast("bigint"), range(4), F.lit(0).cast("bigint"))
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def unsigned(text: Column, most: int) -> Column:
    """A number rounded to an integer and clamped to ``most``; null for no number or a negative one."""
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    whole = F.round(number)
    return F.when(whole >= 0, F.when(whole >= float(most), F.lit(most)).otherwise(whole.cast("bigint"))).cast("bigint")
