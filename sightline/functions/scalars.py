"""Functions of columns: matching, subnets, bins, timestamps, name-based ids. All stay inside the JVM."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units of a time bin.
UNITS = {"d": 86400, "day": 86400, "days": 86400, "h": 3600, "hour": 3600, "hours": 3600, "m": 60, "minute": 60, "minutes": 60, "s": 1, "second": 1, "seconds": 1}
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def matches(value: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the value; a dot also stands for a line's end, and null doesn't match."""
    return F.coalesce(value.cast("string").rlike("(?s)" + pattern), F.lit(False))


def like(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """LIKE without an escape character."""
    text, pattern = value.cast("string"), pattern.replace("\\", "\\\\")
    return text.ilike(pattern) if ignore_case else text.like(pattern)


def decoded(value: Column) -> Column:
    """Base64 text as text; null where it isn't base64."""
    return F.decode(F.try_to_binary(value, F.lit("base64")), "UTF-8")


def ipv4_number(value: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = [F.split_part(value, F.lit("."), F.lit(i)) for i in range(1, 5)]
    valid = F.translate(value, "0123456789", "") == "..."
    number = F.lit(0).cast("long")
    for p in parts:
        valid &= (F.length(p) < 3) & (F.length(p) > 0) | (F.length(p) == 3) & p.between("100", "255")
        number = number * 256 + p.try_cast("long")
    return F.when(valid, number)


def in_subnet(value: Column, network: str) -> Column:
    """Whether an address (or the first of a network) lies in a network. IPv4 becomes a range of numbers, IPv6 a range of their hexadecimal digits."""
    net = ipaddress.ip_network(network, strict=True)
    address = F.regexp_replace(value, "/.*$", "")
    if net.version == 4:
        return F.coalesce(ipv4_number(address).between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    return F.coalesce(ipv6_digits(address).between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"), F.lit(False))


def ipv6_digits(value: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits; null if it isn't one. Forms with a dotted tail aren't known."""
    halves = F.split(F.lower(value), "::")
    groups = lambda c: F.transform(F.filter(F.split(c, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    head, tail = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.try_element_at(halves, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0000"), (F.lit(8) - F.size(head) - F.size(tail)).cast("int"))
    digits = F.array_join(F.concat(head, zeros, tail), "")
    return F.when(value.rlike("(?i)^[0-9a-f:]+$") & value.contains(":") & (F.length(digits) == 32), digits)


def bin_number(value: Column, n: float) -> Column:
    """The multiple of n next to the value towards zero."""
    n = int(n)
    return (F.floor(F.abs(value) / n) * n * F.signum(value)).cast("long") if n != 1 else value.cast("long")


def bin_time(value: Column, n: int, unit: str) -> Column:
    """The begin of the bin of n units, counted from the epoch, as text."""
    width = int(n) * UNITS[unit]
    seconds = F.unix_timestamp(F.try_to_timestamp(value.cast("string")))
    return F.date_format(F.timestamp_seconds(F.floor(seconds / width) * width), TIMESTAMP)


def timefmt(value: Column, precision: int = 3) -> Column:
    """A timestamp in RFC 3339 form with digits of a second cut off."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * precision if precision else "") + "'Z'")


def uuid5(name: Column, namespace: str) -> Column:
    """A name-based UUID (version 5) of the name's UTF-8 bytes."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    hexdigit = F.lit("0123456789abcdef")
    variant = F.substring(F.lit("89ab"), F.expr("1").cast("int") + F.pmod(F.instr(hexdigit, F.substring(digest, 17, 1)) - 1, F.lit(4)), F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
