"""IP address predicates and keys as native expressions.

The network lists are plain CIDR text; their numeric bounds are worked out once on the driver
when the module loads and end up as literals in the plan.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions.text import bind, constant

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DOTTED = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
IPV4_PATTERN = rf"^{_DOTTED}$"
_H = "[0-9A-Fa-f]{1,4}"


def _ipv6_pattern() -> str:
    """Eight hextets, or fewer with one ``::`` standing for at least one of them."""
    forms = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{1,7}}:", rf":(?::{_H}){{1,7}}", "::"]
    forms += [rf"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)]
    return "^(?:" + "|".join(forms) + ")$"


IPV6_PATTERN = _ipv6_pattern()


def _hextets_for_tail(c: Column) -> Column:
    """Write a dotted-quad tail (``::ffff:1.2.3.4``) as two hextets; other text is unchanged."""

    def rewritten(number: Column) -> Column:
        tail = F.format_string(
            "%s:%s",
            F.lower(F.hex(F.shiftright(number, 16))),
            F.lower(F.hex(number.bitwiseAND(F.lit(65535)))),
        )
        return F.concat(F.regexp_replace(c, rf"{_DOTTED}$", ""), tail)

    quad = F.regexp_extract(c, rf":({_DOTTED})$", 1)
    return F.when(c.rlike(rf":{_DOTTED}$"), bind(ipv4_number(quad), rewritten)).otherwise(c)


def is_ipv4(c: Column) -> Column:
    return c.rlike(IPV4_PATTERN)


def is_ipv6(c: Column) -> Column:
    return F.contains(c, F.lit(":")) & _hextets_for_tail(c).rlike(IPV6_PATTERN)


def valid_ip(c: Column) -> Column:
    """The address without brackets and blanks, or null when it is not an address."""
    return bind(
        F.btrim(c, F.lit("[]() \t\r\n")), lambda s: F.when(is_ipv4(s) | is_ipv6(s), s)
    )


def ipv4_number(c: Column) -> Column:
    """Dotted quad to a number.  Null for anything else."""

    def weighted(p: Column) -> Column:
        part = [F.try_element_at(p, F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
        return part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]

    return bind(F.split(c, r"\."), weighted)


def _packed(x: Column) -> Column:
    padded = F.regexp_replace(x, "([0-9a-f]+)", "000$1")
    return F.regexp_replace(F.regexp_replace(padded, "[0-9a-f]*([0-9a-f]{4})", "$1"), ":", "")


def ipv6_hex(c: Column) -> Column:
    """Valid IPv6 text to its 32 hex digits, so that networks become string ranges."""

    def joined(halves: Column) -> Column:
        gap = F.lit(32) - F.length(halves[0]) - F.length(halves[1])
        return F.concat(halves[0], F.repeat(F.lit("0"), gap), halves[1])

    def halves(s: Column) -> Column:
        gapped = F.contains(s, F.lit("::"))
        right = F.when(gapped, F.substring_index(s, "::", -1)).otherwise(F.lit(""))
        return F.array(_packed(F.substring_index(s, "::", 1)), _packed(right))

    return bind(bind(F.lower(_hextets_for_tail(c)), halves), joined)


def _bounds(networks: list[str], form) -> Column:
    nets = [ipaddress.ip_network(n) for n in networks]
    return constant([(("lo", form(int(n[0]))), ("hi", form(int(n[-1])))) for n in nets])


def _v4_in(number: Column, networks: list[str]) -> Column:
    bounds = _bounds(networks, int).cast("array<struct<lo:bigint,hi:bigint>>")
    return F.exists(bounds, lambda n: number.between(n["lo"], n["hi"]))


def _v6_in(hex32: Column, networks: list[str]) -> Column:
    bounds = _bounds(networks, lambda k: f"{k:032x}")
    return F.exists(bounds, lambda n: hex32.between(n["lo"], n["hi"]))


def _v4_private(number: Column) -> Column:
    return _v4_in(number, fv.PRIVATE_V4) & ~_v4_in(number, fv.PRIVATE_V4_EXCEPT)


def _v6_private(hex32: Column) -> Column:
    return _v6_in(hex32, fv.PRIVATE_V6) & ~_v6_in(hex32, fv.PRIVATE_V6_EXCEPT)


def v4_key(c: Column) -> Column:
    """Number of an IPv4 address, null for other text."""
    return F.when(is_ipv4(c), ipv4_number(c))


def v6_key(c: Column) -> Column:
    """Hex digits of an IPv6 address, null for other text."""
    return F.when(is_ipv6(c), ipv6_hex(c))


def private_by_key(number: Column, hex32: Column) -> Column:
    """Not usable as a public source: private, loopback, link-local, reserved, unspecified or
    not an address at all.  Takes the keys, so that a caller works them out only once."""
    return (
        F.when(number.isNotNull(), _v4_private(number))
        .when(hex32.isNotNull(), _v6_private(hex32) | _v6_in(hex32, fv.RESERVED_V6))
        .otherwise(F.lit(True))
    )


def is_private_ip(c: Column) -> Column:
    return bind(
        F.struct(v4_key(c).alias("n"), v6_key(c).alias("h")),
        lambda k: private_by_key(k["n"], k["h"]),
    )


def is_internal_ip(c: Column) -> Column:
    """The narrower look-up gate: private, loopback or link-local.  IPv4-mapped addresses count
    by the address they carry.  Null when the text is not an address."""

    return bind(F.struct(v4_key(c).alias("n"), v6_key(c).alias("h")), lambda k: internal_by_key(k["n"], k["h"]))


def internal_by_key(number: Column, hex32: Column) -> Column:
    """The same from the keys, for a caller that has them."""
    mapped = F.conv(F.substring(hex32, 25, 8), 16, 10).cast("long")
    return (
        F.when(number.isNotNull(), _v4_private(number))
        .when(hex32.startswith("0" * 20 + "ffff"), bind(mapped, _v4_private))
        .when(hex32.isNotNull(), _v6_private(hex32))
    )
