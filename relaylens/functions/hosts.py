"""Host, domain and URL helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions.text import any_of, bind, null_if_empty

URL_PATTERN = r"https?://[^\s'\"<>]+"
_RELAY_SUFFIX = rf"(?:^|\.)(?:{any_of(fv.REPUTABLE_RELAYS)})$"


def is_reputable(host: Column) -> Column:
    """Host is one of the well-known relay domains or below one.  False for a null host."""
    h = F.btrim(F.lower(host), F.lit("[]()."))
    return F.coalesce(h.rlike(_RELAY_SUFFIX), F.lit(False))


def address_of(raw: Column) -> Column:
    """The address inside ``<...>``, else the trimmed text."""
    inner = F.regexp_extract(raw, r"<([^<>]*)>", 1)
    return null_if_empty(F.trim(F.when(F.contains(raw, F.lit("<")), inner).otherwise(raw)))


def only_address(addresses: str) -> Column:
    """The (name, addr) pair of a header with exactly one address; null for several or none."""
    return F.when(F.size(addresses) == 1, F.try_element_at(addresses, F.lit(1)))


def domain_after_first_at(address: Column) -> Column:
    """Domain for alignment checks: text after the first ``@``, lower case, no brackets."""
    tail = F.substring(address, F.instr(address, "@") + 1, F.length(address))
    return F.when(F.contains(address, F.lit("@")), F.btrim(F.lower(tail), F.lit("[]().")))


def domain_after_last_at(address: Column) -> Column:
    """Domain for the rule checks: text after the last ``@``, lower case; empty without one."""
    return F.when(
        F.contains(address, F.lit("@")), F.lower(F.substring_index(address, "@", -1))
    ).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user info and port; null when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_extract(
        F.substring_index(authority, "@", -1), r"^(?:\[([^\]]*)\]|([^:\[\]]*))", 0
    )
    return null_if_empty(F.lower(F.btrim(host, F.lit("[]"))))


def registered_domain(host: Column, suffixes: list[str] | None = None) -> Column:
    """Registered domain of a host (one label below the longest known public suffix).

    ``suffixes`` is a public suffix list with its wildcards (``*.ck``) and exceptions (``!www.ck``);
    the built-in one is a snapshot.  Where no rule fits, the last label is the suffix, and below
    a country code also the usual second labels (``com.co``).  An address stays as it is, and a
    name under a special-use label, which is no public domain, keeps its last label.

    Suffix look-ups are hash-set tests inside the plan (``IN``), not a join.
    """
    known = suffixes or fv.PUBLIC_SUFFIXES
    plain = [s for s in known if s[0] not in "*!"]
    wild = [s[2:] for s in known if s.startswith("*.")]
    but = [s[1:] for s in known if s.startswith("!")]

    def last(h: Column, n: int) -> Column:
        return F.substring_index(h, ".", -n)

    def below(h: Column, names: list[str], more: int, out: Column) -> Column:
        """``more`` labels below the longest of ``names`` that ends the host."""
        for n in sorted({s.count(".") + 1 for s in names}):
            level = [s for s in names if s.count(".") + 1 == n]
            out = F.when(last(h, n).isin(level), last(h, n + more)).otherwise(out)
        return out

    def cut(h: Column) -> Column:
        top = last(h, 1)
        second = F.substring_index(last(h, 2), ".", 1)
        out = below(h, [s for s in plain if "." not in s], 1, F.when(
            top.isin(fv.SPECIAL_USE_LABELS), top).otherwise(last(h, 2)))
        if suffixes is None:
            out = F.when((F.length(top) == 2) & second.isin(fv.SECOND_LEVEL_LABELS), last(h, 3)).otherwise(out)
        out = below(h, but, 0, below(h, wild, 2, below(h, [s for s in plain if "." in s], 1, out)))
        address = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.contains(h, F.lit(":"))
        return F.when(address, h).otherwise(out)

    return bind(F.btrim(F.coalesce(host, F.lit("")), F.lit(".")), cut)
