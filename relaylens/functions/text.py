"""String helpers.  All are Column -> Column and stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Characters with a meaning in Java regular expressions.
_META = re.compile(r"([\\.\[\]{}()*+\-?^$|])")


def quoted(literal: str) -> str:
    """Escape a literal for use inside a regular expression."""
    return _META.sub(r"\\\1", literal)


def any_of(literals: list[str]) -> str:
    """One alternation that matches any of the literals."""
    return "|".join(quoted(x) for x in literals)


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null when there is no match or the group is empty."""
    return null_if_empty(F.regexp_extract(c, pattern, group))


def all_groups(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one space."""
    return F.regexp_replace(c, r"\s+", " ")


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def contains_any(c: Column, literals: list[str]) -> Column:
    """Plain searches, one a literal: an alternation is tried literal by literal at every character."""
    return reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in literals])


def dense(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def first_of(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def last_of(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body mentions it.

    Column expressions are trees: reusing a Python variable copies the whole subtree, which
    grows exponentially when helpers nest.  A lambda over a one-item array binds it instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(rows: DataFrame, column: str, *keep: str, position: str | None = None,
           item: str = "item") -> DataFrame:
    """One row per array item, without empty arrays.

    explode() makes the optimizer add a filter on the array and push it down, which copies the
    array's whole derivation into filters at every level.  The outer form does not, and the empty
    rows it adds are dropped by a test on its own output.
    """
    if position is None:
        out = rows.select(*keep, F.explode_outer(column).alias(item))
        return out.where(F.col(item).isNotNull())
    out = rows.select(*keep, F.posexplode_outer(column).alias(position, item))
    return out.where(F.col(position).isNotNull())


def constant(value) -> Column:
    """Nested lists, dicts (maps), tuples of (name, value) pairs (structs) and scalars as one
    literal expression, built in a single call."""
    return F.expr(_literal(value))


def _literal(value) -> str:
    if isinstance(value, list):
        return f"array({', '.join(_literal(v) for v in value)})"
    if isinstance(value, dict):
        return f"map({', '.join(f'{_literal(k)}, {_literal(v)}' for k, v in value.items())})"
    if isinstance(value, tuple):
        fields = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in value)
        return f"named_struct({fields})"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{value}L" if isinstance(value, int) and abs(value) > 2**31 - 1 else repr(value)
