"""Position of a key among sorted splitters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaylens.functions.text import bind


def range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters up to ``key``, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    # The key is bound, or every step would work out its whole derivation again.
    return bind(key, lambda k: _position(k, splitters))


def _position(key: Column, splitters: list) -> Column:
    bounds = F.lit(splitters)
    # Halving steps over one number, as this runs once a step for every row; past the end no splitter is met.
    steps = F.lit([1 << n for n in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))
