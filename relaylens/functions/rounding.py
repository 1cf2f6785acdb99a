"""Rounding that agrees with correctly rounded decimal rounding of binary doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaylens.functions.text import bind


def round_half_even_int(x: Column) -> Column:
    return F.rint(x).cast("int")


def round_exact(x: Column, digits: int = 2) -> Column:
    """Round the exact binary value half-to-even at ``digits`` decimals, for 0 <= x < 1e9.

    round()/bround() look at the shortest decimal text of a double, so 2.675, which is a little
    below the tie, goes up.  Here x * 10**digits is split into the rounded product and its exact
    error (Dekker's product), and the error decides at a tie.
    """
    scale = float(10**digits)

    def parts(v: Column) -> Column:
        split = v * 134217729.0
        high = split - (split - v)
        product = v * scale
        return F.struct(
            product.alias("product"),
            F.floor(product).alias("whole"),
            ((high * scale - product) + (v - high) * scale).alias("error"),
        )

    def decided(p: Column) -> Column:
        over = p["product"] - p["whole"] - 0.5
        at_tie = (p["error"] > 0) | ((p["error"] == 0) & (p["whole"] % 2 == 1))
        up = (over > 0) | ((over == 0) & at_tie)
        return (p["whole"] + F.when(up, 1).otherwise(0)) / scale

    return bind(bind(x, parts), decided)
