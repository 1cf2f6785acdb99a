"""E-mail dates (RFC 2822 with the usual deviations) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relaylens import fixed_values as fv
from relaylens.functions.text import bind, constant

_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?" \
         "|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DATE = (
    r"(?i)^\s*(?:\S*,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
    rf"(\d{{1,2}}),?[\s\-]+({_MONTH})[\s\-]+(\d{{2,4}}),?\s+"
    r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?,?\s*(\S*).*$"
)


_DAY = r"(?i)^\s*(?:\S*,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
_CLOCK = r"\d{1,2}[:.]\d{1,2}(?:[:.]\d{1,2})?"
# Other orders of the same pieces, each with the replacement that puts them into _DATE's order.
_ORDERS = [
    (rf"{_DAY}({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})\s+({_CLOCK})(.*)$", "$2 $1 $3 $4$5"),
    (rf"{_DAY}({_MONTH})\s+(\d{{1,2}}),?\s+({_CLOCK})\s+(\d{{4}})(.*)$", "$2 $1 $4 $3$5"),
    (rf"{_DAY}(\d{{1,2}})\s+({_MONTH})\s+({_CLOCK})\s+(\d{{4}})(.*)$", "$1 $2 $4 $3$5"),
]


def _usual_order(c: Column) -> Column:
    """Month first, year last and dotted times rewritten; other text is unchanged."""
    out = c
    for pattern, order in _ORDERS:
        out = F.regexp_replace(out, pattern, order)
    full = F.regexp_replace(out, r"(\s\d{1,2})\.(\d{1,2})\.(\d{1,2})(\s|$)", "$1:$2:$3$4")
    return F.regexp_replace(full, r"(\s\d{1,2})\.(\d{1,2})(\s|$)", "$1:$2$3")


def date_parts(c: Column) -> Column:
    """[day, month, year, hour, minute, second, zone], or a one-item array for other text.

    date_value() reads the pieces.
    """
    usual = F.when(c.rlike(_DATE), c).otherwise(_usual_order(c))
    return F.split(F.regexp_replace(usual, _DATE, "$1|$2|$3|$4|$5|$6|$7"), r"\|", 7)


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _local_text(parts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss as written, without the zone."""
    months = "".join(fv.MONTHS)
    month = F.floor((F.instr(F.lit(months), F.lower(F.substring(parts[1], 1, 3))) + 2) / 3)

    def century(y: Column) -> Column:
        return F.when(y > 99, y).when(y > 68, y + 1900).otherwise(y + 2000)

    year = bind(parts[2].try_cast("int"), century)
    second = F.when(parts[5] == "", F.lit("00")).otherwise(_two(parts[5]))
    return F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), _two(month.cast("string")), F.lit("-"),
        _two(parts[0]), F.lit("T"), _two(parts[3]), F.lit(":"), _two(parts[4]), F.lit(":"),
        second,
    )


def _zone_text(zone: Column) -> Column:
    """+hhmm for a known zone, null for an unknown one and for -0000."""
    named = constant(fv.ZONE_OFFSETS)
    sign = F.when(zone.startswith("-"), F.lit("-")).otherwise(F.lit("+"))
    return (
        F.when(zone.rlike(r"^[A-Z]+$"), F.try_element_at(named, zone))
        .when(zone.rlike(r"^-0{1,4}$"), F.lit(None))
        .when(
            zone.rlike(r"^[+\-]?\d{1,4}$"),
            F.concat(sign, F.lpad(F.regexp_replace(zone, r"^[+\-]", ""), 4, "0")),
        )
    )


def _iso_zone(offset: Column, minutes: Column) -> Column:
    return F.concat(
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        _two(F.floor(F.abs(minutes) / 60).cast("string")), F.lit(":"),
        _two((F.abs(minutes) % 60).cast("string")),
    )


def date_value(parts: Column) -> Column:
    """struct<epoch, offset, iso> from date_parts(); null when it is not a real date.

    ``offset`` is +hhmm text and null for a date without a known zone (also ``-0000``); then
    ``epoch`` counts local seconds and cannot be compared with a zoned one.
    """

    def pieces(p: Column) -> Column:
        return F.struct(_local_text(p).alias("local"), _zone_text(F.upper(p[6])).alias("offset"))

    def measured(x: Column) -> Column:
        # Two-digit minutes over 59 carry into the hours.
        minutes = F.substring(x["offset"], 2, 2).cast("long") * 60 \
            + F.substring(x["offset"], 4, 2).cast("long")
        return F.struct(
            x["local"].alias("local"), x["offset"].alias("offset"),
            F.concat(x["local"], F.lit("Z")).try_cast("timestamp").alias("stamp"),
            F.when(x["offset"].startswith("-"), -minutes).otherwise(minutes).alias("minutes"),
        )

    def value(x: Column) -> Column:
        return F.when(
            x["stamp"].isNotNull() & (F.coalesce(F.abs(x["minutes"]), F.lit(0)) < 1440),
            F.struct(
                (F.unix_seconds(x["stamp"]) - F.coalesce(x["minutes"], F.lit(0)) * 60)
                .alias("epoch"),
                x["offset"].alias("offset"),
                F.concat(
                    x["local"], F.coalesce(_iso_zone(x["offset"], x["minutes"]), F.lit(""))
                ).alias("iso"),
            ),
        )

    dated = bind(bind(bind(parts, pieces), measured), value)
    return F.when(F.size(parts) == 7, dated)
