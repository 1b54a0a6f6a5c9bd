"""Money is a long of minor units; these are the expressions that read and show it."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Currencies whose number of decimal places is not two.
DECIMAL_PLACES = {"JPY": 0, "KRW": 0, "VND": 0, "CLP": 0, "KWD": 3, "BHD": 3, "OMR": 3, "JOD": 3, "TND": 3}


@functools.cache
def other_digits() -> list[str]:
    """The decimal digits that are not ASCII."""
    return [chr(k) for k in range(128, 1 << 16) if chr(k).isdecimal()]


def plain(c: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    every = other_digits()
    to_ascii = lambda k: F.translate(k, "".join(every), "".join(str(int(x)) for x in every))
    return let(c, lambda k: F.when(k.rlike(r"[^\x00-\x7F]"), to_ascii(k)).otherwise(k))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def parse(raw: Column, places: int = 2) -> Column:
    """Text to minor units, null where there is no amount.

    Parentheses or a leading minus make it negative. The last of dot and comma is
    the decimal separator, unless exactly three digits follow it: then it groups
    thousands. Fractions are padded or cut to ``places``; what does not fit a long
    is null.
    """

    def size(kept: Column) -> Column:
        """The magnitude of digits, dots and commas; null where there are none."""
        parts = F.when(kept.rlike("[.,]"), F.struct(F.regexp_extract(kept, r"^(.*)[.,][^.,]*$", 1).alias("whole"), F.regexp_extract(kept, r"[.,]([^.,]*)$", 1).alias("fraction")))
        return let(F.coalesce(parts, F.struct(kept.alias("whole"), F.lit("").alias("fraction"))), lambda p: F.when(kept != "", minor(digits(p["whole"]), p["fraction"])))

    def minor(whole: Column, fraction: Column) -> Column:
        grouped = F.length(fraction) == 3
        units = F.when(grouped, F.concat(whole, fraction)).otherwise(F.when(whole == "", "0").otherwise(whole))
        cents = F.rpad(F.when(grouped, F.lit("")).otherwise(fraction), places, "0") if places else F.lit("")
        return F.concat(units, cents).try_cast("bigint")

    def signed_size(text: Column) -> Column:
        wrapped = text.startswith("(") & text.endswith(")")
        bare = F.when(wrapped & (F.length(text) > 1), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
        return let(bare, lambda b: let(let(F.regexp_replace(b, r"[^\p{Nd}.,]", ""), lambda k: size(plain(k))), lambda n: F.when(wrapped | b.startswith("-"), -n).otherwise(n)))

    return let(strip(raw), signed_size)


def decimal_places(currency: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in DECIMAL_PLACES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, currency), F.lit(2))


def sanitize_input(raw: Column) -> Column:
    """Digits and the first dot of what was typed."""
    kept = F.regexp_replace(raw, r"[^\p{Nd}.]", "")
    return F.concat(F.regexp_extract(kept, r"^([^.]*\.?)", 1), F.replace(F.regexp_replace(kept, r"^[^.]*\.?", ""), F.lit("."), F.lit("")))


def parse_magnitude(sanitized: Column, places: int = 2) -> Column:
    """As ``parse``, but a text without digits is no amount."""
    return F.when(sanitized.rlike(r"\p{Nd}"), parse(sanitized, places))


def format_for_editing(minor: Column, places: int = 2) -> Column:
    if not places:
        return minor.cast("string")
    unit = F.lit(10**places).cast("long")
    return F.concat(F.call_function("div", minor, unit).cast("string"), F.lit("."), F.lpad((minor % unit).cast("string"), places, "0"))


def display(minor: Column, currency: Column) -> Column:
    """Amount with grouping and currency code; presentation only."""
    return F.concat(currency, F.lit(" "), F.format_number(minor / 100, 2))


def signed(magnitude: Column, kind: Column) -> Column:
    """A form's amount: income is positive, expense negative."""
    return F.when(kind == "INCOME", F.abs(magnitude)).otherwise(-F.abs(magnitude))
