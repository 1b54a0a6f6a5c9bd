"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stay in capitals although they have vowels.
ACRONYMS = ("ATM", "NEFT", "UPI", "EMI")
#: Words of capitals of this length at most, without vowels, are read by letter.
SHORT = 5


def let(value: Column, then) -> Column:
    """``then(value)``, in which the value is computed once however often it stands
    there: a column that is used in several places is a tree that grows with each."""
    return F.get(F.transform(F.array(value), then), 0)


def made_once(**columns: Column) -> Column:
    """Columns that what uses them does not compute again: the rows of a generator,
    below which no filter is moved and into which no later expression is folded."""
    return F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))


def strip(c: Column) -> Column:
    """Without white space around it, also that beyond ASCII."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def trim_upper(c: Column) -> Column:
    return F.upper(strip(c))


def title_case(c: Column) -> Column:
    """All-capital bank descriptions in title case; acronyms and anything that has
    a lower-case letter or no letter stay."""

    def word(w: Column) -> Column:
        letters = F.regexp_replace(w, r"[^\p{L}]", "")
        acronym = w.isin(*ACRONYMS) | (F.length(letters).between(1, SHORT) & ~letters.rlike("[AEIOU]"))
        low = F.lower(w)
        return F.when(acronym, w).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1_000_000)))

    capitals = c.rlike(r"\p{L}") & ~c.rlike(r"\p{Ll}")
    return F.when(capitals, F.array_join(F.transform(F.split(c, " "), word), " ")).otherwise(c)
