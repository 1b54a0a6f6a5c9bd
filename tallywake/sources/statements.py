"""Bank statements as CSV: bytes to text to cells to a mapping to rows.

Only cutting a text into records is Python, as statements are ragged, quoted over
lines and have lines before their header. All else is expressions: a file's sample of
at most ``SAMPLE`` records is one row of arrays, a file being 5 MiB at most, and what its
columns mean is inferred there, and never guessed where the rows do not say. Rows are
then mapped one by one, wherever they lie.
"""

from __future__ import annotations

import csv
import io
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money
from ..functions.text import let, made_once, strip
from ..lineage import cut

#: Fixed values.
MOST_BYTES, SNIFFED, SAMPLE = 5 * 1024 * 1024, 8192, 50
#: Shares of cells or rows that decide, and pairs of rows that a balance is seen in.
ENOUGH, BALANCED, PAIRS, CLOSE = 0.8, 0.75, 3, 0.85
#: Why a row fails.
FEW_COLUMNS, NOT_CONFIRMED = "expected at least {} columns, found {}", 'date format "{}" is not confirmed'
BAD_DATE, BAD_AMOUNT = 'unparseable date "{}"', "unparseable or ambiguous amount"
DESCRIPTION_HINTS = ("narration", "particulars", "description", "details")
DEBIT_HINTS, CREDIT_HINTS = ("debit", "withdrawal", "dr"), ("credit", "deposit", "cr")
MONTH_NAMES = tuple("jan feb mar apr may jun jul aug sep oct nov dec".split())
AMBIGUOUS = "AMBIGUOUS"
SIGNS = ("NEGATIVE_IS_DEBIT", "POSITIVE_IS_DEBIT", "SIGN_COLUMN")
ISO, NAMED, NUMERIC = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$", r"^(\d{1,2})([/.\-])(\d{1,2})[/.\-](\d{4})$"


# Files, texts, records


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length and content. Content is null for files that are too large, and
    length as well for paths where there is nothing (ReadFailed). Files of no bytes
    are left out."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], "path string, length long, content binary")
    for path in paths:
        try:
            files = spark.read.format("binaryFile").load(path)
        except AnalysisException:
            out = out.unionByName(spark.createDataFrame([(path, None, None)], out.schema))
            continue
        small = files.where(F.col("length") <= MOST_BYTES).select("path", "length", "content")
        large = files.where(F.col("length") > MOST_BYTES).select("path", "length", F.lit(None).cast("binary").alias("content"))
        out = out.unionByName(small).unionByName(large)
    return out


def decoded(files: DataFrame) -> DataFrame:
    """path, outcome and text of ``files(path, content[, length])``: Success, or what is
    wrong: ReadFailed, TooLarge, NotText, EncodingUnclear, without a text. A null
    content of null length was not read."""
    length = F.col("length") if "length" in files.columns else F.lit(0)
    text, content = F.col("content").cast("string"), F.col("content")
    outcome = (
        F.when(content.isNull(), F.when(length.isNull(), "ReadFailed").otherwise("TooLarge"))
        .when(F.octet_length(content) > MOST_BYTES, "TooLarge")
        .when(F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\0")), "NotText")
        .when(~F.is_valid_utf8(text) | F.contains(text, F.lit("�")), "EncodingUnclear")
        .otherwise("Success")
    )
    return files.select("path", outcome.alias("outcome"), F.when(outcome == "Success", text).alias("text"))


def tokenize(text: str) -> list[list[str]]:
    """Records of RFC 4180 text. A blank line is a record with one empty cell; a
    quote that is never closed makes one cell of the rest, however long."""
    csv.field_size_limit(max(csv.field_size_limit(), 4 * MOST_BYTES))
    rows = list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), strict=False))
    return [r or [""] for r in rows]


def cells_of(files: DataFrame) -> DataFrame:
    """path, outcome, row_index, cells: every record of ``files``. A file that is no text
    has one row, with its outcome and no cells."""

    def task(batches):
        import pandas as pd

        for b in batches:
            for p, o, t in zip(b["path"], b["outcome"], b["text"]):
                rows = [(p, o, None, None)] if t is None else [(p, o, i, r) for i, r in enumerate(tokenize(t))]
                yield pd.DataFrame(rows, columns=["path", "outcome", "row_index", "cells"], dtype=object)

    return decoded(files).mapInPandas(task, "path string, outcome string, row_index int, cells array<string>")


def cells_once(files: DataFrame) -> DataFrame:
    """``cells_of``, cut once and kept in the shared folder, as inference looks at the
    first records and mapping at all. Dealt out by a number of partitions, as few
    bytes here are much work."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(cells_of(files.repartition(n, "path")))


# Cells


def date_parts(cell: Column) -> Column:
    """What a cell is as a date: like (its shape, with day and month in range; the
    calendar is not asked), iso, named, and the numbers a and b around the separator of
    a numeric date."""

    def parts(t: Column) -> Column:
        # Digits, where the pattern fits; a cast that fails costs more than all else here.
        part = lambda p, k: F.when(t.rlike(p), F.regexp_extract(t, p, k)).cast("int")
        iso = t.rlike(ISO) & part(ISO, 2).between(1, 12) & part(ISO, 3).between(1, 31)
        month = F.lower(F.regexp_extract(t, NAMED, 2)).isin(*MONTH_NAMES)

        def whole(n: Column) -> Column:
            numeric = (n["a"].between(1, 31) & n["b"].between(1, 12)) | (n["a"].between(1, 12) & n["b"].between(1, 31))
            like = F.when(t.rlike(ISO), iso).when(t.rlike(NAMED), part(NAMED, 1).between(1, 31) & month).otherwise(F.coalesce(numeric, F.lit(False)))
            return F.struct(like.alias("like"), iso.alias("iso"), t.rlike(NAMED).alias("named"), n["a"].alias("a"), n["b"].alias("b"), F.regexp_extract(t, NUMERIC, 2).alias("separator"))

        return let(F.struct(part(NUMERIC, 1).alias("a"), part(NUMERIC, 3).alias("b")), whole)

    return let(strip(cell), parts)


def date_like(cell: Column) -> Column:
    return date_parts(cell)["like"]


def money_like(cell: Column) -> Column:
    return ~cell.rlike(r"\p{L}") & money.parse(cell).isNotNull()


def facts(cell: Column) -> Column:
    """All that inference asks of a cell."""
    whole = lambda t, m: F.struct(date_parts(t).alias("d"), m.alias("m"), (~cell.rlike(r"\p{L}") & m.isNotNull()).alias("shaped"), (t != "").alias("filled"), F.length(t).alias("length"))
    return let(strip(cell), lambda t: let(money.parse(cell), lambda m: whole(t, m)))


def data_like(row: Column) -> Column:
    """Whether a row of facts has a date and, elsewhere, an amount."""
    first = F.array_position(F.transform(row, lambda c: c["d"]["like"]), True)
    return let(first, lambda f: (f > 0) & F.exists(F.transform(row, lambda c, i: c["shaped"] & (i + 1 != f)), lambda x: x))


# Mappings


@dataclass
class Mapping:
    """Which column is what, what is uncertain, and which columns are not used.

    Amounts are in one column, with a sign that is stated (``NEGATIVE_IS_DEBIT``,
    ``POSITIVE_IS_DEBIT`` or ``SIGN_COLUMN``, which alone has a ``sign_column``), or
    in a debit and a credit column; anything else is a ValueError.
    """

    header_row: int | None = None
    first_row: int = 0
    date_column: int = 0
    date_format: str = "yyyy-MM-dd"
    description_column: int = 0
    amount_column: int | None = None
    amount_sign: str | None = None
    sign_column: int | None = None
    debit_column: int | None = None
    credit_column: int | None = None
    uncertain: list[str] = field(default_factory=list)
    unmapped: list[int] = field(default_factory=list)

    def __post_init__(self):
        if (self.debit_column is None) != (self.credit_column is None):
            raise ValueError("debit and credit columns go together")
        if (self.amount_column is None) == (self.debit_column is None):
            raise ValueError("amounts are in one column or in a debit and a credit column")
        if self.amount_column is None and (self.amount_sign is not None or self.sign_column is not None):
            raise ValueError("only a single amount column has a sign")
        if self.amount_column is not None and self.amount_sign not in SIGNS:
            raise ValueError(f"the sign of an amount column is one of {SIGNS}")
        if (self.amount_sign == "SIGN_COLUMN") != (self.sign_column is not None):
            raise ValueError("a sign column goes with SIGN_COLUMN, and with nothing else")


NUMBERS = ("header_row", "first_row", "date_column", "description_column", "amount_column", "sign_column", "debit_column", "credit_column")
TEXTS = ("date_format", "amount_sign")


def stated(mapping: Mapping) -> dict[str, Column]:
    """A mapping as columns."""
    held = asdict(mapping)
    return {k: F.lit(held[k]).cast("int") for k in NUMBERS} | {k: F.lit(held[k]).cast("string") for k in TEXTS}


def count_of(rows: Column, test) -> Column:
    return F.size(F.filter(rows, test))


def at(items: Column, index) -> Column:
    """An element by its place from 0; null beyond the end."""
    return F.get(items, index)


def hinted(header: Column, column: Column, hints: tuple[str, ...]) -> Column:
    """Whether a header names a column so; false without one."""
    name = F.lower(at(header, column))
    return F.coalesce(F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(name, h)), F.lit(False))


def samples_of(cells: DataFrame) -> DataFrame:
    """A row for each text: path, width (that most records have; of equals the one seen
    first), first_row (the first of the first ``SAMPLE`` that holds data), header_row (the
    one above, if it is as wide and no data), header, and sample: the facts of at most
    ``SAMPLE`` records of that width from the first on."""
    rows = cells.where("cells is not null").withColumn("w", F.size("cells"))
    width = rows.groupBy("path", "w").agg(F.count("*").alias("n"), F.min("row_index").alias("seen"))
    width = width.groupBy("path").agg(F.max_by("w", F.struct("n", -F.col("seen"))).alias("width"))
    wide = rows.join(width, "path").where("w = width")
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    early = wide.where(F.col("row_index") < SAMPLE).repartition(n, "path").select("path", "row_index", "cells", F.transform("cells", facts).alias("facts"))
    early = cut(early.select("path", "row_index", "cells", data_like(F.col("facts")).alias("data")))
    first = early.where("data").groupBy("path").agg(F.min("row_index").alias("first_row"))
    above = early.where("not data").select("path", (F.col("row_index") + 1).alias("first_row"), F.col("cells").alias("header"))
    known = width.join(first, "path", "left").join(above, ["path", "first_row"], "left")
    known = known.withColumn("header_row", F.when(F.col("header").isNotNull(), F.col("first_row") - 1))
    # Files are small, and ranks stop at the sample.
    later = wide.select("path", "row_index", "cells").join(first, "path").where("row_index >= first_row")
    later = later.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("row_index"))).where(F.col("r") <= SAMPLE)
    each = later.repartition(n, "path").select("path", "r", F.transform("cells", facts).alias("facts"))
    sample = each.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "facts"))), lambda x: x["facts"]).alias("sample"))
    return known.join(sample, "path", "left")


def also(s: DataFrame, **columns: Column) -> DataFrame:
    """``s`` with further columns, computed once a row: what refers to them, above all
    within a lambda, would else hold their expressions and compute them at each element."""
    return s.select("*", made_once(**columns))


def with_columns(s: DataFrame) -> DataFrame:
    """Adds date_column, date_rate, and the columns of amounts (``moneys``) and of
    neither (``texts``)."""
    rows, n = F.col("sample"), F.size("sample")
    columns = F.sequence(F.lit(0), F.col("width") - 1)
    tally = lambda c: F.struct(
        c.alias("c"), count_of(rows, lambda r: at(r, c)["d"]["like"]).alias("dates"), count_of(rows, lambda r: at(r, c)["filled"]).alias("filled"), count_of(rows, lambda r: at(r, c)["shaped"]).alias("shaped"),
        F.aggregate(rows, F.lit(0), lambda x, r: x + at(r, c)["length"]).alias("length"),
    )
    s = also(s, tally=F.transform(columns, tally))
    s = also(s, most=F.array_max(F.transform("tally", lambda t: t["dates"])))
    s = also(s, best=F.filter("tally", lambda t: t["dates"] == F.col("most")))
    s = also(s, date_column=at(F.col("best"), 0)["c"], date_rate=at(F.col("best"), 0)["dates"] / n)
    is_money = lambda t: (t["c"] != F.col("date_column")) & (t["filled"] > 0) & (t["shaped"] / F.when(t["filled"] > 0, t["filled"]) >= ENOUGH)
    s = also(s, moneys=F.transform(F.filter("tally", is_money), lambda t: t["c"]))
    return also(s, texts=F.filter("tally", lambda t: (t["c"] != F.col("date_column")) & ~F.array_contains("moneys", t["c"])))


def with_balance(s: DataFrame) -> DataFrame:
    """Adds ``balance``: (balance, amount, sign) if exactly one ordered pair of amount
    columns behaves as a running balance and its amounts, and the amount columns that
    are left without it (``left``)."""
    rows = F.col("sample")
    steps = F.when(F.size(rows) > 1, F.sequence(F.lit(1), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))

    def seen(b: Column, a: Column) -> Column:
        each = F.transform(steps, lambda i: F.struct(F.try_subtract(at(at(rows, i), b)["m"], at(at(rows, i - 1), b)["m"]).alias("step"), at(at(rows, i), a)["m"].alias("v")))
        return F.filter(each, lambda x: x["step"].isNotNull() & x["v"].isNotNull())

    pairs = F.flatten(F.transform("moneys", lambda b: F.transform(F.filter("moneys", lambda a: a != b), lambda a: F.struct(b.alias("balance"), a.alias("amount"), seen(b, a).alias("seen")))))
    s = also(s, pairs=pairs)
    share = lambda p, test: count_of(p["seen"], test) / F.size(p["seen"])
    plus = lambda p: share(p, lambda x: x["step"] == x["v"]) >= BALANCED
    minus = lambda p: share(p, lambda x: (x["step"] == -x["v"]) & (x["step"] != x["v"])) >= BALANCED
    sign = lambda p: F.when(F.size(p["seen"]) >= PAIRS, F.when(plus(p), "NEGATIVE_IS_DEBIT").when(minus(p), "POSITIVE_IS_DEBIT"))
    s = also(s, signs=F.filter(F.transform("pairs", lambda p: F.struct(p["balance"].alias("balance"), p["amount"].alias("amount"), sign(p).alias("sign"))), lambda p: p["sign"].isNotNull()))
    s = also(s, balance=F.when(F.size("signs") == 1, at(F.col("signs"), 0)))
    return also(s, left=F.filter("moneys", lambda c: ~c.eqNullSafe(F.col("balance.balance"))))


def with_amounts(s: DataFrame) -> DataFrame:
    """Adds ``amounts``: one column with a sign, or debit and credit, and whether the
    columns or the sign are uncertain; null without any amount."""
    rows, header, left = F.col("sample"), F.col("header"), F.col("left")
    a, b = at(left, 0), at(left, 1)
    there = lambda r, c: at(r, c)["m"].isNotNull()
    exclusive = count_of(rows, lambda r: there(r, a) != there(r, b)) / F.size(rows) >= ENOUGH
    debit, credit = ({k: hinted(header, c, h) for k, c in (("a", a), ("b", b))} for h in (DEBIT_HINTS, CREDIT_HINTS))
    null, no, yes = F.lit(None), F.lit(False), F.lit(True)

    def out(amount=null, sign=null, debit=null, credit=null, columns=no, signs=no) -> Column:
        return F.struct(amount.cast("int").alias("amount_column"), sign.cast("string").alias("amount_sign"), debit.cast("int").alias("debit_column"), credit.cast("int").alias("credit_column"), columns.alias("columns"), signs.alias("signs"))

    negative = F.lit("NEGATIVE_IS_DEBIT")
    pair = F.when(debit["a"] & credit["b"], out(debit=a, credit=b)).when(debit["b"] & credit["a"], out(debit=b, credit=a)).otherwise(out(debit=a, credit=b, columns=yes))
    unclear = out(a, negative, columns=yes, signs=yes)
    single = out(a, F.coalesce(F.col("balance.sign"), negative), signs=F.col("balance").isNull())
    amounts = F.when(F.size(left) == 1, single).when((F.size(left) == 2) & exclusive, pair).when(F.size(left) > 1, unclear)
    return also(s, amounts=amounts)


def with_description(s: DataFrame) -> DataFrame:
    """Adds ``description``: the column and whether it is uncertain; null without any."""
    named = F.col("named")
    # By length, and of equals the first.
    ranked = F.array_sort(F.transform("texts", lambda t: F.struct((-t["length"]).alias("less"), t["c"].alias("c"))))
    s = also(s, named=F.filter("texts", lambda t: hinted(F.col("header"), t["c"], DESCRIPTION_HINTS)), ranked=ranked)
    best, second = at(F.col("ranked"), 0), at(F.col("ranked"), 1)
    close = (best["less"] < 0) & (second["less"] / F.when(best["less"] < 0, best["less"]) > CLOSE)
    of = lambda c, uncertain: F.struct(c.alias("c"), uncertain.alias("uncertain"))
    found = F.when(F.size("texts") == 1, of(at(F.col("texts"), 0)["c"], F.lit(False))).when(F.size(named) == 1, of(at(named, 0)["c"], F.lit(False)))
    return also(s, description=found.when(F.size("texts") > 1, of(best["c"], F.coalesce(close, F.lit(False)))))


def with_date_format(s: DataFrame) -> DataFrame:
    """Adds date_format: a pattern if all cells of the date column agree on one, else
    AMBIGUOUS."""
    s = also(s, dates=F.transform("sample", lambda r: at(r, F.col("date_column"))["d"]))
    s = also(s, numeric=F.filter("dates", lambda d: d["a"].isNotNull()))
    dates, numeric = F.col("dates"), F.col("numeric")
    some, mark = F.size(numeric) > 0, at(numeric, 0)["separator"]
    day_first = some & F.forall(numeric, lambda d: d["a"].between(1, 31) & d["b"].between(1, 12))
    month_first = some & F.forall(numeric, lambda d: d["a"].between(1, 12) & d["b"].between(1, 31))
    pattern = lambda x, y: F.concat(F.lit(x), mark, F.lit(y), mark, F.lit("yyyy"))
    chosen = F.when(F.forall(dates, lambda d: d["iso"]), "yyyy-MM-dd").when(F.forall(dates, lambda d: d["named"]), "dd-MMM-yyyy")
    chosen = chosen.when(day_first & ~month_first, pattern("dd", "MM")).when(month_first & ~day_first, pattern("MM", "dd")).otherwise(AMBIGUOUS)
    return also(s, date_format=chosen)


def inferred(cells: DataFrame) -> DataFrame:
    """What was inferred of each text among ``cells_of``: path, found, width, header_row,
    first_row, date_rate, the columns and signs of ``Mapping``, uncertain and unmapped.
    Fewer than three columns, no data, no amount or no description: not found."""
    s = with_date_format(with_description(with_amounts(with_balance(with_columns(cut(samples_of(cells)))))))
    s = also(s, found=F.coalesce((F.col("width") >= 3) & F.col("first_row").isNotNull() & F.col("amounts").isNotNull() & F.col("description").isNotNull(), F.lit(False)))
    flags = {
        "AMOUNT_COLUMNS": F.col("amounts.columns"), "AMOUNT_SIGN": F.col("amounts.signs"), "DATE_COLUMN": (F.col("date_rate") < ENOUGH) | (F.size("best") > 1),
        "DATE_FORMAT": F.col("date_format") == AMBIGUOUS, "DESCRIPTION": F.col("description.uncertain"),
    }
    uncertain = F.filter(F.array(*(F.when(v, k) for k, v in flags.items())), lambda x: x.isNotNull())
    s = also(s, used=F.array(F.col("date_column"), F.col("description.c"), *(F.col(f"amounts.{c}") for c in ("amount_column", "debit_column", "credit_column"))))
    unmapped = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda c: ~F.exists("used", lambda u: u.eqNullSafe(c)))
    values = {
        "date_column": F.col("date_column"), "date_format": F.col("date_format"), "description_column": F.col("description.c"), "amount_column": F.col("amounts.amount_column"), "amount_sign": F.col("amounts.amount_sign"),
        "sign_column": F.lit(None).cast("int"), "debit_column": F.col("amounts.debit_column"), "credit_column": F.col("amounts.credit_column"), "uncertain": uncertain, "unmapped": unmapped,
    }
    # A row for each file; filters on it stop here.
    return cut(s.select("path", "width", "header_row", "first_row", "found", *(F.when(F.col("found"), v).alias(k) for k, v in ({"date_rate": F.col("date_rate")} | values).items())))


def mappings_of(files: DataFrame) -> DataFrame:
    """Every file with its outcome (NoMapping, where nothing was inferred) and what was
    inferred of it."""
    cells = cells_once(files)
    # A text without records, as one of no bytes, has no row at all.
    outcomes = cells.groupBy("path").agg(F.first("outcome").alias("outcome"))
    out = outcomes.join(inferred(cells), "path", "left")
    nothing = F.coalesce(~F.col("found"), F.lit(False)) | ((F.col("outcome") == "Success") & F.col("found").isNull())
    return out.withColumn("outcome", F.when(nothing, "NoMapping").otherwise(F.col("outcome"))).drop("found")


# Rows


def parse_date(text: Column, pattern: Column) -> Column:
    """yyyy-MM-dd, or null. A day past the month's end becomes its last day, up to
    the 31st; day and month need two digits."""

    def parts(t: Column) -> Column:
        month_name = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.lower(F.regexp_extract(t, NAMED, 2))).cast("int")
        fits = (F.regexp_replace(t, "[0-9]", "9") == F.translate(pattern, "yMd", "999")) & pattern.rlike("^(yyyy|dd|MM).(dd|MM).(yyyy|dd|MM)$")
        number = lambda p: F.when(F.instr(pattern, p) > 0, F.substring(t, F.instr(pattern, p), F.lit(len(p)))).try_cast("int")
        named = (pattern == "dd-MMM-yyyy") & t.rlike(r"^\d{2}-[A-Za-z]{3}-\d{4}$")
        by_name = F.struct(F.substring(t, 8, 4).try_cast("int").alias("y"), month_name.alias("m"), F.substring(t, 1, 2).try_cast("int").alias("d"))
        return F.when(named, by_name).when(fits, F.struct(number("yyyy").alias("y"), number("MM").alias("m"), number("dd").alias("d")))

    def written(x: Column) -> Column:
        good = (x["y"] >= 1) & x["m"].between(1, 12) & x["d"].between(1, 31)
        start = F.when(good, F.concat(F.lpad(x["y"].cast("string"), 4, "0"), F.lit("-"), F.lpad(x["m"].cast("string"), 2, "0")))
        last = lambda s: F.dayofmonth(F.last_day(F.concat(s, F.lit("-01")).cast("date")))
        return let(start, lambda s: F.concat(s, F.lit("-"), F.lpad(F.least(x["d"], last(s)).cast("string"), 2, "0")))

    return let(let(strip(text), parts), written)


def amount_of(cells: Column, m: dict[str, Column]) -> Column:
    """A row's signed amount under a mapping; null where it says none, or both."""
    sign = m["amount_sign"]
    amount = lambda c: money.parse(at(cells, m[c]))

    def by_mark(n: Column) -> Column:
        mark = F.lower(strip(at(cells, m["sign_column"])))
        return let(mark, lambda k: F.when(k.startswith("d") | k.contains("dr"), -F.abs(n)).when(k.startswith("c") | k.contains("cr"), F.abs(n)))

    pair = let(F.struct(amount("debit_column").alias("debit"), amount("credit_column").alias("credit")), lambda x: F.when(x["debit"].isNull() != x["credit"].isNull(), F.coalesce(-F.abs(x["debit"]), F.abs(x["credit"]))))
    single = let(amount("amount_column"), lambda n: F.when(sign == "SIGN_COLUMN", by_mark(n)).when(sign == "POSITIVE_IS_DEBIT", -n).otherwise(n))
    return F.when(m["debit_column"].isNotNull(), pair).otherwise(single)


def mapped(rows: DataFrame, m: dict[str, Column]) -> DataFrame:
    """``rows`` with date, description, amount_minor and reason, by a mapping of columns;
    rows that fail have a reason and nothing else."""
    cells = F.col("cells")
    need = F.greatest(*(F.coalesce(m[c], F.lit(0)) for c in NUMBERS[2:])) + 1
    said = lambda pattern, *values: F.concat(*(x for part, v in zip(pattern.split("{}"), [*values, F.lit("")]) for x in (F.lit(part), v.cast("string"))))
    rows = rows.select("*", made_once(date=parse_date(at(cells, m["date_column"]), m["date_format"]), amount_minor=amount_of(cells, m), description=strip(at(cells, m["description_column"]))))
    reason = (
        F.when(F.size(cells) < need, said(FEW_COLUMNS, need, F.size(cells)))
        .when(m["date_format"] == AMBIGUOUS, said(NOT_CONFIRMED, m["date_format"]))
        .when(F.col("date").isNull(), said(BAD_DATE, at(cells, m["date_column"])))
        .when(F.col("amount_minor").isNull(), BAD_AMOUNT)
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in ("date", "description", "amount_minor")})


ROW = ["path", "row_index", "date", "description", "amount_minor", "reason", "raw"]


def rows_of(files: DataFrame, mapping: Mapping | None = None, swap: bool = False) -> DataFrame:
    """Every data row of each file, mapped by what is inferred or by ``mapping``;
    failed rows have a reason and what stands there. A file that is no text has one
    row without an index, its outcome as the reason. ``swap`` exchanges debit and
    credit."""
    cells = cells_of(files) if mapping is not None else cells_once(files)
    if mapping is not None:
        rows, m = cells.withColumn("found", F.lit(True)), stated(mapping)
    else:
        rows = cells.join(inferred(cells).withColumnRenamed("width", "_w"), "path", "left")
        m = {k: F.col(k) for k in (*NUMBERS, *TEXTS)}
    if swap:
        m = m | {"debit_column": m["credit_column"], "credit_column": m["debit_column"]}
    blank = (F.size("cells") == 1) & (F.element_at("cells", 1) == "")
    data = F.col("cells").isNull() | ~F.col("found") | ((F.col("row_index") >= m["first_row"]) & ~blank)
    rows = mapped(rows.where(data), m)
    unread, lost = F.col("cells").isNull(), ~F.col("found")
    out = {c: F.when(~unread & ~lost, F.col(c)) for c in ("date", "description", "amount_minor")}
    out["reason"] = F.when(unread, F.col("outcome")).when(lost, "no mapping").otherwise(F.col("reason"))
    return rows.withColumns(out | {"raw": F.array_join("cells", ", ")}).select(*ROW)


def date_candidates(files: DataFrame) -> DataFrame:
    """path, day_first_failures, month_first_failures: how many dates either order would
    lose, of each file that has a mapping."""
    cells = cells_once(files)
    known = inferred(cells).where("found").select("path", "first_row", "date_column")
    dates = cells.join(known, "path").where("row_index >= first_row and size(cells) > date_column").select("path", at(F.col("cells"), F.col("date_column")).alias("d"))
    lost = lambda f: F.count_if(parse_date(F.col("d"), F.lit(f)).isNull()).cast("int")
    return dates.groupBy("path").agg(lost("dd/MM/yyyy").alias("day_first_failures"), lost("MM/dd/yyyy").alias("month_first_failures"))


def failed_rows(rows: DataFrame) -> DataFrame:
    """The failed rows of ``rows_of``: path, line (from 1, in records), raw, reason."""
    return rows.where("reason is not null").select("path", (F.col("row_index") + 1).alias("line"), "raw", "reason")
