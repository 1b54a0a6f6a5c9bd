"""Statements that are odd, broken or unreadable: a stated outcome, never a crash."""

import pytest
from pyspark.sql import functions as F

from tallywake.functions import money
from tallywake.sources import statements as S

CELLS = ["20\u00b2", "\u0663.5", "1,234.50", "(12.00)", "-5", "", "--", "1.234", "12,5", " 7 ", "Rs 9", "9223372036854775808"]


def test_money_is_the_column_expression(spark):
    rows = spark.createDataFrame([(c,) for c in CELLS], "c string")
    got = {r.c: r.m for r in rows.select("c", money.parse(F.col("c"), 2).alias("m")).collect()}
    assert got == {"20\u00b2": 2000, "\u0663.5": 350, "1,234.50": 123450, "(12.00)": -1200, "-5": -500, "": None, "--": None, "1.234": 123400, "12,5": 1250, " 7 ": 700, "Rs 9": 900, "9223372036854775808": None}


@pytest.mark.parametrize(
    "change",
    [
        {"debit_column": 2}, {"credit_column": 3}, {"amount_column": 2}, {"amount_column": 2, "amount_sign": "NEGATIVE_IS_DEBIT", "debit_column": 3, "credit_column": 4},
        {"amount_column": 2, "amount_sign": "SIGN_COLUMN"}, {"amount_column": 2, "amount_sign": "POSITIVE_IS_DEBIT", "sign_column": 3}, {"debit_column": 2, "credit_column": 3, "amount_sign": "POSITIVE_IS_DEBIT"}, {},
    ],
)
def test_mappings_that_make_no_sense(change):
    with pytest.raises(ValueError):
        S.Mapping(0, 1, 0, "yyyy-MM-dd", 1, **change)


def mapped(spark, rows, m):
    """(date, description, amount, reason) of each row under a mapping."""
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, cells array<string>")
    return [(r.date, r.description, r.amount_minor, r.reason) for r in S.mapped(df, S.stated(m)).orderBy("k").collect()]


def test_reasons_name_what_stands_there(spark):
    m = S.Mapping(0, 1, 0, "dd/MM/yyyy", 1, 2, "NEGATIVE_IS_DEBIT")
    rows = [["13/13/2026", "a", "1"], ["01/02/2026", "a"], ["01/02/2026", "a", "x"]]
    assert [r[3] for r in mapped(spark, rows, m)] == ['unparseable date "13/13/2026"', "expected at least 3 columns, found 2", "unparseable or ambiguous amount"]
    m.date_format = S.AMBIGUOUS
    assert mapped(spark, [["01/02/2026", "a", "1"]], m)[0] == (None, None, None, 'date format "AMBIGUOUS" is not confirmed')


def test_dates_by_pattern(spark):
    cases = [("2026-02-31", "yyyy-MM-dd", "2026-02-28"), (" 2024-02-30 ", "yyyy-MM-dd", "2024-02-29"), ("2026-2-03", "yyyy-MM-dd", None), ("31.04.2026", "dd.MM.yyyy", "2026-04-30"), ("04.31.2026", "dd.MM.yyyy", None), ("32/01/2026", "dd/MM/yyyy", None),
             ("01-Sep-2026", "dd-MMM-yyyy", "2026-09-01"), ("1-Sep-2026", "dd-MMM-yyyy", None), ("01-Foo-2026", "dd-MMM-yyyy", None), ("0000-01-01", "yyyy-MM-dd", None), ("", "yyyy-MM-dd", None), ("01/02/2026", "nonsense", None), ("12-31-2026", "MM-dd-yyyy", "2026-12-31"), ("12/31/2026", "MM-dd-yyyy", None)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, p string, want string")
    assert [r.got for r in df.select("k", S.parse_date(F.col("t"), F.col("p")).alias("got")).orderBy("k").collect()] == [c[2] for c in cases]


def test_amounts_by_mapping(spark):
    pair = S.Mapping(None, 0, 0, "yyyy-MM-dd", 1, debit_column=2, credit_column=3)
    day = "2026-01-01"
    assert [r[2] for r in mapped(spark, [[day, "a", "5", ""], [day, "a", "", "5"], [day, "a", "5", "5"], [day, "a", "", ""], [day, "a", "-5", ""]], pair)] == [-500, 500, None, None, -500]
    mark = S.Mapping(None, 0, 0, "yyyy-MM-dd", 1, 2, "SIGN_COLUMN", 3)
    assert [r[2] for r in mapped(spark, [[day, "a", "-5", " Dr"], [day, "a", "5", "by CR note"], [day, "a", "5", "c"], [day, "a", "5", "?"], [day, "a", "5", "debit"]], mark)] == [-500, 500, 500, None, -500]
    assert mapped(spark, [[day, " a b ", "5"]], S.Mapping(None, 0, 0, "yyyy-MM-dd", 1, 2, "POSITIVE_IS_DEBIT"))[0] == (day, "a b", -500, None)


def test_no_file_vanishes(spark, tmp_path):
    good = "Date,Details,Amount\n2026-01-05,tea,-5.00\n2026-01-06,pay,20\u00b2\n"
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "nul.csv").write_bytes(b"a\0b")
    (tmp_path / "odd.csv").write_bytes(b"\xff\xfe")
    (tmp_path / "empty.csv").write_bytes(b"")  # nothing to import, and no row
    (tmp_path / "large.csv").write_bytes(b"a,b\n" * (S.MOST_BYTES // 4 + 1))
    (tmp_path / "quote.csv").write_text('2026-01-05,"' + "x" * 300_000)
    files = S.read_files(spark, str(tmp_path), str(tmp_path / "nothing.csv"))
    name = lambda r: r.path.rsplit("/", 1)[1]
    outcome = {name(r): r.outcome for r in S.mappings_of(files).collect()}
    assert outcome == {"good.csv": "Success", "nul.csv": "NotText", "odd.csv": "EncodingUnclear", "large.csv": "TooLarge", "quote.csv": "NoMapping", "nothing.csv": "ReadFailed"}
    reasons = {name(r): r.reason for r in S.rows_of(files).collect() if r.row_index is None}
    assert reasons == {"nul.csv": "NotText", "odd.csv": "EncodingUnclear", "large.csv": "TooLarge", "nothing.csv": "ReadFailed"}
    cells = {name(r): r.outcome for r in S.cells_of(files).where("cells is null").collect()}
    assert cells == reasons
    rows = [(r.row_index, r.amount_minor, r.reason) for r in S.rows_of(files).where("path like '%good.csv'").orderBy("row_index").collect()]
    assert rows == [(1, -500, None), (2, 2000, None)]


HEADS = {
    "signed, day first": ("Date,Narration,Amount", ["13/02/2026,tea shop,-5.00", "01/03/2026,pay office,7.00"], dict(date_format="dd/MM/yyyy", amount_column=2, amount_sign="NEGATIVE_IS_DEBIT", description_column=1)),
    "debit and credit": ("Txn Date,Particulars,Withdrawal,Deposit", ["2026-02-13,tea,5.00,", "2026-03-01,pay,,7.00"], dict(debit_column=2, credit_column=3, amount_column=None, date_format="yyyy-MM-dd")),
    "credit first": ("Txn Date,Particulars,Deposit,Withdrawal", ["2026-02-13,tea,5.00,", "2026-03-01,pay,,7.00"], dict(debit_column=3, credit_column=2)),
    "named months": ("Description,Value,Posted", ["tea at the corner,5.00,13-Feb-2026", "pay for the month,7.00,01-Mar-2026"], dict(date_column=2, date_format="dd-MMM-yyyy", amount_column=1)),
    "either order": ("Date,Details,Amount", ["01/02/2026,tea,5.00", "03/04/2026,pay,7.00"], dict(date_format="AMBIGUOUS")),
}


def inferred(spark, texts):
    """The mapping of each text by its name; None where nothing was inferred."""
    files = spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "path string, content binary")
    return {r.path: None if r.outcome == "NoMapping" else r for r in S.mappings_of(files).collect()}


def test_layouts(spark):
    texts = {}
    for name, (head, rows, _) in HEADS.items():
        texts |= {name: "\n".join([head, *rows]), f"{name}, late": "My bank\n\n" + "\n".join([head, *rows, *rows])}
    for name, m in inferred(spark, texts).items():
        want = HEADS[name.removesuffix(", late")][2]
        assert m is not None and {k: m[k] for k in want} == want, name


def statement(head, *rows):
    return "\n".join([head, *rows] if head else rows)


RUNNING = ["2025-03-01,rent,-100.00,900.00", "2025-03-02,wages,500.00,1400.00", "2025-03-03,bread,-20.00,1380.00", "2025-03-04,books,-80.00,1300.00", "2025-03-05,train,-50.00,1250.00"]
SHAPES = {
    "signed amounts": (statement("Day,What,Sum", "2025-03-01,rent,-100.00", "2025-03-02,wages,500.00"), dict(header_row=0, first_row=1, amount_column=2, uncertain=["AMOUNT_SIGN"])),
    "pair, header": (statement("Day,What,Withdrawal Amt,Deposit Amt", "2025-03-01,rent,100.00,", "2025-03-02,wages,,500.00"), dict(debit_column=2, credit_column=3, uncertain=[])),
    "pair, no header": (statement("", "2025-03-01,rent,100.00,", "2025-03-02,wages,,500.00"), dict(header_row=None, first_row=0, debit_column=2, credit_column=3, uncertain=["AMOUNT_COLUMNS"])),
    "no header": (statement("", "2025-03-01,rent,-100.00", "2025-03-02,wages,500.00"), dict(header_row=None, first_row=0)),
    "lines before": (statement("Holder: me\nMarch\n\nDay,What,Sum", "2025-03-01,rent,-100.00", "2025-03-02,wages,500.00", "2025-03-03,bread,-20.00"), dict(header_row=3, first_row=4)),
    "balance last": (statement("Day,What,Sum,Left", *RUNNING), dict(amount_column=2, amount_sign="NEGATIVE_IS_DEBIT", unmapped=[3], uncertain=[])),
    "balance with a gap": (statement("Day,What,Sum,Left", *RUNNING[:3], "2025-03-04,odd,-80.00,7000.00", "2025-03-05,train,-50.00,6950.00", "2025-03-06,milk,-5.00,6945.00"), dict(amount_column=2, unmapped=[3])),
    "balance blank at first": (statement("Day,What,Sum,Left", "2025-02-27,tea,-3.00,", "2025-02-28,tea,-3.00,", *RUNNING), dict(amount_column=2, unmapped=[3])),
    "two amounts without a role": (statement("Day,What,Fee,Sum", "2025-03-01,rent,2.00,-100.00", "2025-03-02,wages,3.00,500.00", "2025-03-03,bread,1.00,-20.00"), dict(amount_column=2, uncertain=["AMOUNT_COLUMNS", "AMOUNT_SIGN"])),
    "pair and balance": (statement("Day,What,Withdrawal,Deposit,Left", "2025-03-01,rent,100.00,,900.00", "2025-03-02,wages,,500.00,1400.00", "2025-03-03,bread,20.00,,1380.00"), dict(uncertain=["AMOUNT_COLUMNS", "AMOUNT_SIGN"])),
    "other ways to write amounts": (statement("Day,What,Sum", '2025-03-01,rent,"-1.100,50"', '2025-03-02,wages,"5,00,000.25"'), dict(amount_column=2)),
    "either order": (statement("Day,What,Sum", "03/04/2025,rent,-100.00", "05/06/2025,wages,500.00"), dict(date_format="AMBIGUOUS", uncertain=["AMOUNT_SIGN", "DATE_FORMAT"])),
    "day first": (statement("Day,What,Sum", "23/04/2025,rent,-100.00", "05/06/2025,wages,500.00"), dict(date_format="dd/MM/yyyy", uncertain=["AMOUNT_SIGN"])),
    "month first": (statement("Day,What,Sum", "04/23/2025,rent,-100.00", "05/06/2025,wages,500.00"), dict(date_format="MM/dd/yyyy", uncertain=["AMOUNT_SIGN"])),
    "named month": (statement("Day,What,Sum", "23-Apr-2025,rent,-100.00", "05-Jun-2025,wages,500.00"), dict(date_format="dd-MMM-yyyy")),
    "orders that contradict": (statement("Day,What,Sum", "23/04/2025,rent,-100.00", "04/23/2025,wages,500.00"), dict(date_format="AMBIGUOUS", uncertain=["AMOUNT_SIGN", "DATE_FORMAT"])),
    "balance, fee and amount": (statement("Day,What,Fee,Sum,Left", "2025-03-01,rent,1.50,-100.00,900.00", "2025-03-02,wages,1.50,500.00,1400.00", "2025-03-03,bread,1.50,-20.00,1380.00", "2025-03-04,books,1.50,-80.00,1300.00", "2025-03-05,train,1.50,-50.00,1250.00"), dict(amount_column=2, amount_sign="NEGATIVE_IS_DEBIT", uncertain=["AMOUNT_COLUMNS", "AMOUNT_SIGN"], unmapped=[3, 4])),
    "balance taken out leaves a pair": (statement("Day,What,Debit,Credit,Sum,Left", "2025-03-01,rent,100.00,,,900.00", "2025-03-02,wages,,500.00,,1400.00", "2025-03-03,bread,20.00,,,1380.00"), dict(uncertain=["AMOUNT_COLUMNS", "AMOUNT_SIGN"])),
    "one hint alone": (statement("Day,What,Debit,Other", "2025-03-01,rent,100.00,", "2025-03-02,wages,,500.00"), dict(debit_column=2, credit_column=3, uncertain=["AMOUNT_COLUMNS"])),
    "populated means parsed": (statement("Day,What,Debit,Credit", *[f"2025-03-{k:02d},rent,{k}.00,-" for k in range(1, 4)], *[f"2025-03-{k:02d},rent,-,{k}.00" for k in range(6, 8)], *[f"2025-03-{k:02d},rent,,{k}.00" for k in range(10, 20)], *[f"2025-03-{k:02d},rent,{k}.00," for k in range(20, 29)]), dict(debit_column=2, credit_column=3, uncertain=[])),
    "a date that is none": (statement("Day,What,Sum", "2025-03-01,rent,-100.00", "2025-03-02,wages,500.00", "pending,bread,-5.00", *[f"2025-04-{k:02d},bread,-5.00" for k in range(1, 20)]), dict(date_column=0, date_format="AMBIGUOUS", uncertain=["AMOUNT_SIGN", "DATE_FORMAT"])),
    "too few columns": (statement("Day,Sum", "2025-03-01,-100.00"), None),
    "prose": ("Nothing of a bank.\nOnly words.\nAnd more of them.", None),
}


def test_shapes(spark):
    for name, m in inferred(spark, {k: t for k, (t, _) in SHAPES.items()}).items():
        want = SHAPES[name][1]
        assert (m is None) if want is None else {k: m[k] for k in want} == want, name


def test_amounts_of_other_countries(spark):
    files = spark.createDataFrame([("f", SHAPES["other ways to write amounts"][0].encode())], "path string, content binary")
    assert [r.amount_minor for r in S.rows_of(files).orderBy("row_index").collect()] == [-110050, 50000025]


def test_a_wide_and_a_long_file(spark):
    """The sample is bounded, and rows beyond it are mapped all the same."""
    rows = [f"2026-01-{k % 28 + 1:02d},row {k} of many,{k}.00" for k in range(3000)]
    wide = ",".join(["2026-01-05", "text that is here", "5.00", *["x"] * 300])
    files = spark.createDataFrame([("long", "\n".join(["Date,What,Sum", *rows]).encode()), ("wide", "\n".join([wide] * 3).encode())], "path string, content binary")
    got = S.rows_of(files).groupBy("path").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("s")).collect()
    assert {r.path: (r.n, r.s) for r in got} == {"long": (3000, 100 * sum(range(3000))), "wide": (3, 1500)}


def test_filters_do_not_compute_inference_again(spark):
    """What a mapping or a row is filtered by is a column, and not the expressions
    that made it, however many refer to each other."""
    text = "Date,Narration,Withdrawal,Deposit\n2026-01-05,tea,5.00,\n2026-01-06,pay,,7.00\n2026-01-07,pay,,8.00\n"
    files = spark.createDataFrame([("a", text.encode())], "path string, content binary")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    known = S.mappings_of(files).where("debit_column is not null")
    assert plan(known).count("transform(") == 0
    assert [(r.debit_column, r.credit_column, r.uncertain) for r in known.collect()] == [(2, 3, [])]
    rows = S.rows_of(files).where("reason is null and amount_minor % 2 = 0")
    assert plan(rows).count("last_day(") == 1
    assert sorted(r.amount_minor for r in rows.collect()) == [-500, 700, 800]
