"""Stated results of functions, statements, dedupe and merges."""

import pytest
from pyspark.sql import functions as F

from tallywake.functions import identity, months
from tallywake.operators import dml, imports, merge, reads
from tallywake.sources import statements as S
from tallywake.streaming import replication


def test_content_hash(spark):
    rows = spark.createDataFrame([("Coffee Shop",), ("  coffee shop  ",)], "d string")
    got = rows.select(identity.content_hash(F.lit("acct-1"), F.lit("2026-01-05"), F.lit(-45000), F.col("d"))).collect()
    assert {r[0] for r in got} == {"e69daf8267b11c3689db7a3e6d95f3fb"}


def test_import_counts(spark):
    """Two stored and three incoming equal rows: two duplicates, one inserted."""
    old = spark.createDataFrame([("h1:a#0", "a", None), ("h1:a#1", "a", 5)], "id string, content_hash string, deleted_at bigint")
    new = imports.derive_ids(spark.createDataFrame([(i, "a") for i in range(3)], "row_index int, content_hash string"))
    got = {r.row_index: r.bucket for r in imports.dedupe(old, new).collect()}
    assert got == {0: "duplicate", 1: "previously_deleted", 2: "inserted"}


def test_months():
    assert months.window("2024-02") == ("2024-02-01", "2024-02-29")
    assert months.shift("2026-01", -2) == "2025-11"
    with pytest.raises(ValueError):
        months.window("2026-13")
    assert reads.FilterState(preset="CUSTOM", start="2026-01-01").resolve("2026-02-01").window is None
    assert dml.move(["a", "b"], "b", 1) == ["a", "b"]


def test_tokenize():
    assert S.tokenize('﻿a,"b ""q"" \n2",c\r\n\r\nd,e') == [["a", 'b "q" \n2', "c"], [""], ["d", "e"]]


def test_inference(spark):
    texts = {
        "pair": "Date,Narration,Withdrawal Amt,Deposit Amt\n01/02/2026,tea,5.00,\n13/02/2026,pay,,100.00\n", "order": "Date,Description,Amount\n01/02/2026,tea,5.00\n03/04/2026,bus,7.00\n",
        "narrow": "Date,Amount\n2026-01-01,5\n", "prose": "some prose, and\nmore of it\n",
    }
    files = spark.createDataFrame([(k, t.encode()) for k, t in texts.items()], "path string, content binary")
    got = {r.path: r for r in S.mappings_of(files).collect()}
    m = got["pair"]
    assert (m.debit_column, m.credit_column, m.date_format, m.uncertain) == (2, 3, "dd/MM/yyyy", [])
    m = got["order"]
    assert m.date_format == S.AMBIGUOUS and {"DATE_FORMAT", "AMOUNT_SIGN"} <= set(m.uncertain)
    assert got["narrow"].outcome == got["prose"].outcome == "NoMapping"


def test_dates_are_clamped(spark):
    df = spark.createDataFrame([(0, "31/02/2026", "dd/MM/yyyy"), (1, "5/3/2026", "dd/MM/yyyy"), (2, "15-Aug-2026", "dd-MMM-yyyy")], "k int, t string, p string")
    assert [r.d for r in df.select("k", S.parse_date(F.col("t"), F.col("p")).alias("d")).orderBy("k").collect()] == ["2026-02-28", None, "2026-08-15"]


def test_signs(spark):
    m = S.Mapping(None, 0, 0, "yyyy-MM-dd", 1, 2, "SIGN_COLUMN", sign_column=3)
    df = spark.createDataFrame([(k, ["", "", "5", x]) for k, x in enumerate(("Dr", "CR", "?"))], "k int, cells array<string>")
    assert [r.a for r in df.select("k", S.amount_of(F.col("cells"), S.stated(m)).alias("a")).orderBy("k").collect()] == [-500, 500, None]
    assert S.mapped(spark.createDataFrame([(["2026-01-01"],)], "cells array<string>"), S.stated(m)).first().reason == "expected at least 4 columns, found 1"


def test_merge_of_notes(spark):
    rows = spark.createDataFrame([('"a"', '"a b"', 1, 2), ('"x"', '"y"', 5, 1), ("null", '"y"', 1, 1)], "l string, r string, local_at int, remote_at int")
    rows = rows.withColumns({"local_device": F.lit("a"), "remote_device": F.lit("b")})
    x = merge.field(F.col("l"), F.col("r"), F.lit(None).cast("string"), F.lit(False), "MERGE")
    got = [r.v for r in rows.select(x["value"].alias("v")).collect()]
    assert got == ['"a b"', f'"x\\n{merge.NOTES_MARKER}\\ny"', "null"]


def test_envelope_and_key(spark):
    key = replication.derive_key("p", b"0" * 16)
    row = spark.createDataFrame([("text",)], "t string").select(replication.seal(F.col("t"), key).alias("e"))
    assert row.select(replication.unseal(F.col("e"), key).alias("t")).first().t == "text"
    assert bytes(row.first().e)[:1] == replication.VERSION
    assert replication.from_pairing_code("!") is None
    with pytest.raises(replication.NotConfigured):
        replication.disabled()


def test_compaction_does_not_revive(spark):
    """A tombstone and then an older operation: the row stays gone."""
    schema = "device_id string, seq int, version int, table_name string, row_id string, remote_revision int, updated_at int, payload string"
    ops = spark.createDataFrame([("a", 1, 1, "budgets", "r", 5, 0, None), ("b", 1, 1, "budgets", "r", 3, 0, "{}"), ("b", 2, 1, "budgets", "s", 3, 0, "{}")], schema)
    assert [r.row_id for r in replication.compact(ops).collect()] == ["s"]
