"""Every query of the library against its SQL in DuckDB, over the small tables."""

import duckdb
import pytest

from tallywake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

#: Envelopes differ from run to run; they are opened in a test of their own.
SEALED = {"seal_batch", "seal_snapshot"}


def shown(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name in SEALED:
        return
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(tuple(map(shown, r)) for r in want)


def test_partition_of_expenses(spark):
    """Category rows and the uncategorised row add up to all expenses."""
    from pyspark.sql import functions as F

    from tallywake import ledger
    from tallywake.operators import spend

    L = ledger.load(spark, SF)
    whole = spend.expenses(L.tx).agg(F.sum(-F.col("amount_minor"))).first()[0]
    assert spend.breakdown(L.tx, L.categories, None).agg(F.sum("spent_minor")).first()[0] == whole
    parts = spend.category_spend(L.tx, L.categories, None).agg(F.sum("spent_minor")).first()[0]
    assert parts + spend.uncategorised_spend(L.tx, L.categories, None).first()[0] == whole


def test_all_batches_and_the_whole_snapshot_are_sealed(spark, duck):
    """The envelopes that the queries make, opened: none is left out."""
    from tallywake import ledger
    from tallywake.plans import merges
    from tallywake.streaming import replication

    for name, rows in (("seal_batch", "SELECT * FROM ops"), ("seal_snapshot", f"SELECT * FROM ({merges.NEWEST}) WHERE payload IS NOT NULL")):
        got = sorted(replication.opened(catalog.QUERIES[name](spark, SF)).select(*merges.OP.split(", ")).collect(), key=str)
        want = duck.sql(f"{ledger.CTES} SELECT {merges.OP} FROM ({rows})").fetchall()
        assert want and list(map(tuple, got)) == sorted(want, key=str)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == SEALED


def test_places_and_blocks_of_rules(spark, monkeypatch):
    """Places over many partitions, and rules over many broadcast arrays."""
    from tallywake import ledger
    from tallywake.operators import reads, rules

    df = reads.placed(spark.range(5000).selectExpr("id", "id % 7 as k").repartition(9), "k", "id")
    assert [r.place for r in df.orderBy("k", "id").collect()] == list(range(1, 5001))
    L = ledger.load(spark, SF)
    want = sorted(rules.first_match(L.tx, L.rules).select("id", "rule_id").collect())
    monkeypatch.setattr(rules, "AT_ONCE", 2)
    assert sorted(rules.first_match(L.tx, L.rules).select("id", "rule_id").collect()) == want
