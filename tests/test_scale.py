"""Ranks of hot keys and rules by index: the same results, and what their plans do."""

import random

import pytest
from pyspark.sql import functions as F

from tallywake import ledger
from tallywake.functions import identity
from tallywake.operators import imports, rules

SF = "/root/testdata/sf0.001"


def keyed(spark, n=6000):
    """Two thirds of the rows have one key; some have none."""
    k = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select(k.alias("content_hash"), (F.col("id") * 7919 % n).alias("o"), "id").repartition(9)


def plain(df):
    from pyspark.sql import Window

    return sorted((r.id, r.rank) for r in df.withColumn("rank", F.row_number().over(Window.partitionBy("content_hash").orderBy("o"))).collect())


def test_ranks_over_many_tasks(spark):
    df = keyed(spark)
    got = identity.spread(df, "content_hash", ["o"])
    assert sorted((r.id, r["rank"]) for r in got.collect()) == plain(df) and got.columns == [*df.columns, "rank"]
    # The hot key lies in several ranges, and no task ranks it whole.
    laid = df.orderBy("content_hash", "o").withColumn("p", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in laid.where("content_hash = 'hot'").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 4000


def test_all_rows_of_one_key(spark, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.lit("h").alias("content_hash"), F.col("id").alias("o"), "id").repartition(5)
        assert sorted((r.id, r["rank"]) for r in identity.spread(df, "content_hash", ["o"]).collect()) == [(k, k + 1) for k in range(3000)]
        assert identity.spread(df.limit(0), "content_hash", ["o"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_and_other_keys_together(spark, monkeypatch):
    df = keyed(spark)
    want = plain(df)
    assert sorted((r.id, r["rank"]) for r in identity.ranked(df, "content_hash", ["o"]).collect()) == want
    monkeypatch.setattr(identity, "HOT", 1000)
    assert sorted((r.id, r["rank"]) for r in identity.ranked(df, "content_hash", ["o"]).collect()) == want
    got = identity.occurrence(df, ["o"])
    assert sorted((r.id, r.occurrence + 1) for r in got.collect()) == want


def test_import_of_one_hash(spark, monkeypatch):
    """Stored rows of one hash meet the first imported ones of it, however many."""
    old = spark.range(700).select(F.lit("h").alias("content_hash"), F.format_string("%05d", "id").alias("id"), F.when(F.col("id") % 2 == 0, F.lit(1).cast("long")).alias("deleted_at"))
    new = imports.derive_ids(spark.range(1000).select(F.lit("h").alias("content_hash"), F.col("id").alias("row_index")))
    want = {r.bucket: r.n for r in imports.counters(imports.dedupe(old, new)).collect()}
    monkeypatch.setattr(identity, "HOT", 100)
    assert want == {"previously_deleted": 350, "duplicate": 350, "inserted": 300} == {r.bucket: r.n for r in imports.counters(imports.dedupe(old, new)).collect()}


RULES = "id string, category_id string, merchant_contains string, priority int, deleted_at long"


def made(spark, needles):
    return spark.createDataFrame([(f"r{k:06d}", f"c{k % 7}", n, k * 31 % 17, None) for k, n in enumerate(needles)], RULES)


def texts(spark, values):
    return spark.createDataFrame([(k, v if k % 2 else None, v) for k, v in enumerate(values)], "id int, merchant string, description string")


def test_index_against_every_rule(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé 1") for _ in range(n))
    values = [word(rng.randint(0, 12)) for _ in range(400)] + ["", None, "ab", "a", "  "]
    needles = [word(rng.randint(0, 5)) for _ in range(300)] + ["A", "ab ", "zzz", "zz", "aba", "ABA"]
    tx, rs = texts(spark, values), made(spark, needles)
    fit = sorted(((k * 31 % 17, f"r{k:06d}", n.strip(" ").upper()) for k, n in enumerate(needles) if n.strip(" ")))
    got = {r.id: r.rule_id for r in rules.by_index(tx, rules.prepare(rs)).collect()}
    assert len(got) == len(values)
    for k, v in enumerate(values):
        hay = (v or "").strip(" ").upper()
        assert got[k] == next((i for _, i, n in fit if v is not None and n in hay), None), v


def test_both_ways_agree(spark, monkeypatch):
    L = ledger.load(spark, SF)
    both = lambda: sorted((r.id, r.rule_id or "", r.rule_category or "") for r in rules.first_match(L.tx, L.rules).collect())
    want = both()
    monkeypatch.setattr(rules, "AT_ONCE", 2)
    assert both() == want
    none = L.rules.limit(0)
    assert rules.by_index(L.tx, rules.prepare(none)).where("rule_id is not null").count() == 0


@pytest.mark.parametrize("many", [100_000])
def test_very_many_rules(spark, many):
    """A hundred thousand rules: pairs that are looked at are far fewer than rows by rules."""
    rs = spark.range(many).select(F.format_string("r%06d", "id").alias("id"), F.lit("c").alias("category_id"), F.concat(F.lit("shop "), F.conv(F.col("id") * 7 + 100000, 10, 36)).alias("merchant_contains"), F.lit(0).alias("priority"), F.lit(None).cast("long").alias("deleted_at"))
    tx = spark.range(2000).select("id", F.lit(None).cast("string").alias("merchant"), F.concat(F.lit("The Shop "), F.conv(F.col("id") * 350 + 100000, 10, 36), F.lit(" downtown")).alias("description"))
    got = rules.first_match(tx, rs)
    hits = {r.id: r.rule_id for r in got.collect()}
    assert all(hits[k] == f"r{k * 50:06d}" for k in range(2000))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and not [x for x in plan.split("\n") if "Join" in x and "=" not in x]
