"""Categorisation: the first matching rule by (priority, id) decides.

A user's rules are a short list that is gathered into one sorted array; each row
takes the first element that fits, so rows are never multiplied. Beyond a bound they
are an inverted index instead, so that rows and rules are never multiplied either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_upper
from ..ledger import live
from ..lineage import cut
from .reads import rule_candidates

#: Rules of the broadcast array at most, and characters of the index's runs.
AT_ONCE, GRAM = 1000, 3


def prepare(rules: DataFrame) -> DataFrame:
    """Live rules with a needle that is not blank, as it is looked for."""
    return live(rules).select("id", "category_id", "priority", trim_upper(F.col("merchant_contains")).alias("needle")).where("needle <> ''")


def haystack() -> Column:
    return trim_upper(F.coalesce("merchant", "description"))


def first_match(tx: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule_id`` and ``rule_category`` of the first rule that fits. Up to
    ``AT_ONCE`` rules are one broadcast array in order, of which each row takes the
    first that fits; more are found by an index."""
    listed = prepare(rules)
    if listed.limit(AT_ONCE + 1).count() > AT_ONCE:
        return by_index(tx, listed)
    one = listed.agg(F.sort_array(F.collect_list(F.struct("priority", "id", "category_id", "needle"))).alias("_rules"))
    rows = tx.withColumn("_hay", haystack()).join(F.broadcast(one), F.lit(True))
    hit = F.get(F.filter("_rules", lambda r: F.contains(F.col("_hay"), r["needle"])), 0)
    return rows.withColumn("_hit", hit).select(*tx.columns, F.col("_hit.id").alias("rule_id"), F.col("_hit.category_id").alias("rule_category"))


def grams(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.array_distinct(F.filter(runs, lambda g: F.length(g) == size))


def by_index(tx: DataFrame, listed: DataFrame) -> DataFrame:
    """``first_match`` for rules of any number, ``listed`` as by ``prepare``.

    Of rules with one needle the first is enough. A needle is filed under that run
    of ``GRAM`` characters which the fewest different texts hold, or whole if it is
    shorter; a text meets the needles that are filed under its own runs, and only
    those are looked for in it. Each different text is matched once.
    """
    first = F.min(F.struct("priority", "id", "category_id"))
    needles = cut(listed.groupBy("needle").agg(first.alias("rule")))
    texts = tx.select(haystack().alias("_text")).where("_text is not null").distinct()
    sizes = [r[0] for r in needles.select(F.least(F.length("needle"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM rows at most
    runs = lambda c: F.concat(*(grams(c, n) for n in sizes)) if sizes else F.array().cast("array<string>")
    # A short needle is its own run.
    keys = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(grams(F.col("needle"), GRAM))
    keyed = needles.select("needle", "rule", F.explode(keys).alias("_gram"))
    held = texts.select("_text", F.explode(runs(F.col("_text"))).alias("_gram")).join(keyed.select("_gram").distinct(), "_gram", "left_semi")
    held = cut(held)
    often = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    # A run that no text holds ends its needle's search.
    filed = keyed.join(often, "_gram", "left")
    filed = filed.groupBy("needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("k"), F.first("rule").alias("rule")).where("k.n > 0")
    met = held.join(filed.select(F.col("k.gram").alias("_gram"), "needle", "rule"), "_gram").where(F.contains("_text", "needle"))
    best = met.groupBy("_text").agg(F.min("rule").alias("_rule"))
    rows = tx.withColumn("_hay", haystack()).join(best, F.col("_hay") == F.col("_text"), "left")
    return rows.select(*tx.columns, F.col("_rule.id").alias("rule_id"), F.col("_rule.category_id").alias("rule_category"))


def assignments(tx: DataFrame, rules: DataFrame, uncategorised_only: bool = False) -> DataFrame:
    """id, category_id for unlocked rows whose first matching rule changes them.
    A first match that changes nothing does not fall through."""
    hit = first_match(rule_candidates(tx, uncategorised_only), rules)
    return hit.where("rule_category is not null and not (category_id <=> rule_category)").select("id", F.col("rule_category").alias("category_id"))


def locked_matches(tx: DataFrame, rules: DataFrame, uncategorised_only: bool = False) -> DataFrame:
    """One row: how many locked rows a rule would change."""
    hit = first_match(rule_candidates(tx, uncategorised_only, locked=True), rules)
    return hit.agg(F.count_if(F.col("rule_category").isNotNull() & ~F.col("category_id").eqNullSafe(F.col("rule_category"))).alias("locked_skipped"))


def preview(tx: DataFrame, rules: DataFrame, uncategorised_only: bool = False) -> DataFrame:
    """One row: changed and locked_skipped."""
    n = assignments(tx, rules, uncategorised_only).agg(F.count("*").alias("changed"))
    return n.join(locked_matches(tx, rules, uncategorised_only), F.lit(True))


def apply(tx: DataFrame, chosen: DataFrame, now: int) -> DataFrame:
    """Writes a preview's own assignments to rows still unlocked and live; keeps
    batch and hash. ``changed`` marks the rows."""
    a = chosen.select(F.col("id").alias("_i"), F.col("category_id").alias("_c"))
    hit = F.col("_c").isNotNull() & ~F.col("category_locked_by_user") & F.col("deleted_at").isNull()
    rows = tx.join(a, F.col("id") == F.col("_i"), "left").withColumn("changed", F.coalesce(hit, F.lit(False)))
    return rows.withColumns({
        "category_id": F.when(F.col("changed"), F.col("_c")).otherwise(F.col("category_id")),
        "updated_at": F.when(F.col("changed"), F.lit(now)).otherwise(F.col("updated_at")),
        "local_revision": F.col("local_revision") + F.col("changed").cast("int"),
        "pending_operation": F.when(F.col("changed"), "UPSERT").otherwise(F.col("pending_operation")),
    }).drop("_i", "_c")
