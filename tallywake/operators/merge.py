"""Three-way merge of rows that two devices changed.

Payload fields are JSON texts (``"a"``, ``5``, ``true``, ``null``), so that values
keep their type; a missing base means that every field counts as changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what stands between two notes that were both kept.
NOTES_MARKER = "--- synced from another device ---"
#: How a field is settled that both sides changed: notes are merged, the category
#: goes with its lock, and all else takes the newer value.
MERGED = ("notes",)
LOCK_PAIR = ("category_id", "category_locked_by_user")
#: The fields of each table that travel.
SYNCED = {
    "transactions": ["amount_minor", "currency_code", "date", "description", "merchant", "category_id", "account_id", "source", "notes", "category_locked_by_user", "import_batch_id"],
    "categories": ["name", "parent_id", "color_argb", "icon_key", "is_system_defined"],
    "budgets": ["category_id", "year_month", "limit_minor", "currency_code"],
    "category_rules": ["category_id", "merchant_contains", "priority"],
}


def policy(table: str, field: str) -> str:
    """MERGE, CATEGORY_LOCK_TIEBREAK or USER_PROMPT (which is a tiebreak)."""
    if table == "transactions" and field in MERGED:
        return "MERGE"
    return "CATEGORY_LOCK_TIEBREAK" if table == "transactions" and field in LOCK_PAIR else "USER_PROMPT"


def text_of(json: Column) -> Column:
    """A JSON string's text; null for the JSON null."""
    return F.when(json != "null", F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"), json))


def kind_of(json: Column) -> Column:
    """What a conflict's value is: None, Text, Flag or Number."""
    return (
        F.when(json.isNull() | (json == "null"), "None").when(json.startswith('"'), "Text").when(json.isin("true", "false"), "Flag")
        .when(json.rlike("^-?[0-9]+$"), "Number").otherwise("Text")
    )


def local_wins(s: dict[str, Column]) -> Column:
    """The newer side; of equals the device with the smaller id."""
    return F.when(s["local_at"] != s["remote_at"], s["local_at"] > s["remote_at"]).otherwise(s["local_device"] < s["remote_device"])


def sides() -> dict[str, Column]:
    return {k: F.col(k) for k in ("local_at", "remote_at", "local_device", "remote_device")}


def outcome(value: Column, discarded: Column | None = None, reason: Column | str | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else F.lit(c) if isinstance(c, str) else c
    return F.struct(value.alias("value"), text(discarded).alias("discarded"), text(reason).alias("reason"))


def tiebreak(local: Column, remote: Column, reason: Column | str = "both devices changed this field; kept the newer value") -> Column:
    win = local_wins(sides())
    return outcome(F.when(win, local).otherwise(remote), F.when(win, remote).otherwise(local), reason)


def changed(value: Column, base: Column, has_base: Column) -> Column:
    return ~has_base | ~value.eqNullSafe(base)


def notes(local: Column, remote: Column) -> Column:
    """Both texts changed: a text that has the other in it wins; else both stay,
    the newer first. A side that was cleared is settled by the tiebreak."""
    a, b = text_of(local), text_of(remote)
    newer = F.col("local_at") >= F.col("remote_at")
    both = F.to_json(F.struct(F.concat_ws("\n", F.when(newer, a).otherwise(b), F.lit(NOTES_MARKER), F.when(newer, b).otherwise(a)).alias("v")))
    both = F.regexp_extract(both, r'(?s)^\{"v":(.*)\}$', 1)
    cleared = tiebreak(local, remote, "one device cleared the note while the other edited it; kept the newer version")
    return (
        F.when(a.isNull() | b.isNull(), cleared).when(F.contains(b, a), outcome(remote)).when(F.contains(a, b), outcome(local))
        .otherwise(outcome(both, F.when(newer, remote).otherwise(local), "both devices edited the note differently; kept both"))
    )


def field(local: Column, remote: Column, base: Column, has_base: Column, how: str = "USER_PROMPT") -> Column:
    """struct(value, discarded, reason) of one field."""
    settled = {"MERGE": notes, "LOCAL_WINS": lambda a, _: outcome(a), "REMOTE_WINS": lambda _, b: outcome(b)}.get(how, tiebreak)(local, remote)
    return (
        F.when(local == remote, outcome(local)).when(~changed(local, base, has_base), outcome(remote))
        .when(~changed(remote, base, has_base), outcome(local)).otherwise(settled)
    )


def category_pair(local: Column, local_lock: Column, remote: Column, remote_lock: Column, base: Column, base_lock: Column, has_base: Column) -> Column:
    """struct(value, discarded, reason, locked): category and lock as one. A hand
    choice beats a rule's whatever the time."""
    same = (local == remote) & (local_lock == remote_lock)
    local_new = changed(local, base, has_base) | changed(local_lock, base_lock, has_base)
    remote_new = changed(remote, base, has_base) | changed(remote_lock, base_lock, has_base)
    reason = F.when(local_lock, "both devices locked a different category by hand").otherwise("two rule guesses disagreed on the category")

    def pair(x: Column, lock: Column) -> Column:
        return F.struct(x["value"].alias("value"), x["discarded"].alias("discarded"), x["reason"].alias("reason"), lock.alias("locked"))

    mine, theirs = pair(outcome(local), local_lock), pair(outcome(remote), remote_lock)
    return (
        F.when(same, mine).when(~local_new, theirs).when(~remote_new, mine).when(local_lock & ~remote_lock, mine).when(remote_lock & ~local_lock, theirs)
        .otherwise(pair(tiebreak(local, remote, reason), local_lock))
    )


def delete_beats_edit(edited: dict[str, Column], base: dict[str, Column], has_base: Column) -> Column:
    """Whether a delete stands against the other side's row: it does if that side
    changed nothing, or only the category (a rule's guess)."""
    others = [changed(v, base[k], has_base) for k, v in edited.items() if k != "category_id"]
    hand = F.lit(False)
    for c in others:
        hand = hand | c
    return ~hand & (has_base | F.lit(not others))


def pairs(tx: DataFrame) -> DataFrame:
    """Two sides of every row, made from the ledger: what merges are run on."""
    n, js = F.col("id").cast("bigint"), lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    note = lambda k: F.when(n % k == 0, F.lit("null")).otherwise(F.concat(F.lit('"note '), (n % k).cast("string"), F.lit('"')))
    return tx.select(
        "id", (n % 7).alias("local_at"), (n % 5).alias("remote_at"), F.concat(F.lit("d"), (n % 3).cast("string")).alias("local_device"), F.lit("d1").alias("remote_device"), (n % 4 != 0).alias("has_base"),
        note(4).alias("local_notes"), note(6).alias("remote_notes"), F.when(n % 4 != 0, note(3)).alias("base_notes"),
        js(F.col("category_id")).alias("local_category"), F.when(n % 2 == 0, F.lit('"BUILDING"')).otherwise(js(F.col("category_id"))).alias("remote_category"), F.when(n % 4 != 0, F.when(n % 3 == 0, F.lit('"BUILDING"')).otherwise(js(F.col("category_id")))).alias("base_category"),
        (n % 11 == 0).alias("local_lock"), (n % 6 == 0).alias("remote_lock"), F.when(n % 4 != 0, F.lit(False)).alias("base_lock"),
        (n % 8 == 1).alias("local_gone"), (n % 9 == 1).alias("remote_gone"),
    )
