"""Merkle manifest of a dataset: digests, proofs and their verification.

A row's leaf is the SHA-256 of its fields, each written so that no two rows have
the same preimage. Leaves of a group ascend by key; every ``ARITY`` consecutive
nodes become one until a group has one node, its subroot, and the subroots are
folded alike into the root.

Rows are numbered within their group by one sort over ranges: a range's rows are
numbered where they lie, and a row for each range and group says how many came
before, so that a group with most of the rows is spread over all tasks. Each level
is a window by group and parent whose full frame, in order, holds the run: its
digests are the parent's preimage, and those of the others are the node's
siblings. The first of a run stands for the parent on the next level, which has
half the rows, so all levels together have twice the leaves. Levels are tables in
the shared folder. On the way back each level joins the path of its parent, so
that a leaf gets its siblings up to the root. Digests are held as 32 bytes and
hashed as hex text.

Defined results: a null field is ``-``, so null and empty texts differ. Null keys
come first, and rows of one key are in the order of their leaves; rows that are
equal in all fields are interchangeable. A null group is a group. An empty table
gives no rows. Further columns are ignored. A text is hashed whole, whatever its
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Nodes of a run.
ARITY = 2
#: Groups that are broadcast at most, with their paths some megabytes.
LISTED = 10_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def shown(d: Column) -> Column:
    """A digest as it is hashed and returned: lower-case hex."""
    return F.lower(F.hex(d))


def framed(value: Column) -> Column:
    """A field in a leaf's preimage: its count of bytes and itself, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(F.concat(*map(framed, fields.values())))


def placed(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """``rows`` with ``gid`` (the group's place among the groups), ``idx`` (the row's
    place in its group) and ``n`` (the group's rows); places from 0. Without a group
    all rows are one."""
    at = F.monotonically_increasing_id()
    rows = rows.withColumn("_g", F.col(group) if group else F.lit(0))
    rows = stored(rows.orderBy("_g", *order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), "placed")
    # A row for each range and group in it.
    parts = rows.groupBy("_part", "_g").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_g")
    parts = parts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_part")) - F.col("_n"), "n": F.sum("_n").over(whole)})
    if group:
        ids = placed(rows.select(F.col("_g").alias("group")).distinct(), None, ["group"]).select(F.col("group").alias("_h"), F.col("idx").alias("gid"))
        parts = parts.join(ids, F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    else:
        parts = parts.withColumn("gid", F.lit(0).cast("bigint"))
    parts = parts.select(F.col("_part").alias("_p"), F.col("_g").alias("_h"), "_first", "_before", "n", "gid")
    joined = rows.join(parts, (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")))
    idx = F.col("_before") + F.col("_at") - F.col("_first")
    return joined.withColumn("idx", idx).drop("_at", "_part", "_p", "_h", "_first", "_before", "_g")


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gid, top) of every group, and ``nodes`` with ``path``: from the bottom up, each
    level's sibling, null where a run has one node.

    ``nodes`` has gid, idx, n and digest; further columns stay. The number of
    levels, one row, comes to the driver.
    """
    most = nodes.agg(F.max("n")).first()[0] or 1
    run = Window.partitionBy("gid", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels, now = [], nodes
    while most > 1:
        runs = now.withColumn("parent", F.call_function("div", F.col("idx"), F.lit(ARITY))).withColumn("run", F.collect_list("digest").over(run))
        alone = F.col("n") == 1  # a group that is done waits for the others as it is
        sibling = F.when(F.size("run") > 1, F.element_at("run", (ARITY - F.col("idx") % ARITY).cast("int")))
        up = F.when(alone, F.col("digest")).otherwise(digest(F.array_join(F.transform("run", shown), "")))
        level = stored(runs.select(*now.columns, "parent", sibling.alias("sibling"), up.alias("up")), "level")
        levels.append(level)
        now = level.where(F.col("idx") % ARITY == 0).select("gid", F.col("parent").alias("idx"), F.call_function("div", F.col("n") + ARITY - 1, F.lit(ARITY)).alias("n"), F.col("up").alias("digest"))
        most = -(-most // ARITY)
    tops = now.select("gid", F.col("digest").alias("top"))
    none = F.array().cast("array<binary>")
    if not levels:
        return tops, nodes.withColumn("path", none)
    paths = None
    for level in reversed(levels):
        if paths is None:
            above, rows = none, level
        else:
            p = paths.select(F.col("gid").alias("_g"), F.col("idx").alias("_i"), F.col("path").alias("_above"))
            above, rows = F.col("_above"), level.join(p, (F.col("gid") == F.col("_g")) & (F.col("parent") == F.col("_i")))
        path = F.when(F.col("n") > 1, F.concat(F.array("sibling"), above)).otherwise(above)
        paths = rows.withColumn("path", path).drop("_g", "_i", "_above", "parent", "sibling", "up")
    return tops, paths


def folded(start: Column, idx: Column, path: Column) -> Column:
    """The digest that a node at ``idx`` and its siblings lead to."""

    def step(state: Column, sibling: Column) -> Column:
        one, other = shown(state["d"]), shown(sibling)
        whole = F.when(sibling.isNull(), one).when(state["i"] % ARITY == 0, F.concat(one, other)).otherwise(F.concat(other, one))
        return F.struct(digest(whole).alias("d"), F.call_function("div", state["i"], F.lit(ARITY)).alias("i"))

    return F.aggregate(path, F.struct(start.alias("d"), idx.alias("i")), step)["d"]


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path and group_path (siblings up to the subroot
    and from there to the root), proof_sha256, folded_root and verified for every row of
    ``docs(doc_id, source, lang, n_chars, text)``.

    ``tampered`` says which rows are verified with n_chars one more than recorded;
    their leaf is computed anew and held against the recorded siblings.
    """
    fields = {c: F.col(c) for c in FIELDS}
    other = leaf_of(fields | {"n_chars": F.col("n_chars") + 1})
    seen = F.when(tampered & F.col("n_chars").isNotNull(), other) if tampered is not None else F.lit(None).cast("binary")
    leaves = stored(docs.select("doc_id", "lang", leaf_of(fields).alias("digest"), seen.alias("seen")), "leaves")
    tops, rows = tree(placed(leaves, "lang", ["doc_id", "digest"]).drop("lang"))
    subroots = stored(tops.select("gid", F.lit(0).alias("_one"), F.col("top").alias("digest")), "subroots")
    root, groups = tree(placed(subroots.withColumnRenamed("gid", "g"), None, ["g"]).drop("_one"))
    groups = groups.join(root.withColumnRenamed("gid", "_r"), F.col("gid") == F.col("_r")).select(
        F.col("g"), F.col("idx").alias("g_idx"), F.col("digest").alias("subroot"), F.col("path").alias("group_path"), F.col("top").alias("root")
    )
    # Beyond that a shuffle by group, whose large partitions Spark splits.
    few = subroots.limit(LISTED + 1).count() <= LISTED
    rows = rows.join(F.broadcast(groups) if few else groups, F.col("gid") == F.col("g"))
    siblings = F.filter(F.concat("path", "group_path"), lambda x: x.isNotNull())
    to_subroot = folded(F.coalesce("seen", "digest"), F.col("idx"), F.col("path"))
    rows = rows.withColumns({"proof_sha256": F.sha2(F.array_join(F.transform(siblings, shown), ""), 256), "_sub": to_subroot})
    rows = rows.withColumn("_root", folded(F.col("_sub"), F.col("g_idx"), F.col("group_path")))
    return rows.select(
        "doc_id", shown(F.col("digest")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"), "path", "group_path",
        "proof_sha256", shown(F.col("_root")).alias("folded_root"), (F.col("_root") == F.col("root")).alias("verified"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; every seventh, by its id's CRC-32, is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), F.coalesce(tampered, F.lit(False))).drop("path", "group_path")


SQL11 = """WITH RECURSIVE steps AS (SELECT range AS i, range AS v, 0 AS k FROM range(256) UNION ALL
 SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT i, v FROM steps WHERE k = 8
), crcs AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS pos, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) UNION ALL
 SELECT doc_id, s, pos + 1, xor(crcs.c // 256, t.v) FROM crcs JOIN crc_table t ON t.i = xor(crcs.c % 256, CAST(ascii(substr(s, pos, 1)) AS BIGINT)) WHERE pos <= length(s)
), crc AS (SELECT doc_id, xor(c, 4294967295) AS c FROM crcs WHERE pos = length(s) + 1
), fields AS (SELECT d.doc_id, lang, n_chars, coalesce(crc.c % 7 = 0, false) AS bad,
  coalesce(length(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id
), digests AS (SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN bad AND n_chars IS NOT NULL THEN sha256(head || length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS seen FROM fields
), leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS gid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
  count(*) OVER (PARTITION BY lang) AS n, leaf, seen FROM digests
), lv AS (SELECT 0 AS k, gid, idx, n, leaf AS d FROM leaves UNION ALL
 SELECT k + 1, gid, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM lv WHERE n > 1 GROUP BY k, gid, idx // 2, n
), subroots AS (SELECT gid, d FROM lv WHERE n = 1
), gv AS (SELECT 0 AS k, gid AS idx, (SELECT count(*) FROM subroots) AS n, d FROM subroots UNION ALL
 SELECT k + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM gv WHERE n > 1 GROUP BY k, idx // 2, n
), walk AS (SELECT gid, idx AS leaf_idx, 0 AS k, idx, n, coalesce(seen, leaf) AS cur, '' AS proof FROM leaves UNION ALL
 SELECT w.gid, w.leaf_idx, w.k + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN s.d IS NULL THEN w.cur WHEN w.idx % 2 = 0 THEN w.cur || s.d ELSE s.d || w.cur END), w.proof || coalesce(s.d, '')
 FROM walk w LEFT JOIN lv s ON s.k = w.k AND s.gid = w.gid AND s.idx = w.idx + 1 - 2 * (w.idx % 2) WHERE w.n > 1
), up AS (SELECT gid, leaf_idx, 0 AS k, gid AS idx, (SELECT count(*) FROM subroots) AS n, cur, proof FROM walk WHERE n = 1 UNION ALL
 SELECT w.gid, w.leaf_idx, w.k + 1, w.idx // 2, (w.n + 1) // 2, sha256(CASE WHEN s.d IS NULL THEN w.cur WHEN w.idx % 2 = 0 THEN w.cur || s.d ELSE s.d || w.cur END), w.proof || coalesce(s.d, '')
 FROM up w LEFT JOIN gv s ON s.k = w.k AND s.idx = w.idx + 1 - 2 * (w.idx % 2) WHERE w.n > 1
) SELECT l.doc_id, l.leaf, r.d AS subroot, g.d AS root, sha256(u.proof) AS proof_sha256, u.cur AS folded_root, u.cur = g.d AS verified
 FROM leaves l JOIN up u ON u.gid = l.gid AND u.leaf_idx = l.idx AND u.n = 1 JOIN subroots r ON r.gid = l.gid JOIN (SELECT d FROM gv WHERE n = 1) g ON true"""
