"""Every registered query on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallywake.llm import decontam, lines, pieces, queries

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    shown = lambda rows: sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert shown(tuple(r[c] for c in cols) for r in df.collect()) == shown(c.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["op2_quality", "op6_simhash", "op8_lm", "op9_lines", "op10_pieces"])
def test_a_row_for_each_document(spark, name):
    docs = read(spark, "documents")
    got = queries.QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_lm_base_score(spark):
    """Counts and base score against SQL."""
    sql = f"""WITH d AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+') AS w FROM '{SF}/documents.parquet'),
     t AS (SELECT doc_id, unnest(list_append(list_filter(w, lambda x: x <> ''), chr(10))) AS token FROM d) SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2"""
    rows = duckdb.sql(sql).fetchall()
    import math
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = {}
    for i, w, n in rows:
        if not held(i):
            count[w] = count.get(w, 0) + n
    total, words = sum(count.values()), len(count)
    want = {}
    for i, w, n in rows:
        a = want.setdefault(i, [0, 0, 0.0])
        a[0] += n
        a[1] += n * (w in count)
        a[2] += n * math.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (words + 1)))
    for r in queries.QUERIES["op8_lm"](spark, SF).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), *want[r.doc_id][:2], total)
        assert abs(r.base_score - want[r.doc_id][2]) < 1e-6 * max(1, abs(r.base_score))


def test_pipeline(spark):
    """Each stage is judged on what the one before it kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, kept = read(spark, "documents"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{pipeline.work_dir(spark, 'test')}"
        out.write.parquet(path)
        kept.append((docs, spark.read.parquet(path)))
        docs = kept[-1][1]
    for before, after in kept[:-1]:
        assert after.columns == read(spark, "documents").columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
    # Quality: nothing is changed, something is kept and something goes.
    before, after = kept[0]
    assert 0 < after.count() < before.count() and after.exceptAll(before).count() == 0
    # Lines: no line is left twice, and none is new.
    before, after = kept[1]
    lines_of = lambda df: [r.norm for r in lines.with_lines(df).select("norm").collect()]
    was, now = lines_of(before), lines_of(after)
    assert len(now) == len(set(now)) and set(now) <= set(was) and len(set(now)) > 0.5 * len(set(was))
    # Near duplicates by brute force over shingles of five words.
    from tallywake.llm import simhash

    before, after = kept[2]
    sets = {r.doc_id: set(simhash.digests(r.text, 5).tolist()) for r in before.collect()}
    left = sorted(r.doc_id for r in after.collect())
    near = [(a, b) for k, a in enumerate(left) for b in left[k + 1 :] if sets[a] and 1000 * len(sets[a] & sets[b]) >= 800 * len(sets[a] | sets[b])]
    assert not near
    for i in set(sets) - set(left):
        assert any(1000 * len(sets[i] & s) >= 800 * len(sets[i] | s) for j, s in sets.items() if j != i)
    # Decontamination: what goes has a benchmark item's words, in order, in one place.
    before, after = kept[3]
    items = [decontam.tokens(r.text) for r in read(spark, "benchmark").collect()]
    for r in before.join(after, "doc_id", "left_anti").collect():
        words = decontam.tokens(r.text)
        assert max(decontam.lcs_length(m, words) / len(m) for m in items if m) >= decontam.LCS_WITH_ANSWER
    # Pieces: those of the library.
    before, after = kept[4]
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts) and all(list(r.ids) == m.encode(texts[r.doc_id] or "") and r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    assert after.where(F.col("ids").isNull()).count() == 0
