"""The Merkle manifest, the clusters and the quality rules against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywake.llm import centroids, merkle, rules

SF = "/root/testdata/sf0.001"
ROW = "doc_id long, source string, lang string, n_chars long, text string, idx long, n int, digest string, gid int, path string, up string, _g string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    i, source, lang, n, text = row
    values = [i, source, lang, n if n is None else n + more, text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def walk(tree, k, cur, proof):
    for level in tree[:-1]:
        run = level[k // 2 * 2 : k // 2 * 2 + 2]
        others = [d for j, d in enumerate(run) if j != k % 2]
        proof += others
        cur = h(*([cur] if not others else [cur, others[0]] if k % 2 == 0 else [others[0], cur]))
        k //= 2
    return cur


def brute(rows, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            proof = []
            bad = r[3] is not None and tampered(r)
            cur = walk(top, j, walk(trees[g], k, leaf(r, int(bad)), proof), proof)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*proof), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "p", "u", "g") for r in rows], ROW)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [1, 1], [5, 1, 8], [7, 16, 33, 2, 1]])
def test_manifest_against_brute_force(spark, sizes):
    langs = [None, "", "de", "é", "z"]
    rows = [(100 * g + k if k % 9 else None, None if k % 4 == 0 else "s", langs[g], None if k % 5 == 0 else k, None if k % 3 == 0 else "" if k % 3 == 1 else "ä" * k) for g, n in enumerate(sizes) for k in range(n)]
    rows += [rows[-1]] * 2  # repeated rows
    tampered = F.coalesce(F.col("doc_id") % 2 == 1, F.lit(False))
    got = merkle.manifest(made(spark, rows).repartition(5), tampered)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == brute(rows, lambda r: r[0] is not None and r[0] % 2 == 1)


@pytest.mark.parametrize("listed", [merkle.LISTED, 1])
def test_manifest_of_one_large_group_and_of_nothing(spark, monkeypatch, listed):
    """A group that is spread over partitions, with gaps between keys; a very long text;
    with groups that are broadcast and others."""
    monkeypatch.setattr(merkle, "LISTED", listed)
    rows = [(k * k, "s", "en" if k % 50 else "fr", k, "w") for k in range(700)] + [(5, "s", "en", 1, "long " * 100_000)]
    got = merkle.manifest(made(spark, rows).repartition(7)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str) == brute(rows, lambda r: False)
    assert len({len(r.path) for r in got}) == 2
    assert merkle.manifest(made(spark, [])).count() == 0


def test_placed_numbers_groups_over_partitions(spark):
    df = spark.range(4000).selectExpr("id as k", "if(id % 3 = 0, null, id % 2) as g").repartition(11)
    got = merkle.placed(df, "g", ["k"]).collect()
    seen = defaultdict(list)
    for r in got:
        seen[r.g].append((r.idx, r.k, r.n, r.gid))
    assert [seen[g][0][3] for g in (None, 0, 1)] == [0, 1, 2]
    for rows in seen.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1] for r in rows] == sorted(r[1] for r in rows) and {r[2] for r in rows} == {len(rows)}


def lloyd(rows, k, rounds):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-centroids.LARGEST, min(centroids.LARGEST, x)) for x in v]) for i, v in kept]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda v: min((far(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(x) for x in zip(*of[j])] if j in of else w for j, w in enumerate(c)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    each = Counter()
    for _, j, d in found:
        each[j] += d
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, j, d, each[j], sum(each.values()), sha[j]) for i, j, d in found), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", [1]) for i, v in rows], "vec_id long, embedding array<float>, label int, w int, cluster string, q array<int>")


def clustered(df, **more):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **more).collect()), key=str)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    some = [(k, (rng.normal(size=64) * 0.3 + k % 7).astype(np.float32).tolist()) for k in range(300)]
    same = [(1000 + k, some[0][1]) for k in range(400)]  # most rows are one vector
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64), (2006, [0.0] * 64), (2007, [-0.004] * 64), (None, some[5][1]), (5, some[9][1])]
    rows = some + same + odd
    assert clustered(vectors(spark, rows).repartition(6)) == lloyd(rows, 16, 3)
    # Clusters that lose all their vectors stay where they are.
    few = [(k, [float(k // 3)] * 64) for k in range(9)]
    assert clustered(vectors(spark, few)) == lloyd(few, 16, 3)
    assert clustered(vectors(spark, few), k=2, rounds=1) == lloyd(few, 2, 1)
    assert centroids.cluster(vectors(spark, odd[:6])).count() == 0 and centroids.cluster(vectors(spark, [])).count() == 0


def test_components_beyond_the_bound_do_not_overflow(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    assert clustered(vectors(spark, rows), k=2, rounds=1) == lloyd(rows, 2, 1)


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    again = {i + k for starts in at.values() if len(starts) > 1 for i in starts for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_rules_count_as_plain_python(spark, docs, empty):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\t ", "a b c d e f g h " * 3, "a b c d e f g a b c d e f g", "x\ny\nx\n x\n\n\nx", "é ü b\x1c c\x85d", "#*$ %&|<> €", "w " * 50_000, "one\r\none\r\ntwo\x0bthree"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in rules.judged(df, None).collect()}
    for k, t in enumerate(texts):
        n = counted(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, k
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and r.kept == (not r.base_failed) and r.score is None
    assert rules.judged(docs, None).count() == docs.count() and rules.judged(empty, None).count() == 0


def test_windows_do_not_cross_texts():
    a = [b"a b c d e f g h", b"a b c d e f g h", b"h a b c d e f g h a b c d e f g h"]
    doc, word, _ = rules.numbered(a)
    assert np.bincount(doc[rules.repeated(doc, word)], minlength=3).tolist() == [0, 0, 17]


def test_slices_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(rules, "SLICE", 10)
    assert [len(s) for s in rules.slices([b"12345", b"12345", b"1", b"x" * 30, b"", b"1"])] == [2, 1, 1, 2]
    # A long text is hashed in pieces: the same n-grams as at once.
    text = [b"some longer text in pieces"]
    grams = lambda: sorted((k, f) for k, _, fs in rules.grams(text, *rules.numbered(text)) for f in fs.tolist())
    small = grams()
    monkeypatch.setattr(rules, "SLICE", 1 << 20)
    assert small == grams() and sum(k == 0 for k, _ in small) == sum(len(text[0]) - n + 1 for n in rules.BYTE_GRAMS)


def test_scorer_on_labels_it_has_not_seen(spark):
    """Fitted on three quarters of the labelled rows; the rest decides."""
    sf = "/root/testdata/sf0.01"
    table = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    rows = [(r.doc_id, r.text, r.good) for r in rules.sample(table("documents"), table("labels")).collect()]
    test = [r for r in rows if zlib.crc32(b"t%d" % r[0]) % 4 == 0]
    model = rules.trained([r for r in rows if r not in test])
    df = spark.createDataFrame([(i, t) for i, t, _ in test], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.judged(df, model).collect()}
    right = [(got[i].score >= 0.5) == good for i, _, good in test if not got[i].base_failed]
    assert len(right) > 60 and sum(right) >= 0.95 * len(right)
    assert all(0 <= r.score <= 1 for r in got.values())
    # As sharp as it is sure: the mean score is near the share of good ones.
    assert abs(np.mean([got[i].score for i, _, _ in test]) - np.mean([g for *_, g in test])) < 0.1
    # All weights do the same in a task and in the features that they were fitted on.
    texts = [t.encode() for _, t, _ in test[:20]]
    one = [float(model[0][-1] + v @ model[0][a]) for a, v in rules.features(texts)]
    assert np.allclose(one, rules.scores(texts, *rules.numbered(texts), model[0]), atol=1e-4)


def test_sample_and_labels_of_one_kind(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (8, None), (99, 1), (7, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.good for r in rules.sample(docs, labels).collect()}
    assert got == {4: True, 5: False, 7: True}
    assert rules.sample(docs, labels, size=1).count() == 1 and rules.sample(docs, labels.limit(0)).count() == 0 and rules.sample(empty, labels).count() == 0
    assert rules.trained([]) is None and rules.trained([(k, "some text", True) for k in range(9)]) is None


def test_queries(spark):
    from tallywake.llm import queries

    for name, table in (("op11_merkle", "documents"), ("op12_centroids", "embeddings"), ("op13_rules", "documents")):
        assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    r = queries.QUERIES["op11_merkle"](spark, SF).groupBy("verified").count().collect()
    assert {x.verified for x in r} == {True, False}
