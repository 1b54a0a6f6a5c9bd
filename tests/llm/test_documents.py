"""Operators on documents: odd rows, empty tables, and brute force."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallywake.llm import common, decontam, licenses, lines, lm, pieces, quality, simhash


def test_fingerprints_and_components(spark, docs, empty):
    import xxhash

    def brute(text):
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = Counter((r.doc_id, np.uint64(brute(r.text)).astype(np.int64).item()) for r in docs.collect())
    assert Counter((r.doc_id, r.fp) for r in got) == want
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 7}


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    flips = np.zeros(4000, np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    codes = simhash.golay_keys()
    pairs = [set(zip(*(a.tolist() for a in simhash.keys_of(v, *codes)))) for v in (x, x ^ flips)]
    assert {r for r, _ in pairs[0] & pairs[1]} == set(range(4000))


def test_blocks_lose_no_link(spark):
    """A bucket far larger than a block gives the components of all pairs."""
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(0, 40)})
    df = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(),) for f in fps], "fp long")
    comps = common.components(simhash.fingerprint_links(df, run=16)).collect()
    assert len({r.component for r in comps}) == 1 and len(comps) == len(fps)


def test_stage_removes_near_copies(spark, empty):
    """Planted copies of shingle similarity 0.8 to 1; those below 0.8 stay."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near, far = [], set(), set()
    for edits in [1, 2, 4, 6, 8, 14] * 25:
        a = [word() for _ in range(300)]
        changed = set(rng.choice(300, edits, replace=False).tolist())
        b = [word() if k in changed else x for k, x in enumerate(a)]
        share = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
        (near if share >= 0.8 else far).add(len(rows) + 1)
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    kept = {r.doc_id for r in simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(near) > 50 and len(far) > 10
    assert len(near - kept) >= 0.99 * len(near) and far <= kept and kept >= set(range(0, len(rows), 2))
    assert simhash.stage(spark, empty, "").count() == 0


def test_licenses(docs, empty):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(docs).collect()}
    assert got[1, 0].labels == "" and got[1, 0].score == 0.0
    r = next(r for (i, _), r in got.items() if i == 8)
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (3, 1, 8, "cc-by,mit")
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_lines(spark, docs, empty):
    out = lines.dedup_lines(docs)
    assert out.count() == docs.count() and lines.dedup_lines(empty).count() == 0
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id in (1, 2, 9)}
    assert texts == {1: None, 2: "", 9: "x\n\ny"}
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    near = [" ".join(words), " ".join(words[:-1] + ["upsilom"]), "nothing alike is written in this one at all"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(near)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert kept[0] == near[0] and kept[2] == near[2] and kept[1] == ""
    assert lines.stage(spark, docs, "").columns == docs.columns


def test_lines_alike_are_found(spark):
    """Lines of 6 to 60 words with one word or letter, and with a seventh of their
    words, replaced: found if 0.8 alike, and no other line goes."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), int(rng.integers(2, 9))))
    rows, near, kind = [], set(), {}
    for n in [6, 8, 12, 20, 30, 60] * 20:
        a = [word() for _ in range(n)]
        for how in ("word", "letter", "seventh"):
            b = list(a)
            for k in rng.choice(n, 1 if how != "seventh" else max(1, n // 7), replace=False):
                b[k] = word() if how != "letter" else b[k][:-1] + ("z" if b[k][-1] != "z" else "y")
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
            x, y = rows[-2][1], rows[-1][1]
            if 1 - edit_distance(x, y) / max(len(x), len(y)) >= 0.8:
                near.add(len(rows) - 1)
                kind[len(rows) - 1] = (how, n)
            a = [word() for _ in range(n)]
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text = ''").collect()}
    assert got <= near and len(near) > 250
    assert len(got) >= 0.95 * len(near)
    for how in ("word", "letter", "seventh"):
        some = {i for i in near if kind[i][0] == how}
        assert len(some & got) >= 0.9 * len(some), how


def test_long_lines_alike(spark):
    """Very long lines: shifted by what was put in, changed all over, and others."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrst"), 6))
    a = [word() for _ in range(4000)]
    put_in = a[:1500] + [word() for _ in range(200)] + a[1500:]
    changed = [word() if rng.random() < 0.1 else w for w in a]
    other = [word() for _ in range(4000)]
    half = [word() if rng.random() < 0.5 else w for w in a]
    rows = [(k, " ".join(w)) for k, w in enumerate((a, put_in, changed, other, half))]
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text = ''").collect()}
    assert got == {1, 2}


def test_alike_is_edit_similarity(spark):
    """The bounds against the whole distance, on pairs on both sides of 0.8."""
    rng = np.random.default_rng(7)
    rows = []
    for n in [1, 3, 10, 40, 120, 300] * 12:
        a = [str(rng.integers(10, 10 ** int(rng.integers(2, 9)))) for _ in range(n)]
        b = [w if rng.random() > rng.choice([0.02, 0.2, 0.3]) else str(rng.integers(10, 10**6)) for w in a]
        if rng.random() < 0.4:
            b.insert(int(rng.integers(0, n + 1)), "inserted words")
        rows.append((len(rows), len(rows), " ".join(a), " ".join(b)))
    got = {r.a for r in lines.alike(spark.createDataFrame(rows, "a long, b long, s string, t string"), 0.8).collect()}
    want = {i for i, _, x, y in rows if edit_distance(x, y) <= max(len(x), len(y)) * 200 // 1000}
    assert got == want and 10 < len(want) < len(rows) - 10


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_of_edit_similarity_are_found(spark):
    """Against brute-force edit similarity: changed words, changed letters."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    rows, want = [], {}
    for kind, n_words, edits in (("word", 12, 1), ("word", 20, 1), ("word", 20, 2), ("word", 20, 4), ("letter", 12, 1), ("letter", 20, 5), ("letter", 3, 2), ("letter", 1, 1)):
        for _ in range(60):
            a = [word() for _ in range(n_words)]
            b = list(a)
            for k in rng.choice(n_words, edits, replace=kind == "letter"):
                at = rng.integers(len(b[k]))
                b[k] = word() if kind == "word" else b[k][:at] + "z" + b[k][at + 1 :]
            a, b = " ".join(a), " ".join(b)
            if a != b and 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.8:
                want[len(rows) + 1] = (kind, n_words, edits)
                rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in set(want.values()):
        ids = [i for i, k in want.items() if k == kind]
        assert sum(got[i] == "" for i in ids) >= 0.9 * len(ids), kind


def test_scores(docs, empty):
    held = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False)))
    got = lm.score(held, block_words=1000).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"], r.held_out) for r in held.collect()]
    c, pair = Counter(), Counter()
    for _, t, h in rows:
        if not h:
            c.update(t)
            pair.update(zip([b"\r"] + t, t))
    n, v, texts = sum(c.values()), len(c), sum(not h for *_, h in rows)
    want = []
    for i, t, h in rows:
        base = full = 0.0
        for b, w in zip([b"\r"] + t, t):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            full += math.log10((pair[b, w] + lm.MU * p) / ((texts if b == b"\r" else c[b]) + lm.MU))
        want.append((str(i), h, len(t), sum(c[w] > 0 for w in t), n, round(base, 4), round(full, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got) == sorted(want)
    assert lm.score(empty.withColumn("held_out", F.lit(False))).count() == 0


def test_pieces_are_the_library_s(docs, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    extra = [(20, "Héllo  wörld\nabc ۞ "), (21, " " * 37 + "x"), (22, "ab" * 200 + "۞"), (23, "日本語 text ▁ sign")]
    more = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    got = pieces.encode(more).collect()
    want = Counter((r.doc_id, tuple(m.encode(r.text or ""))) for r in more.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert {r.doc_id for r in got if not r.round_trip} == {23}
    assert pieces.encode(empty).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(more)).collect()}
    assert back[20] == "Héllo  wörld\nabc ۞ "


def test_quality(spark, docs, empty):
    good = [f"The {a} of the {b} is in the house and it was not for them, but {c} had to be there with all of us." for a in ("cat", "king", "tree") for b in ("hill", "sea", "town", "road") for c in ("she", "he", "they", "we")]
    junk = ["BUY!! NOW!! " + x.upper().replace(" ", "!! ") for x in good[:16]] + [f"{w} " * 40 for w in ("spam", "rate", "wins", "link")]
    texts = [(i, t) for i, t in enumerate(good + junk)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i, _ in texts[::3]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(df, labels).collect()}
    right = sum(got[i] == (i < len(good)) for i, _ in texts)
    assert right >= 0.9 * len(texts)
    odd = quality.classify(docs).collect()
    assert len(odd) == docs.count() and not any(r.kept for r in odd if r.doc_id in (1, 2, 3))
    assert quality.classify(empty).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    votes = [np.where(rng.random(20000) < p, truth, ~truth) for p in (0.9, 0.8, 0.7)]
    patterns = Counter("".join("+" if v else "-" for v in x) for x in zip(*votes))
    share, rate = quality.expect_maximise(patterns, 500)
    assert abs(share - 0.7) < 0.05 and all(abs(rate[k, 0, 0] - p) < 0.06 for k, p in enumerate((0.9, 0.8, 0.7)))


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((15, 30, 55))]
    filler = lambda n: " ".join(word() for _ in range(n))
    para = items[1][1].split()
    for k in (3, 9, 15, 21):
        para[k] = word()
    texts = [(100 + k, f"{filler(50)} {t} {filler(70)}") for k, t in items] + [(200, f"{filler(30)} {' '.join(para)} {filler(30)}"), (300, filler(400))]
    df = spark.createDataFrame(texts, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame([*items, (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.retrieve(df, bench).where("contaminated").collect()}
    assert got == {(100, 0), (101, 1), (102, 2), (200, 1)}
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} >= {300, 1, 2}
    assert decontam.retrieve(docs.limit(0), bench).count() == 0 and decontam.retrieve(docs, bench.limit(0)).count() == 0
    assert decontam.lcs_length([b"a", b"b", b"c", b"d"], [b"a", b"x", b"c", b"d"]) == 3


def planted(spark, n_items, length, keep=1.0, around=120, seed=5):
    """Items of rare words, and documents with each: the answer whole, of the words
    before it only the share ``keep``, in order."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [[word() for _ in range(length)] for _ in range(n_items)]
    docs = []
    for k, item in enumerate(items):
        head = length - max(2, length // 4)
        lost = set(rng.choice(max(1, head), round((1 - keep) * head), replace=False).tolist())
        text = [word() if i in lost else w for i, w in enumerate(item)]
        docs.append((k, " ".join([word() for _ in range(around)] + text + [word() for _ in range(around)])))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")


def caught(docs, bench):
    return sum(r.doc_id == r.item_id for r in decontam.retrieve(docs, bench).where("contaminated").select("doc_id", "item_id").distinct().collect())


def test_confirmed_paraphrases_are_candidates(spark):
    assert caught(*planted(spark, 60, 12, 1 / 3)) == 60


def test_copies_of_many_items_are_found(spark):
    assert caught(*planted(spark, 3000, 14, around=60)) == 3000


def test_items_of_any_length_are_found(spark):
    for length in (4, 600, 1200):
        assert caught(*planted(spark, 30, length)) == 30, length
    rows = [(0, "zz " * 40 + "alpha other gamma delta" + " yy" * 40)]
    short = spark.createDataFrame([(0, "alpha beta gamma delta")], "item_id long, text string")
    assert caught(spark.createDataFrame(rows, "doc_id long, text string"), short) == 1


def test_crc_is_the_contract_s(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string").cast("binary")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)


def test_pairs_of_buckets_are_met_once(spark):
    """Each pair of two components that shares buckets is met in one of them, also in
    blocks, and the pairs are not written anywhere."""
    from tallywake.llm import lines

    buckets = {1: range(0, 30), 2: range(10, 40), 3: range(25, 50), 4: [3, 60]}
    c = {h: h // 3 * 3 for b in buckets.values() for h in b}
    kept = spark.createDataFrame([(k, h, c[h], c[min(b)]) for k, b in buckets.items() for h in b], "key long, h long, c long, top long")
    facts = spark.createDataFrame([(h, 0, 50 + (h == 60) * 50, f"t{h}") for h in c], "h long, fp long, len int, text string")
    tried = spark.createDataFrame([(20, 10), (5, 0)], "a long, b long")
    want = {(min(x, y), max(x, y)) for b in buckets.values() for x in b for y in b if c[x] != c[y] and 60 not in (x, y)} - {(10, 20), (0, 5)}
    for run in (4, 256):
        met = lines.met_once(kept, facts, tried, 0.8, run)
        assert met._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [a") == 0
        got = [(min(r.a, r.b), max(r.a, r.b)) for r in met.collect()]
        assert len(got) == len(want) and set(got) == want
        assert all((r.s, r.t) == (f"t{r.a}", f"t{r.b}") for r in met.collect())


def test_lengths_of_windows_with_recurring_words():
    """All windows at once, the last one cut short, as one by one."""
    rng = np.random.default_rng(3)
    index = decontam.Index.__new__(decontam.Index)
    index.idf = rng.random(decontam.WIDTH).astype(np.float32)
    part = rng.integers(0, 12, 200).astype(np.uint16)
    begin = np.array([0, 8, 160, 184, 192])
    for length in decontam.WINDOWS:
        got = index.lengths(part, begin, length)
        for a, x in zip(begin, got):
            f, n = np.unique(part[a : a + length], return_counts=True)
            assert abs(x - np.sqrt(((n * index.idf[f].astype(float)) ** 2).sum())) < 1e-6


def test_stage_finds_close_fingerprints_by_golay_keys(spark, monkeypatch):
    """Without any smallest shingle, as ``op6_simhash`` finds them."""
    monkeypatch.setattr(simhash, "MINIMA", 0)
    rng = np.random.default_rng(12)
    rows = []
    for k in range(40):
        a = ["".join(x) for x in rng.choice(list("abcdefghij"), (2000, 6))]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join([*a[:k], "changed", *a[k + 1 :]]))]
    fp = [simhash.fingerprint(t, simhash.STAGE_WIDTH) for _, t in rows]
    close = {2 * k + 1 for k in range(40) if (fp[2 * k] ^ fp[2 * k + 1]).bit_count() <= simhash.DISTANCE}
    kept = {r.doc_id for r in simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(close) > 20 and not close & kept and kept >= set(range(0, 80, 2))


def test_texts_without_an_item_s_words_cost_one_look(monkeypatch):
    item = " ".join(f"topic{i}" for i in range(30))
    f, v = np.unique(decontam.Hasher()(decontam.plain(item))).astype(np.int64), None
    v = np.ones((len(f), 1)) / np.sqrt(len(f))
    index = decontam.Index([(1, item)], np.ones(decontam.WIDTH), f, v)
    text = " ".join(f"topic{i % 9}" for i in range(2000))
    found = [*index.candidates(decontam.Hasher()(decontam.plain(text)), decontam.COSINE)]
    assert len(found) > 100
    # Sums of steps, the last of them short, against each word by itself.
    for _, start, length, cosine in found:
        at, value = decontam.passage(" ".join(text.split()[start : start + length]), np.ones(decontam.WIDTH))
        assert abs(cosine - value.sum() / np.sqrt(len(f))) < 1e-4
    sets = []
    monkeypatch.setattr(decontam, "set", lambda x: sets.append(1) or set(x), raising=False)
    assert index.matches(text, decontam.Hasher(), decontam.COSINE) == {} and len(sets) == 1


def test_scratch_tables_go_when_they_are_read(spark):
    """Of the line and near-dedup stages only what the result reads is left, so that the
    pipeline's later stages do not carry it."""
    import os

    from tallywake.llm import lines
    from tallywake.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    rows = [(k, "\n".join(f"some words of line {j} that many texts share {k % 3}" for j in range(9))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (lines.stage, simhash.stage):
        before = set(os.listdir(folder))
        assert stage(spark, docs, "").count() > 0
        left = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
        assert not left & {"lines", "buckets", "texts", "facts", "named", "kept"}


def test_words_are_coded_only_where_few_are_missing(spark):
    """What the cheaper test lets through still decides as edit distance does."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    rows, want = [], set()
    for k in range(120):
        s = [word() for _ in range(80)]
        t = [word() if rng.random() < k / 300 else x for x in s]
        s, t = " ".join(s), " ".join(t[(k % 4) * 3 :])
        p = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            q = [i]
            for j, y in enumerate(t, 1):
                q.append(min(p[j] + 1, q[j - 1] + 1, p[j - 1] + (x != y)))
            p = q
        rows.append((k, -k - 1, s, t))
        if 1000 * p[-1] <= 200 * max(len(s), len(t)):
            want.add(k)
    from tallywake.llm import lines

    found = lines.alike(spark.createDataFrame(rows, "a long, b long, s string, t string"), 0.8)
    assert {r.a for r in found.collect()} == want and 10 < len(want) < 110
    assert "array_except" in found._jdf.queryExecution().optimizedPlan().toString()


def test_texts_go_only_to_lines_with_a_pair(spark):
    """Of a bucket's lines those whose marks allow no link with another are told apart
    without their texts."""
    fps = [sum(((h & k).bit_count() & 1) << k for k in range(63)) for h in range(60)]  # 31 bits apart or more
    near = {40: 41, 50: 52}
    for a, b in near.items():
        fps[b] = fps[a] ^ 5
    keys = spark.createDataFrame([(h, k) for h in range(60) for k in (1, 2)], "h long, key long")
    marks = spark.createDataFrame([(h, f, 100) for h, f in enumerate(fps)], "h long, fp long, len int")
    texts = spark.createDataFrame([(h, f"{h if h not in near.values() else [a for a in near if near[a] == h][0]}") for h in range(60)], "h long, text string")
    asked = set()

    def texts_of(hashes):
        asked.update(r.h for r in hashes.collect())
        return texts

    alike = lambda pairs, least: pairs.where("s = t").select("a", "b")
    found = lines.line_links(keys, lambda hashes: marks, texts_of, 0.8, alike).collect()
    assert {(r.node, r.component) for r in found} == {(40, 40), (41, 40), (50, 50), (52, 50)}
    assert asked == {40, 41, 50, 52}


def test_maps_of_shingles_leave_out_no_alike_texts(spark):
    rng = np.random.default_rng(4)
    rows = []

    def marks(x):
        held = np.zeros(256, np.uint8)
        held[(x >> np.uint64(32)) % np.uint64(256)] = 1
        return [len(x), *np.packbits(held).view(np.int64).tolist()]

    for k in range(400):
        x = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        y = np.unique(np.concatenate((x[: max(1, int(len(x) * (k % 20) / 19))], rng.integers(0, 1 << 63, len(x) // 10, dtype=np.uint64))))
        if k % 2:  # another text of that length
            y = np.unique(rng.integers(0, 1 << 63, len(x), dtype=np.uint64))
        both = len(np.intersect1d(x, y))
        rows.append((1000 * both >= 800 * (len(x) + len(y) - both), 0, 0, *marks(x), *marks(y)))
    columns = [f"{c}_{k}" for k in "ab" for c in ("len", *simhash.MAP)]
    df = spark.createDataFrame(rows, "alike boolean, fp_a long, fp_b long, " + ", ".join(f"{c} {'int' if c[:3] == 'len' else 'long'}" for c in columns))
    got = df.select("alike", simhash.may_be_alike(0.8).alias("may"), lines.may_link(0.8).alias("near")).collect()
    assert all(r.may for r in got if r.alike) and sum(r.alike for r in got) > 10
    # Left out are most that are not alike and that lengths let through.
    assert sum(r.near and not r.alike for r in got) > 2 * sum(r.may and not r.alike for r in got)


def test_components_of_stars_take_no_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: cuts.append(1) or cut(df))
    edges = spark.createDataFrame([(k, k % 7) for k in range(7, 60)] + [(3, 3), (60, 0), (60, 0)], "a long, b long")
    found = {r.node: r.component for r in common.components(edges).collect()}
    assert found == {k: k % 7 for k in range(60)} | {60: 0} and len(cuts) == 1


def test_keys_are_grouped_in_parts_and_gone_before_texts_are_written(spark, monkeypatch):
    """Of the tables of the line stage those with keys do not stay on disk."""
    docs = spark.createDataFrame([(k, "\n".join(f"line {i} of some words that repeat in few other documents {i * 7 % 31}" for i in range(k, k + 5))) for k in range(20)], "doc_id long, text string")
    held, at, stored, drop = {}, [], lines.stored, lines.drop

    def writes(df, what="table"):
        at.append((what, sorted(held.values())))
        out = stored(df, what)
        held[id(out)] = what
        return out

    def drops(*tables):
        for t in tables:
            held.pop(id(t))
        drop(*tables)

    monkeypatch.setattr(lines, "stored", writes)
    monkeypatch.setattr(lines, "drop", drops)
    lines.removed_lines(docs).collect()
    assert [x for x, _ in at[: lines.PASSES + 2]] == ["keys", *["buckets"] * lines.PASSES, "texts"]
    assert dict(at)["texts"] == ["buckets"] * lines.PASSES and sorted(held.values()) == ["places"]


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    def files():
        return {f.getName() for f in map(lambda k: found.apply(k), range(found.size()))} if (found := spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) else set()

    shuffled = lambda: spark.range(1000).selectExpr("id % 97 as k").repartition(4, "k").groupBy("k").count()
    before = files()
    held = [shuffled(), shuffled()]  # frames that are held are not garbage
    assert common.stored(held[0]).count() == 97 and common.cut(held[1]).where("count > 0").count() == 97
    # The two counts that were asked here shuffle too, one row for each task.
    left = {f for f in files() - before if f.startswith("shuffle_") and f.endswith(".data")}
    assert len({f.split("_")[1] for f in left}) <= 2
    assert spark.conf.get(common.CLEANUP) == "false"
