"""Quality rules: counts of a text against fixed thresholds, and a learned verdict.

The learned part is a logistic regression over hashed n-grams of words and of bytes,
fitted on labelled rows of quality 0 or 1 and calibrated (Platt) on those of
them that it was not fitted on. Counts and scores of all documents are made in one
pass in Arrow batches: each batch is one buffer of bytes in which n-grams are hashed,
looked up and added up by vectorised steps.

A window of eight words is found again exactly, not by hash: words are numbered, then
pairs of numbers, then pairs of those.

The fit is on the driver, on the ``SAMPLE`` labelled documents with the smallest hash
of doc_id, as far as their texts have ``SAMPLE_BYTES`` together; those of over
``LONGEST`` bytes are not taken. That is the only bound; counts and scores are of all
whole texts.

Defined results: null, empty and blank texts have counts of 0 and fail the base. A
doc_id that is null or repeated is judged by its own text; in the sample a repeated
doc_id counts once, with the smallest of its texts and of its labels. Without
labelled rows of both kinds there is nothing to learn: the score is null, and what
passes the base is kept. Words are runs of bytes other than ASCII white space. Empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Bounds on the labelled rows that the scorer is fitted on.
SAMPLE, SAMPLE_BYTES, LONGEST = 4000, 24 << 20, 256 << 10
#: One of so many labelled rows calibrates and is not fitted.
FOLDS = 5
#: Hashed features: n-grams of bytes, then of words.
BITS = 17
WIDTH = 1 << BITS
BYTE_GRAMS, WORD_GRAMS = (2, 3, 4), (1, 2)
MIX = 0x9E3779B1
#: Bytes that are looked at together; a longer text is looked at alone.
SLICE = 1 << 20
#: Thresholds of the rules.
LEAST_WORDS, REPEATED_PERCENT, WINDOW, LEAST_SCORE = 20, 30, 8, 0.5
#: Symbols that count.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def slices(texts: list[bytes]):
    """Texts in runs of at most ``SLICE`` bytes, or one."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= SLICE:
            size += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The text and the word number at each word, and the words by number."""
    found = [t.split() for t in texts]  # bytes are split at ASCII white space
    flat = list(itertools.chain.from_iterable(found))
    words = list(dict.fromkeys(flat))
    ids = dict(zip(words, range(len(words))))
    doc = np.repeat(np.arange(len(texts)), list(map(len, found)))
    return doc, np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat)), words


def repeated(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which words stand in a window of eight that its text has twice or more."""
    out = np.zeros(len(word), bool)
    if len(word) < WINDOW:
        return out
    run = word
    for step in (1, 2):
        run = np.unique(run[:-step] * (run.max() + 1) + run[step:], return_inverse=True)[1]
    here = np.flatnonzero(doc[: 1 - WINDOW] == doc[WINDOW - 1 :])
    if not len(here):
        return out
    most = int(run.max()) + 1
    key = (doc[here] * most + run[here]) * most + run[here + WINDOW // 2]
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    start = here[count[of] > 1]
    change = np.zeros(len(word) + 1, np.int64)
    change[start] += 1
    change[start + WINDOW] -= 1  # starts are distinct, and so are ends
    return np.cumsum(change[:-1]) > 0


def counts(texts: list[bytes], doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def marked(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[ends])

    chars = marked(~_flags(SPACES)[raw] & ((raw & 0xC0) != 0x80))
    same = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        same.append(len(lines) - len(set(lines)))
    n = len(texts)
    return np.stack([np.bincount(doc, minlength=n), chars, marked(_flags(SYMBOLS)[raw]), np.array(same), np.bincount(doc[repeated(doc, word)], minlength=n)])


def grams(texts: list[bytes], doc: np.ndarray, word: np.ndarray, words: list[bytes]):
    """Hashed n-grams in pieces: (kind, text of each, feature of each); kind 0 are those
    of bytes, 1 those of words."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    for n in BYTE_GRAMS:
        for at in range(0, len(raw), SLICE):
            part, owner = raw[at : at + SLICE + n - 1].astype(np.uint32), of[at : at + SLICE + n - 1]
            size = len(part) - n + 1
            if size <= 0:
                continue
            code = np.full(size, n, np.uint32)
            for k in range(n):
                code = (code * np.uint32(257) if n > 3 else code << np.uint32(8)) + part[k : k + size]
            inside = owner[:size] == owner[n - 1 :]
            yield 0, owner[:size][inside], ((code * np.uint32(MIX)) >> np.uint32(32 - BITS))[inside]
    hashed = np.array([zlib.crc32(w) for w in words], np.uint32)
    for n in WORD_GRAMS:
        size = len(word) - n + 1
        if size <= 0:
            continue
        code = np.zeros(size, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x85EBCA6B) + hashed[word[k : k + size]]
        if n > 1:  # a word that stands twice is one feature, whichever it is
            code[word[:size] == word[1 : size + 1]] = 0
        inside = doc[:size] == doc[n - 1 :]
        yield 1, doc[:size][inside], (((code * np.uint32(MIX)) >> np.uint32(32 - BITS)) + np.uint32(WIDTH))[inside]


def scores(texts: list[bytes], doc: np.ndarray, word: np.ndarray, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The scorer's value of each text: the mean weight of its n-grams of either kind."""
    total, many = np.zeros((2, len(texts))), np.zeros((2, len(texts)))
    for kind, owner, feature in grams(texts, doc, word, words):
        total[kind] += np.bincount(owner, weights[feature], len(texts))
        many[kind] += np.bincount(owner, minlength=len(texts))
    return weights[-1] + (total / np.maximum(many, 1)).sum(axis=0)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's features and their shares, sparse."""
    out = []
    for t in texts:
        doc, word, words = numbered([t])
        parts = [(f + np.zeros(1, np.int64), kind) for kind, _, f in grams([t], doc, word, words)]
        at, value = [], []
        for kind in (0, 1):
            mine = [f for f, k in parts if k == kind]
            if mine and (whole := np.concatenate(mine)).size:
                feature, many = np.unique(whole, return_counts=True)
                at.append(feature.astype(np.int32))
                value.append((many / whole.size).astype(np.float32))
        out.append((np.concatenate(at), np.concatenate(value)) if at else (np.empty(0, np.int32), np.empty(0, np.float32)))
    return out


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = 12) -> np.ndarray:
    """Weights by AdaGrad, the bias last; the rarer kind weighs as much as the other."""
    w, g = np.zeros(2 * WIDTH + 1), np.full(2 * WIDTH + 1, 1e-8)
    heavy = np.where(good, 1.0, np.clip(good.sum() / max(1, (~good).sum()), 0.125, 8))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            z = w[-1] + value @ w[at]
            error = heavy[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[i])
            step = error * value
            g[at] += step * step
            w[at] -= 0.3 * step / np.sqrt(g[at])
            g[-1] += error * error
            w[-1] -= 0.1 * error / np.sqrt(g[-1])
    return w


def calibrated(z: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn values into probabilities, by Newton's method on
    smoothed targets. Without both kinds, the values as they are."""
    if good.all() or not good.any():
        return 1.0, 0.0
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, v = p - target, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, float(np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    # A falling slope would turn the scorer round; it is not believed.
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, text and good of the labelled rows that the scorer learns from."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    short = docs.select("doc_id", "text").where((F.octet_length("text") <= LONGEST) & (F.octet_length("text") > 0))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.join(short.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(size)
    # ``size`` ids at most are broadcast; one task adds up their lengths.
    some = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    some = some.withColumn("_bytes", F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order)))
    return some.where(F.col("_bytes") <= SAMPLE_BYTES).select("doc_id", "text", (F.col("quality") == 1).alias("good"))


def trained(rows: list[tuple[int, str, bool]]) -> tuple[np.ndarray, float, float] | None:
    """Weights, slope and offset from (doc_id, text, good); None without both kinds."""
    rows = sorted(rows)
    good = np.array([r[2] for r in rows], bool)
    held = np.array([zlib.crc32(str(r[0]).encode()) % FOLDS == 0 for r in rows], bool)
    if not len(rows) or good[~held].all() or not good[~held].any():
        return None
    x = features([r[1].encode("utf-8", "surrogatepass") for r in rows])
    w = fitted([x[i] for i in np.flatnonzero(~held)], good[~held])
    z = np.array([w[-1] + x[i][1] @ w[x[i][0]] for i in np.flatnonzero(held)])
    return (w.astype(np.float32), *calibrated(z, good[held]))


def judged(docs: DataFrame, model: tuple[np.ndarray, float, float] | None) -> DataFrame:
    """doc_id, the five counts, base_failed, score (probability of good) and kept for
    every row of ``docs(doc_id, text)``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def task(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            table, value = [], []
            for part in slices(texts):
                doc, word, words = numbered(part)
                table.append(counts(part, doc, word))
                if model is not None:
                    weights, a, b0 = model
                    value.append(1 / (1 + np.exp(-np.clip(a * scores(part, doc, word, words, weights) + b0, -30, 30))))
            n = np.concatenate(table, axis=1) if table else np.zeros((5, 0), np.int64)
            failed = (n[0] < LEAST_WORDS) | (100 * n[4] > REPEATED_PERCENT * n[0])
            p = np.concatenate(value) if value else np.ones(n.shape[1])
            score = pa.array(p) if model is not None else pa.nulls(n.shape[1], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in n), pa.array(failed), score, pa.array(~failed & (p >= LEAST_SCORE))], names=["doc_id", *names, "base_failed", "score", "kept"])

    schema = "doc_id long, " + "".join(f"{x} long, " for x in names) + "base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, schema)


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the scorer that the labelled ones teach."""
    docs = table(spark, sf_dir, "documents")
    rows = sample(docs, table(spark, sf_dir, "labels")).collect()
    return judged(docs, trained([(r.doc_id, r.text, r.good) for r in rows]))
