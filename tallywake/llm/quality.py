"""Quality classifier: weak labels by expectation-maximisation, hashed scorer.

Overlapping heuristic labellers look at each whole text and vote good, bad or
nothing. What they vote is counted by pattern over all documents (a table of at
most 3**labellers rows); expectation-maximisation finds each labeller's accuracy
on good and on bad texts and the share of good ones, without any true label, and
so a posterior for every pattern; reviewers, where there are labels, are one more
labeller. A logistic scorer over hashed words and surface
features learns these posteriors from a bounded sample and decides for all. This
is done twice: for quality proper and for civility (insults). A document is kept
if both scores say so.

The sample is the ``SAMPLE`` documents (with labels: reviewed documents) with the
smallest hash of doc_id, as far as their features have ``SAMPLE_BYTES`` together
(whole texts; a long one is at most 128 KB); that is the only bound, and all else
covers all texts.

Defined results: texts without words (null, empty, blank) get no votes, scores 0
and are not kept. Repeated rows are judged alike; null doc_ids are judged as well.
Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Bounds on the rows that the scorer is fitted on, and on their features' bytes.
SAMPLE, SAMPLE_BYTES = 8000, 64 << 20
#: Hashed features, after the surface features.
WIDTH = 1 << 16
SURFACE = 13
#: Frequent function words of four languages.
STOP = frozenset(
    "the of and to in is it that for on as with by at be this are from or an he his was you not have "
    "le la les de des du un une et en que qui pour dans sur par au est elle il ne pas avec ce se plus "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
    "el los las y a del se con una su para es al lo como más o pero sus".split()
)
#: Insults.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers trash scum pathetic disgusting worthless clown clowns dumb imbecile jerk bastard filth vermin".split())
#: Bytes that count as symbols, like ! # $ %.
SYMBOLS = [33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 124, 126]
QUALITY = ("symbols", "capitals", "variety", "marks", "function words", "word length", "top word", "repeats", "nothing odd")
CIVILITY = ("any insult", "several insults")


def vote(good: bool, bad: bool) -> str:
    return "-" if bad else "+" if good else "0"


def known(word: str) -> tuple[int, str, tuple[int, int]]:
    """What is asked of a word, once: 1 for a lone mark, 2 for a function word, 4 for
    an insult, added up; the insult; the features of the word and of its beginning."""
    crc = zlib.crc32
    if word.isalpha():  # no marks to cut off
        kind, insult, bare = 2 * (word in STOP) + 4 * (word in INSULTS), word, word
    else:
        insult = word.strip(".,;:!?\"'()[]*#$%&")
        kind = (len(word) == 1 and not word.isalnum()) + 2 * (word.strip(".,;:!?") in STOP) + 4 * (insult in INSULTS)
        bare = word.strip(".,;:!?#$%&*")
    return kind, insult, (crc(bare.encode("utf-8", "surrogatepass")) & (WIDTH - 1), crc(("^" + bare[:4]).encode("utf-8", "surrogatepass")) & (WIDTH - 1))


def look(text: str, memo: dict) -> tuple[str, str, np.ndarray, np.ndarray]:
    """A text's votes on quality and civility, surface features, hashed words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return "0" * len(QUALITY), "0" * len(CIVILITY), np.zeros(SURFACE, np.float32), np.empty(0, np.uint16)
    count = Counter(words)
    if len(memo) > 200_000:
        memo.clear()
    marks = stop = insults = 0
    rude, hashed = set(), []
    for w, c in count.items():
        k = memo.get(w)
        if k is None:
            k = memo[w] = known(w)
        if k[0]:
            marks += c * (k[0] & 1)
            stop += c * (k[0] >> 1 & 1)
            if k[0] & 4:
                insults += c
                rude.add(k[1])
        hashed += k[2]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower = raw[65:91].sum(), raw[97:123].sum()
    symbols = raw[SYMBOLS].sum() / n
    capitals = upper / max(1, upper + lower)
    variety, top = len(count) / n, max(count.values()) / n
    marks, stop, density, different = marks / n, stop / n, insults / n, len(rude)
    length = sum(map(len, words)) / n
    long = n >= 20
    repeats = sum(map(operator.eq, words, words[1:])) / n
    # Each kind of junk has a labeller of its own, which is silent elsewhere.
    first = (
        vote(False, symbols > 0.2) + vote(False, capitals > 0.4) + vote(False, n >= 8 and variety < 0.1) + vote(False, marks > 0.1)
        + vote(stop > 0.12, long and stop < 0.02) + vote(False, length > 14 or length < 2) + vote(False, n >= 8 and top > 0.3) + vote(False, n >= 8 and repeats > 0.2)
        + vote(symbols < 0.1 and capitals < 0.2 and marks < 0.05 and repeats < 0.05 and top < 0.25, False)
    )
    second = vote(False, different > 0) + vote(False, different > 1)
    surface = np.array([1, min(symbols, 2), capitals, variety, min(marks * 3, 2), stop * 3, min(length / 8, 2), top, min(different, 3), min(density * 100, 3), different > 0, min(np.log10(n), 5) / 5, repeats], np.float32)
    return first, second, surface, np.unique(np.array(hashed, np.uint16))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, both vote patterns, surface features and hashed words, packed."""

    def task(batches):
        memo: dict[str, int] = {}
        for b in batches:
            rows = [look(x.as_py() or "", memo) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3].tobytes() for r in rows], pa.binary())],
                names=["doc_id", "quality", "civility", "surface", "words"],
            )

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, quality string, civility string, surface binary, words binary")


def expect_maximise(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good texts, and each labeller's probabilities of + and - on
    good and on bad texts, from the counts of vote patterns. Votes 0 say nothing.
    The start is the majority of the votes."""
    names = sorted(patterns)
    if not names:
        return 0.5, np.empty((0, 2, 2))
    weight = np.array([patterns[p] for p in names], float)
    votes = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p in names])
    balance = votes.sum(axis=1)
    post = np.where(balance > 0, 0.9, np.where(balance < 0, 0.1, 0.7))
    for _ in range(rounds):
        share = float(np.clip((weight * post).sum() / weight.sum(), 0.02, 0.98))
        rate = np.empty((votes.shape[1], 2, 2))
        for k in range(votes.shape[1]):
            for c, belief in enumerate((post, 1 - post)):
                # One more vote that is right than not, so that a labeller that
                # only ever says bad is still believed when it does.
                plus = (weight * belief)[votes[:, k] == 1].sum() + (2, 1)[c]
                minus = (weight * belief)[votes[:, k] == -1].sum() + (1, 2)[c]
                silent = (weight * belief)[votes[:, k] == 0].sum()
                rate[k, c] = plus / (plus + minus + silent), minus / (plus + minus + silent)
        new = np.array([posterior(p, share, rate) for p in names])
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return share, rate


def posterior(pattern: str, share: float, rate: np.ndarray) -> float:
    """The probability of good, given the votes."""
    odds = np.log(share / (1 - share))
    for c, r in zip(pattern, rate):
        if c != "0":
            i = "+-".index(c)
            odds += np.log(r[0, i] / r[1, i])
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def fit_scorer(surface: np.ndarray, words: list[np.ndarray], target: np.ndarray, epochs: int = 8) -> np.ndarray:
    """Weights of a logistic scorer, surface features first, by AdaGrad."""
    w, g = np.zeros(SURFACE + WIDTH), np.full(SURFACE + WIDTH, 1e-2)
    bad = max(1e-6, float((1 - target).sum()))
    heavier = float(np.clip((len(target) - bad) / bad, 1, 8))  # the rarer bad ones weigh as much together
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(target)):
            at, value = words[i].astype(np.int64) + SURFACE, 1 / np.sqrt(len(words[i]) + 1)
            z = surface[i] @ w[:SURFACE] + value * w[at].sum()
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            error = p * (1 - target[i]) * heavier - (1 - p) * target[i]
            step = error * surface[i]
            g[:SURFACE] += step * step
            w[:SURFACE] -= 0.3 * step / np.sqrt(g[:SURFACE])
            step = error * value
            g[at] += step * step
            w[at] -= 0.1 * step / np.sqrt(g[at])
    return w


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, weak_label (posterior of quality by the heuristics), quality_score,
    civility_score and kept for every row of ``docs(doc_id, text)``. Where
    ``labels(doc_id, quality, toxic)`` are given, reviewers are one labeller more,
    which is silent on all other documents."""
    rows = cut(featured(docs))
    votes = rows.where("length(words) > 0").select("doc_id", "quality", "civility")
    said = "case when {} then '+' when {} then '-' else '0' end"
    if labels is None:
        review = votes.select("doc_id").limit(0).selectExpr("doc_id", "'0' as rq", "'0' as rc")
        chosen = votes.select("doc_id")
    else:
        review = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        review = review.selectExpr("doc_id", said.format("q > 0", "q = 0") + " as rq", said.format("t = 0", "t > 0") + " as rc")
        chosen = votes.select("doc_id").join(review, "doc_id", "left_semi")
    chosen = chosen.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most SAMPLE ids, so the join below is a broadcast of proven size.
    some = rows.where("length(words) > 0").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).join(review, "doc_id", "left")
    # One task numbers SAMPLE rows at most.
    some = some.withColumn("_bytes", F.sum(F.length("words") + F.length("surface")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("_bytes") <= SAMPLE_BYTES)
    some = some.selectExpr("concat(quality, coalesce(rq, '0')) as quality", "concat(civility, coalesce(rc, '0')) as civility", "surface", "words").collect()
    reviewed = cut(votes.join(review, "doc_id", "left").selectExpr("concat(quality, coalesce(rq, '0')) as quality", "concat(civility, coalesce(rc, '0')) as civility").groupBy("quality", "civility").count())
    weights, models = {}, {}
    for head in ("quality", "civility"):
        patterns = {r[head]: r["n"] for r in reviewed.groupBy(head).agg(F.sum("count").alias("n")).collect()}
        models[head] = expect_maximise(patterns)
        target = np.array([posterior(r[head], *models[head]) for r in some])
        surface = np.array([np.frombuffer(r["surface"], np.float32) for r in some]).reshape(len(some), SURFACE)
        weights[head] = fit_scorer(surface, [np.frombuffer(r["words"], np.uint16) for r in some], target)
    packed = {k: w.astype(np.float32) for k, w in weights.items()}

    def task(batches):
        for b in batches:
            out = []
            for q, s, x in zip(*(b.column(i).to_pylist() for i in (1, 3, 4))):
                at = np.frombuffer(x, np.uint16).astype(np.int64) + SURFACE
                if not len(at):
                    out.append((None, 0.0, 0.0, False))
                    continue
                surface, value = np.frombuffer(s, np.float32), 1 / np.sqrt(len(at) + 1)
                z = [float(surface @ w[:SURFACE] + value * w[at].sum()) for w in packed.values()]
                p = [float(1 / (1 + np.exp(-np.clip(y, -30, 30)))) for y in z]
                out.append((posterior(q, *models["quality"]), *p, p[0] >= 0.5 and p[1] >= 0.5))
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.float64(), pa.float64(), pa.bool_())))],
                names=["doc_id", "weak_label", "quality_score", "civility_score", "kept"],
            )

    return rows.mapInArrow(task, "doc_id long, weak_label double, quality_score double, civility_score double, kept boolean")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the classifier rejects go; of rows that share a
    doc_id all go if one is rejected."""
    gone = classify(docs, table(spark, sf_dir, "labels")).where("not kept").select(F.col("doc_id").alias("__d")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__d"]), "left_anti").select(*docs.columns)
