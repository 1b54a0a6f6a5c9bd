"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``WIDTH`` features, weighted by inverse document frequency
over all documents. The benchmark is taken in blocks of ``BLOCK`` items; a block's
passages, as TF-IDF rows of unit length, go through a distributed randomised SVD (a
random sketch, power iterations and a small projected problem; only sums over rows
are formed) of ``RANKS`` of a rank for each item, so that the latent space is always
smaller than the block and shrinks with it alike. Every document is cut into
overlapping windows of whole words. A window is projected to the space; its cosine
with an item is taken from both latent vectors, the item's scaled by the share of it
that the space holds, and from the window's full TF-IDF length, so that text that the
space does not know counts against it and an item's copy scores one. Windows at or
above ``COSINE`` are candidates and are checked: longest common subsequence of words
with the item, and the share of the item's answer (its last words) that the window
has. Places that share ``SHARED`` of an item's runs of ``RUN`` words are candidates
too, with cosine zero if no window is one; so copies are found also where they are far
shorter or longer than the windows.

Each document is judged in its own row, whatever its length; nothing is shuffled
but feature counts. The benchmark is the query set: a block of it, items x ranks and
features x ranks, is held by every task, at most WIDTH x RANKS x BLOCK numbers (50 MB)
however many items there are; more blocks are more passes. Document data are never
held.

Defined results: null and empty texts have no windows; items without words match
nothing; repeated rows are judged alike, null doc_ids too; an empty benchmark or
an empty corpus gives no rows; further columns are ignored. Words are what stands
between blanks in lower case, without the ASCII marks of ``MARKS``; places are
counted in words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WIDTH = 1 << 16
#: Items that share a latent space, and its ranks for each of them.
BLOCK, RANKS = 256, 0.75
#: Words of a run, and the share of an item's runs that makes a candidate.
RUN, SHARED = 3, 0.15
#: Window lengths in words, multiples of 24; windows start every third of their length.
WINDOWS = (24, 48)
COSINE = 0.25
#: Shares of an item's words, in order, that make a match alone, and with the answer.
LCS, LCS_WITH_ANSWER, ANSWER = 0.7, 0.5, 0.6
MARKS = b".,;:!?\"'()[]{}*#$%&|"
BLANKS = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))
#: Bytes of a text whose words are hashed at once.
CHUNK = 1 << 18
#: Windows whose lengths are taken at once.
AT_ONCE = 128
RESULT = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, contaminated boolean"


def plain(text: str | None) -> bytes:
    """The text in lower case, without marks, with spaces as its only ASCII blanks."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANKS, MARKS)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text."""
    return plain(text).split()


class Hasher:
    """Features of the words of a text, a whole text at a time.

    A word's hash is the sum of a random number for each byte times a power of an
    odd number; the power is that of the byte's place in the text, and the inverse
    power of the word's place takes that out again.
    """

    def __init__(self):
        rng = np.random.default_rng(4)
        self.code = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.code[32] = 0
        self.base = 0x9E3779B97F4A7C15  # odd
        self.grow(CHUNK)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up, self.down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (self.base, pow(self.base, -1, 1 << 64)))

    def __call__(self, text: bytes) -> np.ndarray:
        """uint16 features of ``plain`` text, in order."""
        if len(text) <= CHUNK:
            return self.of(text)
        parts, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= CHUNK else max(text.rfind(b" ", at, at + CHUNK), at)
            if end == at:  # one word of more than a chunk
                end = text.find(b" ", at + 1)
                end = len(text) if end < 0 else end
            parts.append(self.of(text[at:end]))
            at = end
        return np.concatenate(parts)

    def of(self, text: bytes) -> np.ndarray:
        buf = np.frombuffer(text, np.uint8)
        if len(buf) >= len(self.up):
            self.grow(len(buf))
        word = buf != 32
        start = np.flatnonzero(word & np.concatenate(([True], ~word[:-1]))) if len(buf) else np.empty(0, np.int64)
        if not len(start):
            return np.empty(0, np.uint16)
        x = np.add.reduceat(self.code[buf] * self.up[: len(buf)], start) * self.down[start]
        return (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.uint16)


def distinct(f: np.ndarray) -> np.ndarray:
    """Distinct features, sorted."""
    f = np.sort(f, kind="stable")
    return f[np.concatenate(([True], f[1:] != f[:-1]))] if len(f) else f


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each feature, and how many there are."""

    def task(batches):
        features, count, n = Hasher(), np.zeros(WIDTH, np.int64), 0
        for b in batches:
            for x in b.column(0):
                count[distinct(features(plain(x.as_py())))] += 1
                n += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], n))], names=["f", "n"])

    counted = docs.select("text").mapInArrow(task, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    df = np.zeros(WIDTH + 1, np.int64)
    for f, n in counted.collect():  # at most WIDTH + 1 rows
        df[f] = n
    return df[:WIDTH], int(df[WIDTH])


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(features, V): the leading right factors of the TF-IDF matrix of
    ``rows(text)``; V has a row for each feature that occurs and orthonormal
    columns. Only sums over rows come to the driver, one vector for each feature."""
    def sketch(base: dict[int, np.ndarray] | None):
        def task(batches):
            total: dict[int, np.ndarray] = {}
            gram = np.zeros((rank, rank))
            for b in batches:
                for x in b.column(0):
                    at, value = passage(x.as_py(), idf)
                    if not len(at):
                        continue
                    if base is None:
                        y = value @ np.array([np.random.default_rng([11, int(f)]).standard_normal(rank) for f in at])
                    else:
                        y = value @ np.array([base[int(f)] for f in at])
                    gram += np.outer(y, y)
                    for f, v in zip(at.tolist(), value):
                        total[f] = total.get(f, 0) + v * y
            keys = [*total, *range(-rank, 0)]
            vectors = [v.tolist() for v in total.values()] + gram.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["f", "v"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total[f] = total.get(f, 0) + np.array(v)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["f", "v"])

        parts = rows.select("text").mapInArrow(task, "f long, v array<double>").repartition("f").mapInArrow(add, "f long, v array<double>")
        return {r["f"]: np.array(r["v"]) for r in parts.collect()}

    got = sketch(None)
    features = sorted(f for f in got if f >= 0)
    if not features:
        return np.empty(0, np.int64), np.empty((0, 0))
    for _ in range(rounds):
        basis = np.linalg.qr(np.array([got[f] for f in features]))[0]
        wide = np.zeros((len(features), rank))
        wide[:, : basis.shape[1]] = basis
        got = sketch(dict(zip(features, wide)))
    gram = np.array([got[k] for k in range(-rank, 0)])
    value, turn = np.linalg.eigh(gram)
    keep = np.argsort(-value)[: int((value > 1e-9 * max(value.max(), 1e-30)).sum())]
    return np.array(features), wide @ turn[:, keep]


def passage(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and TF-IDF weights of a passage at unit length."""
    at, n = np.unique(Hasher()(plain(text)), return_counts=True)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0)
    value = n * idf[at.astype(np.int64)]
    return at.astype(np.int64), value / max(1e-30, float(np.sqrt(value @ value)))


def run_length(m: int) -> int:
    """Words of the runs of an item of ``m`` words: short items have short runs, so
    that one changed word leaves some."""
    return 1 if m < 3 else 2 if m < 9 else RUN


def run_codes(f: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` features."""
    out = np.zeros(max(0, len(f) - n + 1), np.int64)
    for i in range(n):
        out = (out << 16) | f[i : len(f) - n + 1 + i]
    return out


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    all_, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        if m := where.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & all_
    return len(a) - v.bit_count()


def check(item: list[bytes], words: list[bytes]) -> tuple[float, float]:
    """(common subsequence, answer words) as shares of the item and its answer,
    which is the last quarter of the item."""
    answer = item[-max(2, len(item) // 4) :]
    have = set(words)
    return lcs_length(item, words) / len(item), sum(w in have for w in answer) / len(answer)


class Index:
    """A block of the benchmark in its latent space, for the tasks."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, features: np.ndarray, v: np.ndarray):
        hasher = Hasher()
        self.ids, self.items = [i for i, _ in items], [tokens(t) for _, t in items]
        self.idf = idf.astype(np.float32)
        self.row = np.zeros(WIDTH, np.int32)
        self.row[features] = np.arange(1, len(features) + 1)
        v = np.vstack((np.zeros((1, v.shape[1])), v))
        # An item of which the space holds a share scores that share against its own
        # copy; the division by it makes the copy's score one again.
        q = np.zeros((len(items), v.shape[1]))
        for k, (_, t) in enumerate(items):
            at, value = passage(t, idf)
            if len(at):
                y = value @ v[self.row[at]]
                q[k] = y / max(1e-12, float(y @ y))
        self.q = np.ascontiguousarray(q.T, np.float32)
        #: What a word adds to a window's latent vector.
        self.v = (v * np.concatenate(([0.0], idf[features]))[:, None]).astype(np.float32)
        # Runs of words: for each length, sorted codes, the items that have them and a
        # map of 2**20 bits that spares most searches.
        self.runs = []
        for n in range(1, RUN + 1):
            held = {(c, k) for k, (_, t) in enumerate(items) if self.items[k] and run_length(len(self.items[k])) == n for c in run_codes(hasher(plain(t)).astype(np.int64), n).tolist()}
            if held:
                code, item = (np.array(x, np.int64) for x in zip(*sorted(held)))
                known = np.zeros(1 << 20, bool)
                known[self.slot(code)] = True
                self.runs.append((n, code, item, known))

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)

    def copies(self, f: np.ndarray):
        """(item number, start, length) of places that share runs of words with an
        item: at least ``SHARED`` of its runs within one and a half of its length.
        Copies are found so whatever the latent space holds and whatever their length."""
        f = f.astype(np.int64)
        for n, code, item, known in self.runs:
            mine = run_codes(f, n)
            hit = np.flatnonzero(known[self.slot(mine)])
            low, high = np.searchsorted(code, mine[hit]), np.searchsorted(code, mine[hit], "right")
            places: dict[int, list[int]] = {}
            for i, a, z in zip(hit.tolist(), low.tolist(), high.tolist()):
                for k in item[a:z].tolist():
                    places.setdefault(k, []).append(i)
            for k, p in places.items():
                m = len(self.items[k])
                least = max(1, SHARED * (m - n + 1))
                if len(p) < least:
                    continue
                p = np.array(p)
                near = np.searchsorted(p, p + m + m // 2, "right") - np.arange(len(p))
                after = -1
                for j in np.flatnonzero(near >= least).tolist():
                    if p[j] > after:
                        after = p[j] + m // 4
                        yield k, int(p[j]), int(p[j + near[j] - 1] + n - p[j])

    def candidates(self, f: np.ndarray, least: float):
        """(item number, start, length, cosine) of windows over the features."""
        step = WINDOWS[0] // 3
        most = max(WINDOWS) // step
        block = 4096 * step
        for at in range(0, len(f), block):
            # Sums over steps; windows are sums of these, and so are their products with
            # the items. The next block's first steps belong to windows that begin here.
            part = f[at : at + block + (most - 1) * step]
            cuts = np.arange(0, len(part), step)
            row, weight = np.zeros(len(cuts) * step, np.int32), self.idf[part]
            row[: len(part)] = self.row[part]
            row = row.reshape(-1, step)
            score = np.zeros((len(cuts) + most, self.q.shape[1]), np.float32)
            of = np.flatnonzero(row.any(axis=1))
            if len(of):
                # The first words of all steps, then the second ones: unknown words add
                # the first row of v, which is zero.
                latent = self.v[row[of, 0]]
                for j in range(1, step):
                    latent += self.v[row[of, j]]
                score[of] = latent @ self.q
            square = np.zeros(len(cuts) + most, np.float32)
            square[: len(cuts)] = np.add.reduceat(weight * weight, cuts)
            last = min(4096, len(cuts)) if at + block < len(f) else len(cuts)
            for length in WINDOWS:
                per, stride = length // step, length // step // 3
                end = max(1, min(last, len(cuts) - per + stride))
                # Slices, not lists of places, so that only the sums are written.
                whole, norm = score[0:end:stride].copy(), square[0:end:stride].copy()
                for k in range(1, per):
                    whole += score[k : end + k : stride]
                    norm += square[k : end + k : stride]
                # Words that recur in a window make its length more than the sum of
                # squares says; windows that pass without that are measured again.
                likely = np.flatnonzero((norm > 0) & (whole.max(axis=1) >= least * np.sqrt(norm)))
                for some in np.split(likely, range(AT_ONCE, len(likely), AT_ONCE)):
                    begin = some * (stride * step)
                    true = self.lengths(part, begin, length)
                    row, k = np.nonzero(whole[some] >= (least * true)[:, None])
                    cosine = np.minimum(1.0, whole[some[row], k] / true[row])
                    for i, a, c in zip(k.tolist(), begin[row].tolist(), cosine.tolist()):
                        yield i, at + a, length, c

    def lengths(self, part: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
        """TF-IDF lengths of windows: a feature's squared weight times its squared count
        is, over the places that have it, its squared weight times its count."""
        place = begin[:, None] + np.arange(length)
        there = place < len(part)
        f = part[np.minimum(place, len(part) - 1)].astype(np.int32)
        f[~there] = -1
        count = (f[:, :, None] == f[:, None, :]).sum(axis=2, dtype=np.int16)
        weight = np.where(there, self.idf[f].astype(np.float64), 0.0)
        return np.sqrt((weight * weight * count).sum(axis=1))

    def matches(self, text: str | None, hasher: Hasher, least: float):
        """The best check of each item that has a candidate with enough of its words
        for the checks to confirm."""
        flat = plain(text)
        f = hasher(flat)
        best: dict[int, tuple] = {}
        found_at = [*self.candidates(f, least), *((k, a, n, 0.0) for k, a, n in self.copies(f))] if len(f) else ()
        if found_at:
            words = flat.split()
            every, enough = set(words), {}
        for k, start, length, cosine in found_at:
            if not self.items[k]:
                continue
            if k not in enough:  # a window has no more of an item's words than the text
                enough[k] = sum(map(every.__contains__, self.items[k])) >= LCS_WITH_ANSWER * len(self.items[k])
            if not enough[k]:
                continue
            m = len(self.items[k])
            a = max(0, start - max(0, m - length // 2))
            region = words[a : start + length + max(0, m - length // 2)]
            have = set(region)
            if sum(map(have.__contains__, self.items[k])) < LCS_WITH_ANSWER * m:
                continue  # too few words for any common subsequence that counts
            lcs, answer = check(self.items[k], region)
            found = lcs >= LCS or (lcs >= LCS_WITH_ANSWER and answer >= ANSWER)
            new = (found, lcs, answer, cosine, start)
            if k not in best or new[:4] > best[k][:4]:
                best[k] = new
        return best


def build(docs: DataFrame, benchmark: DataFrame, ranks: float = RANKS) -> list[Index]:
    """Counts over all documents, and each block of the benchmark in its space."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null").distinct()
    items = sorted((r["item_id"], r["text"]) for r in rows.collect())
    if not items:
        return []
    df, n = document_frequency(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    out = []
    for at in range(0, len(items), BLOCK):
        block = items[at : at + BLOCK]
        some = docs.sparkSession.createDataFrame(block, "item_id long, text string")
        features, v = randomised_svd(some, idf, int(np.ceil(ranks * len(block))))
        if len(features):
            out.append(Index(block, idf, features, v))
    return out


def retrieve(docs: DataFrame, benchmark: DataFrame, least: float = COSINE) -> DataFrame:
    """A row for each document and item with a candidate that has words enough, with
    its best check; contaminated says whether the checks confirm it."""
    spark = docs.sparkSession
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]

    def matched(index: Index) -> DataFrame:
        def task(batches):
            hasher = Hasher()
            for b in batches:
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                    for k, (found, lcs, answer, cosine, start) in index.matches(t.as_py(), hasher, least).items():
                        out.append((i, index.ids[k], cosine, lcs, answer, start, found))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, RESULT)

    found = [matched(index) for index in build(docs, benchmark)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, least: float = COSINE) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; each is
    judged where it lies and no text is moved."""
    at = docs.columns.index("text")

    def kept(rows: DataFrame, index: Index) -> DataFrame:
        def task(batches):
            hasher = Hasher()
            for b in batches:
                keep = [not any(m[0] for m in index.matches(t.as_py(), hasher, least).values()) for t in b.column(at)]
                yield b.filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(task, docs.schema)

    return reduce(kept, build(docs, benchmark), docs)


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirmed matches."""
    return retrieve(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents with a confirmed benchmark passage go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
