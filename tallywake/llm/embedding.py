"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A vector of unit length is padded to a power of two and turned by three rounds
of random signs and a fast Hadamard transform; its hash is the nearest of the
signed basis vectors. A table's bucket is made of ``PER_TABLE`` hashes; besides
its own bucket a vector is put into those in which one hash is replaced by its
second nearest. Vectors that share a bucket, a label and a length are compared by
cosine in double precision, and only verified pairs count.

Copies are folded into one class first. Links are counted in the tasks: a pair
counts in the first bucket that its vectors share and nowhere else, which both
vectors' hashes tell, so no list of pairs is ever moved. Besides the counts only
a spanning forest of each bucket is returned, for the components. A bucket with
more than ``RUN`` classes is dealt out in blocks, each pair of blocks to a task.

The index holds every row; its parameters are fixed and nothing is fitted.
Recall against brute force is measured in tests/llm/test_embedding.py (at least
0.99 on the given tables).

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with null labels, link with nothing: no links, a component
of their own. Repeated rows are vectors of their own. Vectors of different
length are not linked. A row with null vec_id takes part, but is a component's
id only if the component has no other. An empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

COSINE = 0.93
TABLES = 8
PER_TABLE = 2
SEED = 7
#: Classes of a bucket that are compared within one block.
RUN = 1024


def signs(dim: int, tables: int) -> np.ndarray:
    """The random signs of three rounds for every hash: (hashes, 3, dim)."""
    return np.random.default_rng([SEED, dim]).choice([-1.0, 1.0], size=(tables * PER_TABLE, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, not normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def codes(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """For every row and hash the nearest and the second nearest signed basis
    vector: (rows, hashes, 2)."""
    n, given = unit.shape
    dim = 1 << max(1, (given - 1).bit_length())
    x = np.zeros((n, dim))
    x[:, :given] = unit
    out = np.empty((n, tables * PER_TABLE, 2), np.int32)
    rows = np.arange(n)
    for k, three in enumerate(signs(dim, tables)):
        y = x
        for s in three:
            y = hadamard(y * s)
        size = np.abs(y)
        best = size.argmax(axis=1)
        out[:, k, 0] = 2 * best + (y[rows, best] < 0)
        size[rows, best] = -1
        best = size.argmax(axis=1)
        out[:, k, 1] = 2 * best + (y[rows, best] < 0)
    return out


def buckets(code: np.ndarray) -> np.ndarray:
    """Bucket numbers, (rows, tables, probes), from ``codes``."""
    n, hashes, _ = code.shape
    code = code.reshape(n, hashes // PER_TABLE, PER_TABLE, 2).astype(np.int64)
    first = code[..., 0]
    probes = [first]
    for k in range(PER_TABLE):
        other = first.copy()
        other[:, :, k] = code[:, :, k, 1]
        probes.append(other)
    number = np.zeros((n, hashes // PER_TABLE, len(probes)), np.int64)
    for k in range(PER_TABLE):
        number = (number << 20) | np.stack([p[:, :, k] for p in probes], axis=2)
    return number


def unit_of(values: list | None) -> np.ndarray | None:
    """The vector at unit length in double precision, or None if unusable."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def earlier(a: np.ndarray, b: np.ndarray, t: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether rows' buckets a and b (rows, tables, probes) meet before bucket
    ``key`` of table ``t``."""
    out = np.zeros(len(t), bool)
    for u in range(a.shape[1]):
        some = np.flatnonzero((u <= t) & ~out)
        if len(some):
            same = a[some, u, :, None] == b[some, u, None, :]
            same &= (u < t[some])[:, None, None] | (a[some, u] < key[some, None])[:, :, None]
            out[some] = same.any(axis=(1, 2))
    return out


def compare(runs: np.ndarray, block: np.ndarray, two: np.ndarray, t: np.ndarray, key: np.ndarray, unit: np.ndarray, code: np.ndarray, weight: np.ndarray, least: float):
    """Within runs of sorted rows: (row, linked weight) sums and forest edges.

    runs numbers the runs; where a run is of two blocks (``two``), only pairs
    across them count.
    """
    n = len(runs)
    total, edges = np.zeros(n, np.int64), []
    bucket = buckets(code)
    start = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    size = np.diff(np.append(start, n))

    def count(i, j):
        new = ~earlier(bucket[i], bucket[j], t[i], key[i])
        np.add.at(total, i[new], weight[j[new]])
        np.add.at(total, j[new], weight[i[new]])

    for s, m in zip(start[size > 32].tolist(), size[size > 32].tolist()):
        own = block[s : s + m]
        near = unit[s : s + m] @ unit[s : s + m].T >= least
        if two[s]:
            near &= own[:, None] != own[None, :]
        np.fill_diagonal(near, False)
        i, j = np.nonzero(np.triu(near))
        for at in range(0, len(i), 1 << 17):
            count(s + i[at : at + (1 << 17)], s + j[at : at + (1 << 17)])
        new = np.ones(m, bool)
        for seed in range(m):
            if not new[seed]:
                continue
            new[seed], front = False, [seed]
            while front:
                hub = front.pop()
                found = np.flatnonzero(near[hub] & new)
                new[found] = False
                front += found.tolist()
                edges += [(s + hub, s + x) for x in found.tolist()]
    small = np.flatnonzero(np.repeat(size <= 32, size))
    for step in range(1, 32):
        i, j = small[:-step], small[step:]
        if not len(i):
            break
        same = (runs[i] == runs[j])
        if not same.any():
            break
        same &= ~((block[i] == block[j]) & two[i])
        i, j = i[same], j[same]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        i, j = i[near], j[near]
        count(i, j)
        edges += list(zip(i.tolist(), j.tolist()))
    return total, edges


def links(classes: DataFrame, least: float = COSINE, tables: int = TABLES, run: int = RUN) -> DataFrame:
    """From ``classes(cid, label, vector binary of doubles, n)``: rows
    (cid, other, weight): link weights with null ``other``, and forest edges."""

    def explode(batches):
        for b in batches:
            by_dim: dict[int, list[int]] = {}
            raw = b.column(2).to_pylist()
            for i, x in enumerate(raw):
                by_dim.setdefault(len(x), []).append(i)
            for size, rows in by_dim.items():
                for at in range(0, len(rows), 256):
                    some = rows[at : at + 256]
                    unit = np.frombuffer(b"".join(raw[i] for i in some)).reshape(len(some), -1)
                    code = codes(unit, tables)
                    number = buckets(code)
                    r, t, p = (x.ravel() for x in np.indices(number.shape))
                    flat = number.ravel()
                    # A probe may name the same bucket twice; one row is enough.
                    keep = np.unique(np.column_stack((r, t, flat)), axis=0, return_index=True)[1]
                    r, t, flat = r[keep], t[keep], flat[keep]
                    take = pa.array(np.array(some)[r])
                    packed = pa.array([c.tobytes() for c in code.astype(np.int32)], pa.binary()).take(pa.array(r))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(1).take(take), pa.array(np.full(len(r), size, np.int32)), pa.array(t.astype(np.int32)), pa.array(flat), b.column(0).take(take), b.column(2).take(take), packed, b.column(3).take(take)],
                        names=["label", "size", "t", "key", "cid", "vector", "code", "n"],
                    )

    def task(batches):
        held: list[pa.RecordBatch] = []

        def done(part: pa.Table):
            if part.num_rows < 2:
                return None
            cols = {k: part.column(k).to_numpy() for k in ("size", "t", "key", "block", "n")}
            head = list(zip(part.column("label").to_pylist(), *(cols[k].tolist() for k in ("size", "t", "key")), part.column("p").to_pylist(), part.column("q").to_pylist()))
            two = np.array([h[4] != h[5] for h in head])
            runs = np.cumsum([0] + [int(x != y) for x, y in zip(head[1:], head)])
            cid = part.column("cid").to_pylist()
            out: list[tuple] = []
            raw, packed = part.column("vector").to_pylist(), part.column("code").to_pylist()
            for size in np.unique(cols["size"]):
                at = np.flatnonzero(cols["size"] == size)
                unit = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
                code = np.frombuffer(b"".join(packed[i] for i in at), np.int32).reshape(len(at), -1, 2)
                total, edges = compare(runs[at], cols["block"][at], two[at], cols["t"][at], cols["key"][at], unit, code, cols["n"][at], least)
                some = np.flatnonzero(total)
                out += [(cid[at[i]], None, int(total[i])) for i in some]
                out += list({(cid[at[i]], cid[at[j]], None) for i, j in edges})
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["cid", "other", "weight"])

        kept = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            kept += b.num_rows
            if kept < 4 * run:
                continue
            t = pa.Table.from_batches(held)
            keys = [t.column(k).to_pylist() for k in ("label", "size", "t", "key", "p", "q")]
            last = t.num_rows - 1
            while last and all(k[last] == k[last - 1] for k in keys):
                last -= 1
            if last:
                if (x := done(t.slice(0, last))) is not None:
                    yield x
                held, kept = t.slice(last).to_batches(), t.num_rows - last
        if held and (x := done(pa.Table.from_batches(held))) is not None:
            yield x

    keyed = classes.select("cid", "label", "vector", "n").mapInArrow(explode, "label string, size int, t int, key long, cid string, vector binary, code binary, n long")
    keyed = cut(keyed)
    by = ["label", "size", "t", "key"]
    sizes = keyed.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1").select(*by, F.ceil(F.col("m") / run).cast("int").alias("blocks"))
    at = keyed.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = at.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *by, F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "cid", "vector", "code", "n"
    )
    where = [*by, "p", "q"]
    return dealt.repartition(*where).sortWithinPartitions(*where).mapInArrow(task, "cid string, other string, weight long")


def with_class(vectors: DataFrame) -> DataFrame:
    """vec_id, label, class digest and unit vector; null where unusable."""

    def task(batches):
        for b in batches:
            cids, units = [], []
            for label, values in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = None if label is None else unit_of(values)
                units.append(None if x is None else x.tobytes())
                cids.append(None if x is None else hashlib.blake2b(np.array(values, np.float64).tobytes() + b"|" + label.encode(), digest_size=16).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cids, pa.string()), pa.array(units, pa.binary())], names=["vec_id", "label", "cid", "vector"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return given.mapInArrow(task, "vec_id long, label string, cid string, vector binary")


def near_vectors(vectors: DataFrame, least: float = COSINE, tables: int = TABLES, run: int = RUN) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``."""
    marked = cut(with_class(vectors))
    classes = cut(marked.where("cid is not null").groupBy("cid", "label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("vector").alias("vector")))
    found = cut(links(classes, least, tables, run))
    direct = found.where("other is null").groupBy("cid").agg(F.sum("weight").alias("w"))
    comps = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    one = (
        classes.select("cid", "n", "first").join(direct, "cid", "left")
        .join(comps.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("root", F.coalesce("component", "cid"))
    )
    least_id = one.groupBy("root").agg(F.min("first").alias("component_id"))
    one = one.join(least_id, "root").select("cid", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return marked.select("vec_id", "cid").join(one, "cid", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
