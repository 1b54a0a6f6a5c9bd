"""Centroid clustering: Lloyd's rounds over distinct quantised vectors with weights.

Vectors become integer vectors, ``floor(SCALE * x)``. Equal ones are grouped with
their multiplicity, so that a vector that a third of all rows hold is one row, and
rounds run over distinct vectors only. A round is one pass: each task assigns
its vectors in Arrow batches and adds up what its clusters hold, in integers, with
the weights; a row for each task and cluster is shuffled, and the ``K`` new
centroids, which are all that is ever on the driver, are exact floors. In the end
the assignment of every distinct vector is joined back to the vec_ids; the side
with the ids may be skewed, and the other has one row for a vector, so that Spark
can split it.

Defined results: only vectors with exactly ``SIZE`` components, none of them null or
non-finite, are kept; others have no row. A component beyond ±``LARGEST`` after
quantising counts as that, so that no square overflows. With fewer than ``K`` kept
vectors there are as many centroids; with none, no rows. Starting points are rows: a
vec_id that is repeated with equal hash is ordered by its vector, and null vec_ids
come last. Repeated rows have the weight of all and a row each. Equal centroids: the
smaller number gets all. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SIZE, SCALE = 64, 64
#: Clusters and rounds.
K, ROUNDS = 16, 3
#: 64 squares of twice this fit a long.
LARGEST = (1 << 27) - 1
#: Vectors whose distances a task holds at once.
BLOCK = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and ``q`` of the kept vectors."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    bounded = lambda v: F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return vectors.select("vec_id", "embedding").where((F.size(x) == SIZE) & finite).select("vec_id", F.transform(x, lambda v: F.floor(bounded(v)).cast("int")).alias("q"))


def starting(kept: DataFrame, k: int) -> np.ndarray:
    """The vectors of the ``k`` rows with the smallest hash of vec_id: k rows at most."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), SIZE)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid and its squared distance, exact."""
    far = np.empty((len(centroids), len(vectors)), np.int64)
    for i, c in enumerate(centroids):
        gap = vectors - c
        far[i] = np.einsum("ij,ij->i", gap, gap)
    best = far.argmin(axis=0)  # of equal ones the first
    return best, far[best, np.arange(len(vectors))]


def blocks(batch: pa.RecordBatch):
    """A batch's vectors in blocks: (from, to, integers)."""
    for i in range(0, batch.num_rows, BLOCK):
        part = batch.column("q").slice(i, BLOCK)
        yield i, i + len(part), part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), SIZE)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""

    def task(batches):
        sums, weights = np.zeros((len(centroids), SIZE), object), np.zeros(len(centroids), object)
        for b in batches:
            w = b.column("w").to_numpy()
            for i, j, q in blocks(b):
                best, _ = nearest(q, centroids)
                for c in np.unique(best):
                    mine = best == c
                    # A block's sums fit a long while weights are below 2**23; beyond they are added as whole numbers.
                    small = w[i:j].max() < 1 << 23
                    part = w[i:j][mine] @ q[mine] if small else w[i:j][mine].astype(object) @ q[mine].astype(object)
                    sums[c] += part.astype(object)
                    weights[c] += int(w[i:j][mine].sum())
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([weights[c] for c in at], pa.int64()), pa.array([[str(x) for x in sums[c]] for c in at], pa.list_(pa.string()))], names=["cluster", "weight", "sums"]
        )

    parts = distinct.select("q", "w").mapInArrow(task, "cluster int, weight long, sums array<string>")
    total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(SIZE)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("weight").alias("weight"), *total).collect():
        out[r.cluster] = [int(r[f"s{d}"]) // r.weight for d in range(SIZE)]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``distinct`` with cluster and distance."""

    def task(batches):
        for b in batches:
            found = [nearest(q, centroids) for _, _, q in blocks(b)]
            cluster = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
            distance = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("w"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["q", "w", "cluster", "distance"])

    return distinct.select("q", "w").mapInArrow(task, "q array<int>, w long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, weight (how many rows hold
    the same quantised vector) and centroid_sha256 for every kept row of
    ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    kept = stored(quantised(vectors), "quantised")
    distinct = stored(kept.groupBy("q").agg(F.count("*").alias("w")), "distinct")
    centroids = starting(kept, k)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(distinct, centroids)
        found = stored(assigned(distinct, centroids), "assigned")
    else:
        found = distinct.select("q", "w", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    # A row for each cluster.
    whole = F.sum(F.col("w").cast("decimal(38,0)") * F.col("distance"))
    inertia = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(whole.alias("x")).collect()}
    about = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    names = spark.createDataFrame(about, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = found.select(F.col("q").alias("_q"), F.col("w").alias("weight"), "cluster", "distance")
    rows = kept.join(back, F.col("q") == F.col("_q")).join(F.broadcast(names), F.col("cluster") == F.col("_c"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "weight", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("weight")


def _sql() -> str:
    """Each round in SQL: every kept vector against every centroid."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    ctes = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT 16))",
    ]
    for r in range(4):
        ctes.append(f"a{r} AS (SELECT vec_id, q, best.c AS cluster, best.d AS distance FROM (SELECT v.vec_id, v.q, min(struct_pack(d := CAST({far} AS BIGINT), c := c.c)) AS best FROM kept v, c{r} c GROUP BY v.vec_id, v.q))")
        if r < 3:
            means = f"SELECT cluster AS c, list(CAST(m AS BIGINT) ORDER BY i) AS q FROM (SELECT cluster, i, (s - ((s % n + n) % n)) // n AS m FROM (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2)) GROUP BY 1"
            ctes.append(f"c{r + 1} AS (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN ({means}) m ON m.c = o.c)")
    return "WITH " + ", ".join(ctes) + (
        " SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,"
        " sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM kept k JOIN a3 a ON a.vec_id = k.vec_id AND a.q = k.q JOIN c3 c ON c.c = a.cluster"
    )


SQL12 = _sql()
