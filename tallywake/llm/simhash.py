"""Near-duplicate documents by SimHash, joined by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into four segments of 16. With three differing
bits at most, at most one segment has two or more of them; with a cyclic order
of segments, some segment is so equal while its successor differs in one bit at
most (two or more segments are equal in every case in which a segment is bad, and
no two of them have the same successor). An equal segment is itself a key; the
successor, padded to 23 bits, is hashed by the perfect binary Golay code: a word
within distance 2 of its codeword keeps that codeword if one bit changes; a word
at distance 3 may fall to any codeword at distance 4, so these are given too. Two
words that differ in one bit thus share a codeword index, and (segment, index of
the successor) is a key of about 28 bits that every pair to be linked shares.

Only fingerprints that differ are joined; copies meet in their fingerprint. Rows
of a key are sorted into runs and compared in tasks: short runs pair by pair,
long ones by a breadth-first search that returns a spanning forest, so what a
task emits grows with the rows and not with the pairs. A key with more than
``RUN`` fingerprints is dealt out in blocks of that size, each pair of blocks to
a task of its own: every pair is compared, and no task holds more than two blocks.

Defined results: null, empty and blank texts have fingerprint zero and are linked
like any other; repeated rows and repeated doc_ids are rows of their own, with the
component's smallest doc_id; a null doc_id is kept and is a component's id only if
it has no other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop, stored, table

WIDTH = 3
DISTANCE = 3
SEED = 42
#: The pipeline's stage: words of a shingle, share of shingles in both texts, keys.
STAGE_WIDTH, SIMILARITY, MINIMA = 5, 0.8, 10
#: Fingerprints of a key that are compared within one block.
RUN = 2048
#: Columns of 64 bits each, the map of a text's shingles. Texts of some hundred shingles
#: that share few of them are told apart by it.
MAP = ("m0", "m1", "m2", "m3")
#: Marks the stage's Golay keys, which have 30 bits.
GOLAY_KEY = np.int64(0x601A << 48)
GOLAY = 0b101011100011  # generator polynomial of the binary Golay code (fixed value)


def digests(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each word shingle: ASCII letters in lower case, words between ASCII
    blanks; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest, seed = xxhash.xxh64_digest, SEED
    line = b" ".join(words)
    if len(words) <= width:
        return np.frombuffer(digest(line, seed), ">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, out = len(words) - width + 1, []
    for at in range(0, n, 65536):  # bounded memory for very long texts
        cuts = zip(starts[at : min(at + 65536, n)].tolist(), ends[at + width - 1 : min(at + 65536, n) + width - 1].tolist())
        out.append(np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in cuts]), ">u8").astype(np.uint64))
    return np.concatenate(out)


def majority(hashes: np.ndarray) -> int:
    """SimHash: strict majority for each bit; zero without hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        raw = hashes[at : at + 65536].astype(">u8").view(np.uint8)
        count += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash over the word shingles of ``digests``."""
    return majority(digests(text, width))


def with_fingerprint(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, a signed long with the fingerprint's 64 bits."""

    def task(batches):
        for b in batches:
            fps = [fingerprint(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, fp long")


def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each word of 16 bits, padded to 23: the numbers of codewords that it
    hashes to (the message bits of its own and, at distance 3, of those at
    distance 4), as a flat array and the start of each word's part."""
    code = []
    for m in range(4096):
        word = m << 11
        rest = word
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= GOLAY << (k - 11)
        code.append(word | rest)
    code, numbers, counts = np.array(code, np.uint32), [], []
    for at in range(0, 1 << 16, 2048):
        far = np.bitwise_count(np.arange(at, at + 2048, dtype=np.uint32)[:, None] ^ code[None, :])
        own = far.min(axis=1)[:, None]
        hit = (far == own) | ((own == 3) & (far == 4))
        numbers.append(np.nonzero(hit)[1].astype(np.int16))
        counts.append(hit.sum(axis=1))
    return np.concatenate(numbers), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)


def keys_of(fps: np.ndarray, which: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all keys of all fingerprints; the
    tables are those of ``golay_keys``."""
    rows, keys = [], []
    for i in range(4):
        exact = (fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)
        near = ((fps >> np.uint64(16 * ((i + 1) % 4))) & np.uint64(0xFFFF)).astype(np.int64)
        n = starts[near + 1] - starts[near]
        row = np.repeat(np.arange(len(fps)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[near], n)
        rows.append(row)
        keys.append((np.int64(i) << 28) | (exact.astype(np.int64)[row] << 12) | which[at].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1) if keys.ndim > 1 else keys[1:] != keys[:-1])))
    return new, np.append(new[1:], len(keys))


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph of some fingerprints."""
    left, out = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            hub = front.pop()
            near = np.bitwise_count(left ^ hub) <= distance
            if near.any():
                found = left[near]
                out += [(hub, x) for x in found]
                front += list(found)
                left = left[~near]
    return out


def linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Edges within the runs of sorted keys; every linked pair is connected."""
    start, end = runs_of(keys)
    size = end - start
    out = [np.empty((0, 2), np.uint64)]
    for s, e in zip(start[size > 32].tolist(), end[size > 32].tolist()):
        if found := forest(np.unique(fps[s:e]), distance):
            out.append(np.array(found, np.uint64))
    run = np.repeat(np.arange(len(start)), size)
    small = np.repeat(size <= 32, size)
    run, fps = run[small], fps[small]
    for step in range(1, 32):
        if len(run) <= step:
            break
        same = run[step:] == run[:-step]
        if not same.any():
            break
        near = same & (np.bitwise_count(fps[step:] ^ fps[:-step]) <= distance)
        out.append(np.column_stack((fps[step:][near], fps[:-step][near])))
    return np.concatenate(out)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, run: int = RUN) -> DataFrame:
    """Edges (a, b) between different fingerprints of a column ``fp`` of
    distinct longs, that connect what links of ``distance`` bits connect."""
    if distance > 3:
        raise ValueError("the keys are made for three differing bits at most")

    codes = golay_keys()

    def explode(batches):
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            row, key = keys_of(x, *codes)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x[row].view(np.int64))], names=["key", "fp"])

    def compare(batches):
        held = None
        for b in [*batches_of(batches), None]:
            if b is None:
                keys, x = held if held else (np.empty((0, 3), np.int64), np.empty(0, np.uint64))
                held = None
            else:
                keys, x = (np.concatenate(y) for y in zip(held, b)) if held else b
                last = runs_of(keys)[0][-1]  # the last run may go on in the next batch
                held = keys[last:], x[last:]
                keys, x = keys[:last], x[:last]
            if len(x) > 1:
                e = np.unique(linked(keys, x, distance), axis=0)
                if len(e):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

    def batches_of(batches):
        for b in batches:
            if b.num_rows:
                yield np.column_stack([b.column(i).to_numpy() for i in (0, 1, 2)]), b.column(3).to_numpy().view(np.uint64)

    keyed = fps.select("fp").mapInArrow(explode, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / run).cast("int")
    at = keyed.join(sizes, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    dealt = at.select("key", "fp", "block", other).select(
        "key", F.least("block", "o").cast("long").alias("p"), F.greatest("block", "o").cast("long").alias("q"), "fp"
    )
    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id for each row of ``docs(doc_id, text)``."""
    marked = cut(with_fingerprint(docs, width))
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comps = components(fingerprint_links(least, distance))
    classes = least.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(classes.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def may_be_alike(least: float) -> Column:
    """``lines.may_link``, and whether the maps of shingles allow a link: a bit of one
    that the other lacks is a shingle that the other lacks, so that many such bound the
    share of shingles in both from above. It leaves out no two texts that are alike."""
    from .lines import may_link

    missing = lambda a, b: sum(F.bit_count(F.col(f"{m}_{a}").bitwiseAND(F.bitwise_not(f"{m}_{b}"))) for m in MAP)
    enough = lambda a, b: 1000 * (F.col(f"len_{a}") - missing(a, b)) >= round(1000 * least) * (F.col(f"len_{b}") + missing(a, b))
    return may_link(least) & enough("a", "b") & enough("b", "a")


def similar_documents(docs: DataFrame, width: int = STAGE_WIDTH, least: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id for each row of ``docs(doc_id, text)``; two texts are
    linked if ``least`` of all their distinct shingles are in both. Candidates share a
    Golay key of their SimHashes, as all within ``DISTANCE`` bits do, or, as texts that
    are so alike may differ in more bits, one of ``MINIMA`` smallest shingles."""
    from .lines import among, line_links

    codes = golay_keys()
    salts = np.random.default_rng(SEED).integers(0, 1 << 63, (MINIMA, 2), dtype=np.uint64)

    def task(batches):
        for b in batches:
            out = []
            for x in b.column(1):
                all_ = digests(x.as_py(), width)
                some = np.unique(all_)
                node = xxh(some.tobytes())  # texts of equal shingles are one node
                keys = [((some ^ c) * (a | np.uint64(1))).min() ^ np.uint64(k) for k, (a, c) in enumerate(salts)] if len(some) else []
                held = np.zeros(64 * len(MAP), np.uint8)
                held[(some >> np.uint64(32)) % np.uint64(len(held))] = 1
                out.append((node, np.uint64(majority(all_)).astype(np.int64).item(), len(some), np.array(keys, np.uint64).view(np.int64).tolist(), *np.packbits(held).view(np.int64).tolist()))
            row, golay = keys_of(np.array([x[1] for x in out], np.int64).view(np.uint64), *codes)
            for i, key in zip(row.tolist(), (golay | GOLAY_KEY).tolist()):
                if out[i][2]:  # texts without shingles are one node
                    out[i][3].append(key)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *(pa.int64() for _ in MAP)]
            cols = list(zip(*out)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "h", "fp", "len", "keys", *MAP])

    def xxh(raw: bytes) -> int:
        import xxhash

        return np.uint64(xxhash.xxh64_intdigest(raw, SEED)).astype(np.int64).item()

    def shingles(batches):
        for b in batches:
            sets = [np.unique(digests(x.as_py(), width)) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxh(x.tobytes()) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["h", "text"])

    def texts_of(hashes: DataFrame) -> DataFrame:
        wanted = marked.select("doc_id", "h").join(hashes, "h", "left_semi").groupBy("h").agg(F.min("doc_id").alias("__d"))
        # Most texts are dropped before they are shuffled.
        rows = among(docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text"), wanted.select(F.xxhash64("__d").alias("h"))).drop("h")
        rows = rows.join(wanted.select("__d").distinct(), F.col("doc_id").eqNullSafe(F.col("__d"))).select("text")
        made.append(stored(rows.mapInArrow(shingles, "h long, text array<long>").dropDuplicates(["h"]).join(wanted, "h").select("h", "text"), "facts"))
        return made[-1]

    def alike(pairs: DataFrame, least: float) -> DataFrame:
        both, all_ = F.size(F.array_intersect("s", "t")), F.size("s") + F.size("t")
        return pairs.where(1000 * both >= round(1000 * least) * (all_ - both)).select("a", "b")

    marked = stored(docs.select("doc_id", "text").mapInArrow(task, "doc_id long, h long, fp long, len int, keys array<long>, " + ", ".join(f"{m} long" for m in MAP)))
    keys = marked.select("h", F.explode("keys").alias("key")).distinct()
    made = []

    def marks_of(hashes: DataFrame) -> DataFrame:
        # Texts of equal shingles may repeat them differently: one of their SimHashes.
        made.append(stored(marked.select("h", "fp", "len", *MAP).join(hashes, "h", "left_semi").groupBy("h").agg(F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("len", *MAP))), "marks"))
        return made[-1]

    comps = line_links(keys, marks_of, texts_of, least, alike, may_be_alike)
    drop(*made)
    rooted = marked.join(comps, F.col("h") == F.col("node"), "left").select("doc_id", F.coalesce("component", "h").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each component, the document with the smallest doc_id. Rows that
    share that doc_id stay together, also if their texts are of other components; a
    component without any doc_id keeps all its rows."""
    found = similar_documents(docs)
    keep = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__d")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__d"]), "left_semi").select(*docs.columns)
