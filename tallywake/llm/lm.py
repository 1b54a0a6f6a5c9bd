"""Language-model scores by a weighted backoff automaton.

The model is a smoothed bigram model over all training tokens, read as an
automaton: the root has an arc for every word with its smoothed probability, an
unknown word's arc included; the state of a word h has an arc for every w that
follows h in training, with (c(h,w) + MU p(w)) / (c(h) + MU), and for all other
words a failure arc to the root with MU / (c(h) + MU). A text is read once from
left to right; the state is the last word, and log10 weights are added up.

The automaton grows with the corpus, so it is never held in one place. Texts are
read once, in blocks of about ``BLOCK_WORDS`` words that are put aside in the
shared folder as numbers. Each block sends out its own distinct words and pairs,
sorted by hash and packed; slices of the hash space are counted over all blocks
(a hot word or pair is one entry for each block, not a row for each place), and
each block gets back the counts of just the arcs that its texts can take.

A block's name is a digest of what it holds, so a task that runs again after a lost
executor writes the same file; if its input had changed, a block would miss arcs,
which is an error and never a wrong score.

Words and pairs are known by 64-bit XXH64 values of their UTF-8 bytes.

Defined results: null texts are empty, and an empty text is its end alone. Rows
that repeat are rows of their own; a null doc_id is a training row. Without
training rows all counts are zero. Empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, work_dir

ADD = 0.5
#: Weight of the shorter context in the states' arcs.
MU = 1000.0
BLOCK_WORDS = 3_000_000
#: Documents for each slice of the hash space, about.
SLICE_DOCS = 64
END, START = b"\n", b"\r"  # no token holds a blank
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One hash for each pair of word hashes."""
    x = before * np.uint64(0x9E3779B97F4A7C15) ^ (after + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pack(x: np.ndarray) -> bytes:
    """Sorted or small unsigned numbers: differences or values, by byte plane."""
    import zstandard

    x = np.ascontiguousarray(x, np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes()) if len(x) else b""


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    if not b:
        return np.empty(0, np.uint64)
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; cumulated sums give them back."""
    return np.diff(x, prepend=np.uint64(0))


def write_blocks(docs: DataFrame, folder: str, bits: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Puts blocks aside and gives (slice, kind, block, keys, counts): a block's
    distinct words (kind 0) and pairs (kind 1) with their training counts."""

    def task(batches):
        import xxhash
        from pyarrow import fs

        class Memo(dict):
            def __missing__(self, word):
                self[word] = h = xxhash.xxh64_intdigest(word)
                return h

        store, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        memo = Memo()
        start = np.uint64(memo[START])
        held: list[tuple] = []
        words = 0

        def out():
            nonlocal held, words
            ids, flags, parts = zip(*held)
            held, words = [], 0
            all_words = np.concatenate(parts)
            digest = hashlib.blake2b(repr(ids).encode() + all_words.tobytes(), digest_size=12).hexdigest()
            name = f"{TaskContext.get().partitionId()}-{digest}"
            ends = np.cumsum([len(p) for p in parts])
            before = np.concatenate(([start], all_words[:-1]))
            before[ends[:-1]] = start
            train = np.repeat(~np.array(flags), [len(p) for p in parts])
            uw, word = np.unique(all_words, return_inverse=True)
            up, pair = np.unique(pair_hash(before, all_words), return_inverse=True)
            import io

            import zstandard

            raw = io.BytesIO()
            np.savez(raw, ids=np.array([0 if i is None else i for i in ids], np.int64), none=np.array([i is None for i in ids]), held_out=np.array(flags), ends=ends, word=word.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy(), pair=pair.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy(), kinds=np.array([len(uw), len(up)]))
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(zstandard.ZstdCompressor(level=1).compress(raw.getvalue()))
            for kind, (keys, at) in enumerate(((uw, word), (up, pair))):
                counts = np.bincount(at[train], minlength=len(keys)).astype(np.uint64)
                cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.array([0])
                rows = [(s, kind, name, pack(steps(keys[a:b])), pack(counts[a:b])) for s, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(keys)))) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["slice", "kind", "block", "keys", "counts"])

        for b in batches:
            for i, text, flag in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                tokens = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                tokens.append(END)
                held.append((i, flag, np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))))
                words += len(tokens)
                if words >= block_words:
                    yield from out()
                if len(memo) > 500_000:
                    memo.clear()
        if held:
            yield from out()

    return docs.select("doc_id", "text", "held_out").mapInArrow(task, "slice int, kind int, block string, keys binary, counts binary")


def count_arcs(sent: DataFrame) -> DataFrame:
    """(block, kind, slice, counts) with corpus counts in the order of the
    block's keys, and rows without block that have a slice's n and v."""

    def task(batches):
        names = ["block", "kind", "slice", "counts", "n", "v"]
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

        def done(at, rows):
            keys = [np.cumsum(unpack(k), dtype=np.uint64) for _, k, _ in rows]
            all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(all_keys), np.uint64)
            np.add.at(total, place, np.concatenate([unpack(c) for _, _, c in rows]))
            out, a = [], 0
            for (block, _, _), k in zip(rows, keys):
                out.append((block, at[0], at[1], pack(total[place[a : a + len(k)]]), None, None))
                a += len(k)
            out.append((None, at[0], at[1], None, int(total.sum()), int((total > 0).sum())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        at, held = None, []
        for b in batches:
            for kind, s, block, k, c in zip(*(b.column(i).to_pylist() for i in range(5))):
                if at != (kind, s):
                    if held:
                        yield done(at, held)
                    at, held = (kind, s), []
                held.append((block, k, c))
        if held:
            yield done(at, held)

    by_slice = sent.select("kind", "slice", "block", "keys", "counts").repartition("kind", "slice").sortWithinPartitions("kind", "slice")
    return cut(by_slice.mapInArrow(task, "block string, kind int, slice int, counts binary, n long, v long"))


def traverse(ends: np.ndarray, word: np.ndarray, pair: np.ndarray, mu: float, n: int, v: int, texts: int, c: np.ndarray, pairs: np.ndarray):
    """Reads the texts of a block from left to right: (known tokens, base score,
    score) of each. c and pairs are the corpus counts of words and pairs."""
    starts = np.concatenate(([0], ends[:-1]))
    seen = c[word].astype(np.float64)
    root = (seen + ADD) / (n + ADD * (v + 1))
    state = np.concatenate(([0.0], seen[:-1]))  # how often the state's word was left in training
    state[starts] = texts
    arc = pairs[pair].astype(np.float64)
    weight = np.where(arc > 0, np.log10((arc + mu * root) / (state + mu)), np.log10(mu / (state + mu)) + np.log10(root))
    return np.add.reduceat((seen > 0).astype(np.int64), starts), np.add.reduceat(np.log10(root), starts), np.add.reduceat(weight, starts)


def score(docs: DataFrame, mu: float = MU, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, held_out)``; the rows that are
    not held out are the training corpus."""
    spark = docs.sparkSession
    folder = work_dir(spark, "lm-blocks")
    rows = docs.count()
    bits = max(0, min(24, math.ceil(math.log2(max(1, rows / SLICE_DOCS)))))
    counted = count_arcs(write_blocks(docs, folder, bits, block_words))
    stats = counted.where("block is null").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = next(((r["n"], r["v"]) for r in stats if r["kind"] == 0), (0, 0))
    texts = docs.where("not held_out").count()

    def task(batches):
        import io

        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")

        def done(block, parts):
            with store.open_input_file(f"{root}/{block}") as f:
                x = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(f.read())))
            c, pairs = (np.concatenate([unpack(p) for k, p in parts if k == kind]) for kind in (0, 1))
            if [len(c), len(pairs)] != x["kinds"].tolist():
                raise ValueError(f"block {block} did not get all its arcs")
            word, pair = (np.ascontiguousarray(x[k].T).view(np.uint32).ravel() for k in ("word", "pair"))
            ends = x["ends"]
            known, base, full = traverse(ends, word, pair, mu, n, v, texts, c, pairs)
            cols = [pa.array(x["ids"], mask=x["none"]), pa.array(x["held_out"]), pa.array(np.diff(ends, prepend=0)), pa.array(known), pa.array(np.full(len(ends), n)), pa.array(base), pa.array(full)]
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in RESULT.split(", ")])

        at, held = None, []
        for b in batches:
            for block, kind, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
                if block != at:
                    if held:
                        yield done(at, held)
                    at, held = block, []
                held.append((kind, counts))
        if held:
            yield done(at, held)

    by_block = counted.where("block is not null").select("block", "kind", "counts", "slice").repartition("block").sortWithinPartitions("block", "kind", "slice")
    return by_block.select("block", "kind", "counts").mapInArrow(task, RESULT)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    return score(docs.select("doc_id", "text", held_out.alias("held_out")))


