"""SentencePiece encoding and decoding by a relational lattice.

The text is changed as the model says (a blank in front, blanks written as the
sign U+2581) and cut into units between any two characters that stand side by
side in no piece; no piece goes across such a cut, so a text's encoding is that
of its units. Distinct units are encoded once for the whole corpus: their
substrings of bounded length are exploded, equi-joined to the piece table (a
fixed vocabulary, broadcast), the edges are grouped by unit, and Spark's
higher-order aggregate folds the lattice.

The public model is of the BPE kind. A best path by added scores (Viterbi) over
its pieces is not the model's encoding, because its scores are merge ranks; so
the fold takes the edges of the lattice in the order of their ranks, the leftmost
of equals first, and keeps those that join exactly two neighbours. That is SentencePiece's result (the tests
compare with the library). Characters without a piece become byte pieces.

Texts never move. Rows are named by file and block of ``ROWS`` rows; each block's
distinct units are dealt out by unit, joined to their encodings and written as a
file of the block in the shared folder; a second scan of the texts looks units up
there. A unit that all blocks have is one row for each block, never a list; a
block's file is no larger than the block's own texts. Frames that do not come from
Parquet files are written to the shared folder first.

Defined results: null and empty texts have no pieces. Units of more than
``LONGEST`` characters (long runs without a blank of letters that pieces join; text
in Chinese or Japanese is cut nearly everywhere) are encoded by the same merges in
the second scan. A text
that itself holds the sign U+2581 is decoded with a blank there, as the library
does; round_trip is then false. Repeated rows and null doc_ids are kept; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import stored, table, work_dir

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Units up to this length are folded; boundaries are the bits of one long.
LONGEST = 61
#: Partitions of units for each usual one: a unit has some 25 edges, which a task sorts
#: together, so that a partition of units is much more than it looks.
FINER = 8
#: Rows of a file that share one file of unit encodings.
ROWS = 8192


def read_model(path: str = MODEL) -> tuple[list[tuple[int, str, int]], list[int], list[str]]:
    """(id, piece, rank) of the ordinary pieces, ids of the 256 byte pieces, and
    the text of every id. Smaller ranks are merged first."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    text = [m.id_to_piece(i) for i in range(n)]
    other = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
    score = [m.get_score(i) for i in range(n)]
    place = {s: k for k, s in enumerate(sorted({score[i] for i in range(n) if not other[i]}, reverse=True))}
    ordinary = [(i, text[i], place[score[i]]) for i in range(n) if not other[i]]
    return ordinary, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], text


def call(name: str, *args) -> Column:
    return F.call_function(name, *(a if isinstance(a, Column) else F.lit(a) for a in args))


def cutter(ordinary: list[tuple[int, str, int]]):
    """A function from a text, as the model changes it, to its units: cut between
    characters that stand side by side in no piece."""
    joined = sorted({p[i : i + 2] for _, p, _ in ordinary for i in range(len(p) - 1)})
    chars = sorted({c for pair in joined for c in pair})
    number = {c: k for k, c in enumerate(chars, 1)}
    one, two = (np.array([number[pair[i]] for pair in joined], np.int64) for i in (0, 1))
    tables = []

    def units(text: str) -> list[str]:
        if not tables:  # made by the task, as they are larger than what they are made of
            kind = np.zeros(0x110000, np.uint16)
            kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
            stays = np.zeros((len(chars) + 1, len(chars) + 1), bool)
            stays[one, two] = True
            tables.extend((kind, stays.ravel()))
        kind, stays = tables
        code = kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = (np.flatnonzero(~stays[code[:-1].astype(np.int32) * np.int32(len(chars) + 1) + code[1:]]) + 1).tolist()
        return [text[a:z] for a, z in zip([0, *at], [*at, len(text)])]

    return units


def lattice(units: DataFrame, pieces: DataFrame, longest_piece: int) -> DataFrame:
    """Edges grouped by unit: ``units(unit)``, distinct and dealt out by unit, with
    ``edges``, an array of longs by rank and start, without a shuffle of its own.

    An edge is one long: rank, start, width, id and whether its piece is odd. Units
    are sorted before they are exploded, so that the grouping, which sorts edges by
    unit beyond a few units, finds them in order and holds one unit at a time.
    """
    n, start = F.length("unit"), F.col("start")
    starts = F.explode(F.sequence(F.lit(0), F.when(n <= LONGEST, n).otherwise(0))).alias("start")
    # Start 0 has the empty piece alone, which keeps units without any edge.
    widths = F.explode(F.sequence(F.least(start, F.lit(1)), F.when(start > 0, F.least(F.lit(longest_piece), n - start + 1)).otherwise(0))).alias("width")
    spans = units.sortWithinPartitions("unit").select("unit", starts).select("unit", "start", widths)
    spans = spans.select("unit", (start - 1).alias("start"), "width", call("substring", F.col("unit"), start, F.col("width")).alias("piece"))
    code = (((F.col("rank").cast("long") * 64 + F.col("start")) * 32 + F.col("width")) * (1 << 20) + F.col("id")) * 2 + F.col("odd").cast("long")
    edges = spans.join(F.broadcast(pieces), "piece").select("unit", F.when(F.col("start") >= 0, code).alias("code"))
    return edges.groupBy("unit").agg(F.sort_array(F.collect_list("code")).alias("edges"))


def fold(byte_ids: list[int]) -> Column:
    """The ids of a unit from its lattice; null for units that are too long.

    The edges come in the order of their ranks, and boundaries are the bits of a
    long. An edge that joins exactly two neighbours at its turn takes the boundary
    between them away. One turn for each edge is enough, unless the lattice has an
    odd piece (see ``odd_pieces``); then the best edge is searched for each step.
    """
    n, edges = F.length("unit"), F.col("edges")

    def start(e: Column) -> Column:
        return F.shiftright(e, 26).bitwiseAND(63).cast("int")

    def width(e: Column) -> Column:
        return F.shiftright(e, 21).bitwiseAND(31).cast("int")

    def bits(ones: Column) -> Column:
        return call("shiftleft", F.lit(1).cast("long"), ones)

    wide = F.filter(edges, lambda e: width(e) > 1)

    def inner(e: Column) -> Column:
        return call("shiftleft", bits(width(e)) - 2, start(e))

    def ends(e: Column) -> Column:
        return call("shiftleft", bits(width(e)) + 1, start(e))

    def joins_two(e: Column, bounds: Column) -> Column:
        return (bounds.bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(bounds.bitwiseAND(inner(e))) == 1)

    def turn(bounds: Column, e: Column) -> Column:
        return F.when(joins_two(e, bounds), bounds.bitwiseAND(F.bitwise_not(inner(e)))).otherwise(bounds)

    def search(bounds: Column, _: Column) -> Column:
        best = F.get(F.filter(wide, lambda e: joins_two(e, bounds)), 0)
        return F.coalesce(bounds.bitwiseAND(F.bitwise_not(inner(best))), bounds)

    every = call("shiftleft", F.lit(2).cast("long"), n) - 1
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))

    def with_bytes(bounds: Column, path: Column) -> Column:
        """The ids where some character has no piece: its bytes are its pieces."""
        cuts = F.filter(F.sequence(F.lit(0), n), lambda i: call("shiftrightunsigned", bounds, i).bitwiseAND(F.lit(1)) == 1)

        def ids(a: Column) -> Column:
            found = F.get(F.filter(path, lambda e: F.shiftright(e, 20) == a), 0)
            code = F.hex(F.encode(call("substring", F.col("unit"), a + 1, F.lit(1)), "UTF-8"))
            table_ = F.array(*map(F.lit, byte_ids))
            as_bytes = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda k: F.get(table_, F.conv(call("substring", code, k, F.lit(2)), 16, 10).cast("int")))
            return F.when(found.isNotNull(), F.array(found.bitwiseAND((1 << 20) - 1).cast("int"))).otherwise(as_bytes)

        return F.flatten(F.transform(F.slice(cuts, 1, F.size(cuts) - 1), ids))

    def out(bounds: Column) -> Column:
        # The edges between neighbouring boundaries, as start and id, by start.
        span = lambda e: ends(e).bitwiseOR(inner(e))
        kept = F.filter(edges, lambda e: bounds.bitwiseAND(span(e)) == ends(e))
        path = F.sort_array(F.transform(kept, lambda e: start(e).cast("long") * (1 << 20) + F.shiftright(e, 1).bitwiseAND((1 << 20) - 1)))
        whole = F.size(kept) == F.bit_count(bounds) - 1
        return F.when(whole, F.transform(path, lambda x: x.bitwiseAND((1 << 20) - 1).cast("int"))).otherwise(with_bytes(bounds, path))

    odd = F.exists(edges, lambda e: e.bitwiseAND(1) == 1)
    return F.when((n <= LONGEST) & ~odd, F.aggregate(wide, every, turn, out)).when(n <= LONGEST, F.aggregate(steps, every, search, out))


def odd_pieces(ordinary: list[tuple[int, str, int]]) -> set[str]:
    """Pieces that might join after their turn.

    A piece joins late only if both its ends stayed boundaries until then, so all
    merges inside went as if it stood alone. If alone it comes about by merges in
    ascending order of (rank, start), it has joined at its turn already.
    """
    ranks = {p: (r, i) for i, p, r in ordinary}
    odd = set()
    for p in ranks:
        bounds, last = list(range(len(p) + 1)), (-1, -1)
        while len(bounds) > 2:
            ready = [(ranks[p[a:b]][0], a, k) for k, (a, b) in enumerate(zip(bounds, bounds[2:])) if p[a:b] in ranks]
            if not ready or min(ready)[:2] < last:
                odd.add(p)
                break
            last, k = min(ready)[:2], min(ready)[2]
            del bounds[k + 1]
    return odd


def merge(unit: str, ranks: dict[str, tuple[int, int]], byte_ids: list[int]) -> list[int]:
    """The ids of one unit of any length, by the same merges."""
    n = len(unit)
    nxt, prv, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(unit[i : end[j]])):
            heapq.heappush(heap, (r[0], i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, to = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue
        alive[j], end[i], nxt[i] = False, to, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    out: list[int] = []
    i = 0
    while i < n:
        r = ranks.get(unit[i : end[i]])
        out += [r[1]] if r else [byte_ids[b] for b in unit[i : end[i]].encode()]
        i = nxt[i]
    return out


def decoder(texts: list[str], byte_ids: list[int]):
    """A function from ids to text."""
    raw = [t.replace(BLANK, " ").encode() for t in texts]
    for value, i in enumerate(byte_ids):
        raw[i] = bytes([value])
    for i in range(3):
        raw[i] = b""  # unknown, start and end

    def decode(ids) -> str:
        text = b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")

    return decode


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text and the block of rows, a number from file and row index."""
    spark = docs.sparkSession
    try:
        rows = docs.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        path = work_dir(spark, "texts")
        docs.select("doc_id", "text").write.parquet(path)
        rows = spark.read.schema("doc_id long, text string").parquet(path).select("doc_id", "text", "_metadata.file_path", "_metadata.row_index")
    block = F.xxhash64("file_path", (F.col("row_index") / ROWS).cast("long"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block.alias("block"))


def units_of_blocks(rows: DataFrame, ordinary: list[tuple[int, str, int]]) -> DataFrame:
    """(unit, block): the distinct units of each block, task by task."""
    units = cutter(ordinary)

    def task(batches):
        held: dict[int, set[str]] = {}

        def out(names):
            for name in names:
                some = list(held.pop(name))
                for at in range(0, len(some), 50_000):
                    part = some[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(np.full(len(part), name, np.int64))], names=["unit", "block"])

        for b in batches:
            for text, name in zip(b.column(0), b.column(1).to_pylist()):
                if x := text.as_py():
                    if name not in held:
                        yield from out(list(held))
                        held[name] = set()
                    held[name].update(units(BLANK + x.replace(" ", BLANK)))
        yield from out(list(held))

    return rows.select("text", "block").mapInArrow(task, "unit string, block long")


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids array<int> and round_trip for every row of
    ``docs(doc_id, text)``; decoding is part of it and checked."""
    spark = docs.sparkSession
    ordinary, byte_ids, texts = read_model(model)
    if max(len(p) for _, p, _ in ordinary) > 31 or len(texts) > 1 << 20:
        raise ValueError("edges are packed for pieces of 31 characters and 2**20 ids at most")
    odd = odd_pieces(ordinary)
    rows = located(docs)
    pieces = spark.createDataFrame([(p, i, r, p in odd) for i, p, r in ordinary] + [("", -1, -1, False)], "piece string, id int, rank int, odd boolean")
    # Both uses of what is dealt out need both columns, so that it is dealt out once.
    parts = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(units_of_blocks(rows, ordinary), "units").repartition(parts, "unit")
    distinct = dealt.groupBy("unit").agg(F.count("block").alias("blocks")).where("blocks > 0").select("unit")
    coded = lattice(distinct, pieces, max(len(p) for _, p, _ in ordinary)).select("unit", fold(byte_ids).alias("ids"))
    path = work_dir(spark, "encodings")
    dealt.join(coded, "unit").select("block", "unit", "ids").repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    ranks, units = {p: (r, i) for i, p, r in ordinary}, cutter(ordinary)

    def task(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        back = decoder(texts, byte_ids)

        def load(name):
            """The units of a block and the bytes of their ids."""
            out = {}
            for f in store.get_file_info(fs.FileSelector(f"{root}/block={name}", allow_not_found=True)):
                if f.base_name.endswith(".parquet"):
                    with store.open_input_file(f.path) as x:
                        for b in pq.ParquetFile(x, pre_buffer=False).iter_batches(65536, columns=["unit", "ids"]):
                            ids = b.column("ids")
                            raw, ends = ids.values.to_numpy().astype(np.int32).tobytes(), (4 * ids.offsets.to_numpy()).tolist()
                            for unit, a, z in zip(b.column("unit").to_pylist(), ends, ends[1:]):
                                out[unit] = raw[a:z] if z > a else np.array(merge(unit, ranks, byte_ids), np.int32).tobytes()
            return out

        known, at = None, None
        # A batch has many more ids than rows, so few rows are held at once.
        for b in (x.slice(k, 512) for x in batches for k in range(0, x.num_rows, 512)):
            ids, same = [], []
            for text, name in zip(b.column(1), b.column(2).to_pylist()):
                x = text.as_py()
                if not x:
                    ids.append(np.empty(0, np.int32))
                    same.append(True)
                    continue
                if name != at:
                    known = None  # freed before the next is read
                    known, at = load(name), name
                one = np.frombuffer(b"".join(map(known.__getitem__, units(BLANK + x.replace(" ", BLANK)))), np.int32)
                ids.append(one)
                same.append(back(one.tolist()) == x)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate([*ids, np.empty(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(same)], names=["doc_id", "ids", "round_trip"])

    return rows.mapInArrow(task, "doc_id long, ids array<int>, round_trip boolean")


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text from ``coded(doc_id, ids)``; null ids give null."""
    _, byte_ids, texts = read_model(model)

    def task(batches):
        back = decoder(texts, byte_ids)
        for b in batches:
            out = [None if x is None else back(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the pieces of every document, with its length in pieces."""
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
