"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``
of plain bytes; an archive of about ``ARCHIVE_BYTES`` compressed bytes ends with
a seek table in a skippable frame (the public "seekable format"), and an index
row for each record names archive, frame and the offset inside the plain frame.
One record can so be read by one ranged read and one frame's decompression.

Rows are archived where they lie, a task at a time, with one frame in memory;
archives get a name of their own for each attempt and only those that the
index (cut to the shared folder) names are read, so a task that runs twice
after a lost executor leaves an unread file and never a wrong record.

Defined results: null html is an empty payload; null url an empty target; a row
with null page_id is archived and read back with null page_id, and is never the
response that others refer to (it is a response itself if no page with an id has
its payload); rows that repeat a page_id with the same payload as the response
are responses too; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, work_dir

FRAME_BYTES = 256 * 1024
ARCHIVE_BYTES = 8 * 1024 * 1024
#: Payloads shorter than this are always stored whole.
LEAST_BYTES = 100
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, archive string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, plain) bytes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """The (compressed, plain) bytes of each frame, from an archive's end."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("the archive has no seek table")
    each = 12 if flags & 0x80 else 8
    start = len(tail) - 9 - n * each
    if start < 8 or struct.unpack("<I", tail[start - 8 : start - 4])[0] != SKIPPABLE:
        raise ValueError("the seek table is cut off")
    return [struct.unpack_from("<II", tail, start + i * each) for i in range(n)]


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit where ``refers_to`` is given."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0):
    """Reads the record at ``at``: (headers, payload, full payload bytes, next)."""
    end = plain.index(b"\r\n\r\n", at)
    lines = plain[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, n = end + 4, int(head["Content-Length"])
    http = plain.index(b"\r\n\r\n", start) + 4
    full = int(plain[start:http].rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    return head, plain[http : start + n], full, start + n + 4


def _number(urn: str):
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def write_archives(pages: DataFrame, out_dir: str, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html, payload_digest, refers_to)`` and
    returns the index. ``out_dir`` is any URI that Arrow's file systems know."""

    def task(batches):
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:") else f"file://{out_dir}")
        store.create_dir(root, recursive=True)
        zip_ = zstandard.ZstdCompressor(level=3)
        name = out = None
        frames, done, plain, held = [], 0, bytearray(), []

        def flush():
            nonlocal plain, held, done
            z = zip_.compress(bytes(plain))
            rows = [(p, name, len(frames), done, len(z), o, n) for p, o, n in held]
            out.write(z)
            frames.append((len(z), len(plain)))
            done += len(z)
            plain, held = bytearray(), []
            return rows

        def close():
            nonlocal out, frames, done
            out.write(seek_table(frames))
            out.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            out, frames, done = None, [], 0

        def arrow(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

        names = ["page_id", "archive", "frame", "frame_start", "frame_bytes", "offset", "length"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for p, u, h, d, r in zip(*(b.column(i) for i in range(5))):
                x = record(p.as_py(), u.as_py(), (h.as_py() or "").encode("utf-8", "surrogatepass"), d.as_py(), r.as_py())
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{root}/.{name}", compression=None)
                held.append((p.as_py(), len(plain), len(x)))
                plain += x
                if len(plain) >= frame_bytes:
                    rows += flush()
                    if done >= archive_bytes:
                        close()
            yield arrow(rows)
        if out is not None:
            rows = flush() if held else []
            close()
            yield arrow(rows)

    return cut(pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(task, INDEX))


def read_archives(spark: SparkSession, index: DataFrame, out_dir: str) -> DataFrame:
    """Reads every record of the archives that the index names, frame by frame,
    and takes length and digest from the payload bytes themselves; a revisit's,
    which has none, from its headers."""

    def task(batches):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for content in b.column(0):
                view, at = content.as_buffer(), 0
                for z, n in read_seek_table(bytes(view)):
                    plain, at, pos, rows = unzip.decompress(view[at : at + z], max_output_size=n), at + z, 0, []
                    while pos < len(plain):
                        head, payload, full, pos = parse(plain, pos)
                        said, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else said
                        if digest != said:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                        to = head.get("WARC-Refers-To")
                        url = head["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                        rows.append((_number(head["WARC-Record-ID"]), full, digest, kind, _number(to) if to else None, url))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(out_dir)
        .select("content", F.element_at(F.split("path", "/"), -1).alias("archive"))
        .join(index.select("archive").distinct(), "archive", "left_semi")
    )
    return files.select("content").mapInArrow(task, RECORD)


def fetch(index: DataFrame, out_dir: str) -> DataFrame:
    """Random access: for rows of the index, reads only the frame of each and
    returns ``page_id, html``; html is null for revisits."""

    def task(batches):
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:") else f"file://{out_dir}")
        for b in batches:
            ids, texts = [], []
            for row in b.to_pylist():
                with store.open_input_file(f"{root}/{row['archive']}") as f:
                    z = f.read_at(row["frame_bytes"], row["frame_start"])
                plain = zstandard.ZstdDecompressor().decompress(z)
                head, payload, _, _ = parse(plain, row["offset"])
                ids.append(_number(head["WARC-Record-ID"]))
                texts.append(payload.decode("utf-8", "surrogatepass") if head["WARC-Type"] == "response" else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["page_id", "html"])

    return index.select("archive", "frame_start", "frame_bytes", "offset").mapInArrow(task, "page_id long, html string")


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds ``payload_digest`` and ``refers_to``: the smallest page_id with an
    equal payload of at least ``least_bytes`` bytes, null for that page itself.
    Only ids and digests are grouped; the groups are minima, never lists."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    seen = rows.where(F.octet_length(html) >= least_bytes).select("page_id", "payload_digest")
    first = seen.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = (
        seen.join(first, "payload_digest").where("page_id is null or page_id <> first")
        .groupBy(F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).agg(F.min("first").alias("refers_to"))
    )
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left").drop("p", "d")


def archive_pages(spark: SparkSession, pages: DataFrame, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Writes all pages and reads the archives back: (records, index)."""
    index = write_archives(with_revisits(pages), out_dir)
    if index.isEmpty():
        return spark.createDataFrame([], RECORD), index
    return read_archives(spark, index, out_dir), index


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive_pages(spark, table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return records.drop("url")


SQL1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
