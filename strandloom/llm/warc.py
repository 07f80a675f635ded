"""WARC archives and their two-level capture index.

Archives hold one gzip member per record, as is usual, so a record can be read by offset and length alone.
Spark's text writer writes them, a file per task: a row is a member without its last byte, and the line
separator is that byte.  (The last byte of a gzip member is the high byte of its size, zero below 16 MB; a
larger record is followed by an empty member, which ends in zero too.)

The index has two levels.  Captures are sorted by reversed-host URL key and packed into compressed blocks of
``BLOCK_LINES`` lines; the sparse directory has the first and last key of each block.  A lookup searches the
directory, opens one block or a few, searches the sorted lines, and reads only the records' ranges.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest page id is the response
and the others are revisits that refer to it.

Defined cases: null html is an empty payload; a null id is smaller than any; rows that repeat an id and a
payload are equal captures (all responses if they are the largest); a null URL has an empty key; control
characters in URLs are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm.scratch import written
from strandloom.llm.url_filter import split_url

#: Payload bytes of an archive file, on average over its records.
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 3000
PREFIX = "urn:page:"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
ENTRY = "key string, page_id long, record_type string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed host labels, then path and query: captures of a site sort together."""
    host, _ = split_url(url)
    if not host:
        return url or ""
    rest = url.partition("://")[2][len(host) :]
    return ",".join(reversed(host.split("."))) + ")" + rest


def _header_text(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record."""
    name = "-" if page_id is None else page_id
    block = HTTP_HEAD.format(len(payload)).encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PREFIX}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{PREFIX}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += pack.flush()
    return out


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    pairs = (line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in pairs}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and data of the members of an archive; empty members belong to the one before."""
    view, at, held = memoryview(content), 0, None
    while at < len(view):
        unpack, pos, data = zlib.decompressobj(31), at, []
        while not unpack.eof and pos < len(view):
            part = view[pos : pos + 65536]
            data.append(unpack.decompress(part))
            pos += len(part)
        pos -= len(unpack.unused_data)
        whole = b"".join(data)
        if whole or held is None:
            if held is not None:
                yield held
            held = (at, pos - at, whole)
        else:
            held = (held[0], pos - held[0], held[2])
        at = pos
    if held is not None:
        yield held


def page_id_of(text: str) -> int | None:
    name = text.strip("<>").removeprefix(PREFIX)
    return None if name == "-" else int(name)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 4, date: str = "1970-01-01T00:00:00Z", cols: tuple[str, str, str] = ("page_id", "url", "html")) -> None:
    """Write a record per row, in files of about ``ARCHIVE_BYTES`` of payload.

    Payloads are equal where length, SHA-1 and SHA-256 are; only repeats are joined back.
    """
    rows = pages.select(F.col(cols[0]).cast("bigint").alias("page_id"), F.col(cols[1]).cast("string").alias("url"), F.coalesce(F.col(cols[2]).cast("binary"), F.lit(b"")).alias("html"))
    keys = rows.select("page_id", F.concat_ws(" ", F.octet_length("html").cast("string"), F.sha1("html"), F.sha2("html", 256)).alias("digest"), F.octet_length("html").alias("n"))
    groups = keys.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1")
    repeats = keys.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    repeats = written(repeats.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.concat_ws(" ", F.octet_length("html").cast("string"), F.sha1("html"), F.sha2("html", 256)) == F.col("_digest"))
    judged = rows.join(repeats, same, "left").select("page_id", "url", "html", "refers_to", F.col("_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                out = [_member(make_record(i, u, h, r, v, date), level)[:-1] for i, u, h, r, v in zip(*[c.to_pylist() for c in part.columns])]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    made = judged.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    # A file is one row when it is read back, so its size is bounded; records per file come from the mean length.
    mean = rows.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    per_file = max(1, int(ARCHIVE_BYTES / (mean + 512)))
    made.write.option("lineSep", "\u0000").option("compression", "none").option("maxRecordsPerFile", per_file).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the archive files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """An index line per record, from one pass over the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, length, data in members(content.as_buffer()):
                    fields, _ = parse_record(data)
                    rows.append((url_key(fields.get("warc-target-uri")), page_id_of(fields["warc-record-id"]), fields["warc-type"], file, offset, length))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ENTRY.split(", ")])

    return archives(spark, path).mapInArrow(run, ENTRY)


def write_index(lines: DataFrame, path: str) -> None:
    """Sort the captures by key and pack them: a row per block with its key range and compressed lines."""

    def pack(rows: list[tuple]) -> tuple:
        text = "\n".join("\t".join("" if x is None else str(x).replace("\t", "%09").replace("\n", "%0A") for x in r) for r in rows)
        return rows[0][0], rows[-1][0], len(rows), zlib.compress(text.encode("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(parts):
            kinds = [pa.string(), pa.string(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts), kinds)], names=["first_key", "last_key", "n", "lines"])

        for batch in batches:
            held += zip(*[c.to_pylist() for c in batch.columns])
            while len(held) >= BLOCK_LINES:
                yield out([pack(held[:BLOCK_LINES])])
                held = held[BLOCK_LINES:]
        if held:
            yield out([pack(held)])

    order = ["key", "file", "offset"]
    blocks = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks.mapInArrow(run, "first_key string, last_key string, n int, lines binary").write.option("compression", "none").parquet(path)


def unpack(block: bytes) -> list[tuple]:
    """The lines of a block, in key order."""
    rows = (line.split("\t") for line in zlib.decompress(block).decode("utf-8").split("\n"))
    return [(k, int(i) if i else None, t, f, int(o), int(n)) for k, i, t, f, o, n in rows]


def index_lines(index: DataFrame) -> DataFrame:
    """All captures of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*unpack(block)), kinds)], names=[c.split()[0] for c in ENTRY.split(", ")])

    return index.select("lines").mapInArrow(run, ENTRY)


def read_records(lines: DataFrame, path: str) -> DataFrame:
    """The records of index lines, cut out of their archives by range.

    Lines meet their archive by file; those of one file are as many as one task wrote into it.
    """
    ranges = lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
    files = archives(lines.sparkSession, path)
    met = files.join(ranges, files["path"] == ranges["file"]).select("content", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, ranges in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                for at in range(0, len(ranges), 256):
                    out = []
                    for r in ranges[at : at + 256]:
                        data = b"".join(d for _, _, d in members(view[r["offset"] : r["offset"] + r["length"]]))
                        fields, payload = parse_record(data)
                        revisit = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and base32_sha1(payload) != digest:
                            raise ValueError(f"digest of {fields['warc-record-id']} does not fit its payload")
                        size = int(fields["x-payload-length"]) if revisit else len(payload)
                        refers = page_id_of(fields["warc-refers-to"]) if revisit else None
                        out.append((page_id_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], size, digest, refers, None if revisit else payload))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return met.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def lookup(spark: SparkSession, index_path: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and payload of every capture of a URL: directory, block, binary search, range reads.

    Runs on the driver, for single URLs.  The directory search is a filter that Parquet's statistics serve.
    """
    key = url_key(_header_text(url))
    blocks = spark.read.parquet(index_path).filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("lines")
    jvm, out = spark._jvm, []
    for row in blocks.toLocalIterator():
        lines = unpack(bytes(row["lines"]))
        lo, hi = (side(lines, key, key=lambda x: x[0]) for side in (bisect.bisect_left, bisect.bisect_right))
        for _, _, _, file, offset, length in lines[lo:hi]:
            at = jvm.org.apache.hadoop.fs.Path(file)
            stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
            try:
                stream.seek(offset)
                data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
            finally:
                stream.close()
            out.append(parse_record(b"".join(d for _, _, d in members(data))))
    return out
