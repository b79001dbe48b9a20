"""WARC archives with Zstandard frames and a dictionary in a leading skippable frame.

An archive is a row (path, content) like one of Spark's binaryFile source. `write_archives` makes
them, `save_archives` writes each as a file through Spark's own committer, and `read_archives`
decodes them, whichever store they come from. Every record is a frame of its own, so that a reader
can start at any of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.kit import drop, lookup, marked, reserved, settled, written

# Magic numbers of the Zstandard format.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: The dictionary is trained on so many pages, in order of a hash, with so many characters of each.
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 256, 8192, 16_384
#: An archive ends after the record that brings it to so many bytes.
ARCHIVE_BYTES = 8 << 20
#: Ends a file: an empty skippable frame, which a decoder passes over. It is what Spark's text writer puts after a row.
FILE_END = struct.pack("<II", 0x184D2A50, 0)
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; too few to train one are one themselves, as raw content."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value without control characters or spaces."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record; a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_safe(url)}"] if url is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), revisit and refers_to. Of equal payloads of at least `least_bytes`, the rows with the largest page_id are responses (all of them, if that id repeats), the others revisit it."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    twice = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keeper")
    twice, _ = written(twice)
    joined = lookup(rows, twice, ["digest"])
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(records: DataFrame, dictionary: bytes) -> DataFrame:
    """Archives (path, content) of the records of `classified`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        out, size = [skippable(dictionary)], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                page_id, url, html, refers_to, revisit = (x.as_py() for x in row)
                out.append(packer.compress(record_bytes(page_id, url, html.encode(), refers_to, revisit)))
                size += len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": [f"part-{part:05d}-{n:05d}.warc.zst"], "content": [b"".join(out)]})
                    out, size, n = [skippable(dictionary)], 0, n + 1
        if size:
            yield pa.RecordBatch.from_pydict({"path": [f"part-{part:05d}-{n:05d}.warc.zst"], "content": [b"".join(out)]})

    return records.mapInArrow(encode, "path string, content binary")


def save_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of the folder, in any store that Spark can write to. Tasks that run again leave no halves: Spark commits files whole."""
    as_text = archives.select(F.col("content").cast("string").alias("value"))  # the bytes as they are
    as_text.write.option("lineSep", FILE_END.decode()).option("compression", "none").option("maxRecordsPerFile", 1).text(folder)


def open_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder as rows (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0").select("path", "content")


def _is_skippable(view: memoryview, at: int) -> bool:
    return len(view) - at >= 8 and (struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0) == (SKIPPABLE & 0xFFFFFFF0)


def frames(content: bytes) -> Iterator[bytes]:
    """What each frame of an archive holds. Raises ValueError if there is no dictionary in front or a frame is broken."""
    view = memoryview(content)
    if not _is_skippable(view, 0):
        raise ValueError("no skippable frame in front")
    at = 8 + struct.unpack_from("<I", view, 4)[0]
    if at > len(view):
        raise ValueError("the dictionary is cut off")
    dictionary = bytes(view[8:at])
    if dictionary[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(view):
        if _is_skippable(view, at):
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            if at > len(view):
                raise ValueError("a skippable frame is cut off")
            continue
        if len(view) - at < 4 or struct.unpack_from("<I", view, at)[0] != FRAME:
            raise ValueError(f"no frame at byte {at}")
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut off")
            chunk = bytes(view[at : at + CHUNK])
            try:
                parts.append(one.decompress(chunk))
            except zstandard.ZstdError as e:
                raise ValueError(str(e)) from e
            at += len(chunk) - (len(one.unused_data) if one.eof else 0)
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """The parts of a record after all its lengths and digests are checked; ValueError else."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.strip().lower().decode()] = value.strip().decode()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if need not in fields:
            raise ValueError(f"no {need}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block does not have its length")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    if not mark or not told:
        raise ValueError("no HTTP header")
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != int(told[1]) or base32_sha1(payload) != digest):
        raise ValueError("the payload does not have its length and digest")
    if revisit and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without what it refers to")
    number = lambda x: None if x in (None, "<urn:page:none>") else int(x.removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload_bytes": int(told[1]), "payload_digest": digest, "refers_to": number(fields.get("warc-refers-to")), "payload": None if revisit else payload}


_READ = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
READ_DDL = "path string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (path, content), one row for each. A bad record gives a row with `error` and nothing else; after a broken frame the rest of its archive is one such row."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, size = [], 0
                try:
                    for data in frames(content.as_py() or b""):
                        try:
                            row = parse_record(data)
                        except ValueError as e:
                            row = {"error": str(e)}
                        rows.append(row if payloads else row | {"payload": None})
                        size += len(data)
                        if size >= ARCHIVE_BYTES:
                            yield _table(path.as_py(), rows)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append({"error": str(e)})
                if rows:
                    yield _table(path.as_py(), rows)

    def _table(path: str, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path} | row for row in rows], _READ)

    return archives.select("path", "content").mapInArrow(decode, READ_DDL)


def unproved(records: DataFrame) -> DataFrame:
    """Of the records read, the revisits (page_id, refers_to) whose payload digest no response of that page_id has. Revisits are counted by what they refer to and say before they meet it."""
    said = records.filter("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.min("page_id").alias("page_id"))
    held = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return said.join(held, ["refers_to", "payload_digest"], "left_anti").select("page_id", "refers_to")


def dictionary_of(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample of pages (SAMPLE_PAGES): those whose hashes are below a bound that some four times as many are expected to meet, each hash once."""
    many = max(1, pages.count())
    bound = min(4 * SAMPLE_PAGES, many) * (2**63 - 1) // many
    some = pages.select(F.substring("html", 1, SAMPLE_CHARS).alias("html"), F.xxhash64("page_id", "url").alias("h")).filter(F.abs("h") <= bound).groupBy("h").agg(F.min("html").alias("html"))
    return train_dictionary([(r.html or "").encode() for r in some.orderBy("h").limit(SAMPLE_PAGES).collect()])


def op7_warc(pages: DataFrame) -> DataFrame:
    """Every page written to archive files in the shared folder and read back from there.

    A null html is an empty payload, a null url leaves its header out. Rows with a null page_id
    revisit an equal payload that has one. Equal rows with the largest page_id are all responses.
    Very long pages are a record like others. An empty table makes no record. A record that does
    not read back whole, or a revisit without its response, is an error.
    """
    spark, mark = pages.sparkSession, marked()
    folder = reserved(spark)
    save_archives(write_archives(classified(pages), dictionary_of(pages)), folder)
    back, _ = written(read_archives(open_archives(spark, folder), payloads=False))
    drop(spark, folder)
    wrong = back.filter("error is not null").select("error").unionByName(unproved(back).select(F.concat(F.lit("no response to revisit "), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("error"))).first()
    if wrong:
        raise ValueError(wrong.error)
    return settled(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), mark)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) || '0' AS hex, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, ((i * 5) // 4 + 1)::INT, 2))::BIGINT >> (3 - (i * 5) % 4)::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d
"""
