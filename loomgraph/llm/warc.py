"""WARC: a dictionary-compressed writer and its reader.

An archive is a ``.warc.zst`` stream: a leading skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from the archive's own first records, then one frame for each record.
Archives are written by Spark's own committer into any file system that Spark reads: a task turns
its rows into the bytes of frames, and the text sink writes them one after the other with an empty
skippable frame as the line separator, which Zstandard readers skip. A lost executor costs a retry
of its tasks; no half-written archive is left behind.

Of records with equal payloads the one with the smallest page_id is the response, the others are
revisits that refer to it and hold no payload. Payloads are compared by SHA-1, as WARC does.

Defined results: a null html is an empty payload; a null page_id never is the first of its
payload unless all are null, and then each is a response; rows that repeat the first page_id and
payload are responses too; an empty table makes archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame, all of it ASCII, that stands between records.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
#: Size of a dictionary, and bytes of records it is built from: the bounds of the sample.
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 6 << 20
LEVEL = 3
#: Payloads smaller than this are never revisits.
MIN_REVISIT_BYTES = 0
#: Payload bytes of an archive, so that a file stays far below what one task or reader can hold.
ARCHIVE_BYTES = 256 << 20
#: A fixed date: the tables have none.
DATE = "2020-01-01T00:00:00Z"
END = b"\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    uri = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + END + body + END


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(found: zstandard.ZstdCompressionDict) -> bytes:
    data = found.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of one archive: the dictionary's, then each record's."""

    def records() -> Iterator[bytes]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))
            for page_id, url, payload, digest, refers_to in zip(*columns):
                yield record_bytes(page_id, url, payload or b"", base64.b32encode(bytes.fromhex(digest)).decode("ascii"), refers_to)

    source, samples, held = records(), [], 0
    for record in source:
        samples.append(record)
        held += len(record)
        if held >= SAMPLE_BYTES:
            break
    if not samples:
        return
    found = build_dictionary(samples)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=True)
    out, size = [dictionary_frame(found)], 0
    for record in itertools.chain(samples, source):
        out.append(packer.compress(record))
        size += len(out[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])


def archive_count(payload_bytes: int, partitions: int) -> int:
    """One for each shuffle partition, which is how rows are dealt out for the join, or more where these would be too large."""
    return max(partitions, -(-payload_bytes // ARCHIVE_BYTES))


def decide(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest (hex) and refers_to of every row, dealt out to archives.

    The first page of each payload is found from digests alone, summed up before they are shuffled;
    digests that stand once go no further, and the join of those that stand often is one whose large
    partitions Spark splits. Payloads are shuffled once, by page, url and digest, so a payload with
    very many copies and pages without an id are spread, and an archive has about ARCHIVE_BYTES.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    address = F.coalesce(F.concat(F.lit(" "), F.col("url")), F.lit(""))
    rows = rows.withColumn("key", F.concat(F.col("digest"), F.lit(" "), number, address))
    known = rows.select("page_id", "key", "digest", F.octet_length("payload").alias("n"))
    first = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1 and first_id is not null").drop("rows")
    later = known.where(F.col("n") >= min_revisit_bytes).join(first, "digest").where("not (page_id <=> first_id)")
    later = later.select("key", F.col("first_id").alias("refers_to")).distinct()
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = archive_count(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(archives, "key").join(later.repartition(archives, "key"), "key", "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write every row of ``pages`` (page_id, url, html) as a record under ``path``.

    The text sink names the files, so they end in .txt; their bytes are a .warc.zst archive's.
    """
    frames = decide(pages, min_revisit_bytes).mapInArrow(_frames, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the body of every record of one archive, in order."""
    if not content:
        return
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    raw = content[8 : 8 + size]
    found = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
    stream = zstandard.ZstdDecompressor(dict_data=found).stream_reader(memoryview(content)[8 + size :], read_across_frames=True)
    reader = io.BufferedReader(stream, 1 << 20)
    while line := reader.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip()
        body = reader.read(int(fields["content-length"]))
        if reader.read(4) != END:
            raise ValueError("a record has no end")
        yield fields, body


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    for batch in batches:
        for content in batch.column("content").to_pylist():
            rows = []
            for fields, body in parse_archive(content):
                digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                kind = fields["warc-type"]
                if kind == "response" and (sha1_base32(body) != digest or len(body) != n):
                    raise ValueError("a payload doesn't fit its digest")
                refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
                rows.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], n, digest, kind, refers))
                if len(rows) == 10_000:
                    yield make(rows)
                    rows = []
            if rows:
                yield make(rows)


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record under ``path``; payloads of responses are checked against their digests.

    An archive is read whole by one task; its size is bounded when it is written.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: The rows of a round trip in DuckDB; base 32 is spelled out, four letters for five hex digits.
WARC_SQL = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT hex, min(page_id) AS first_id FROM rows GROUP BY hex),
fives AS (
  SELECT page_id, n, hex, list_transform(range(8), lambda j: CAST('0x' || substr(hex, CAST(5 * j + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM rows)
SELECT f.page_id, f.n::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN f.page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.page_id <> first_id THEN first_id END AS refers_to
FROM fives f JOIN first USING (hex)
"""
