"""WARC: revisit resolution.

Records are (page_id, url, payload). Only headers are shuffled by payload digest: page_id, size and digest of all
records meet there, the smallest page_id of each digest is the response, and the other records of that digest become
revisits that name it. The revisits' headers (page_id, digest, the response's page_id) then go back to the pages:
broadcast where their number is at most ``SENT``, otherwise in a join by page_id and digest, which is no hot key; that
is the one case in which payloads are shuffled, once. A revisit's payload is dropped before its record is written.

Archives have fresh headers and a gzip member a record, so a record can be read from its offset. An archive is closed
at ``ARCHIVE`` bytes of records, or holds a single larger one. They go through Spark's own writer, so they can lie in
any file system Spark knows and a lost task leaves no half file. That writer puts a separator after every row; it is the
zero byte that ends a gzip member of less than 16 MB, taken off before (after a longer record an empty member follows).
Reading parses the members by their Content-Length, checks each payload against its digest, and resolves revisits by
joining them with the original responses.

A null html is an empty payload; payloads under ``LEAST`` bytes are never revisits. Control characters in a
url become spaces, and a null or empty url becomes ``urn:page:<page_id>``. Rows that repeat a page_id are
records of their own; among rows of the smallest page_id and equal payload, each is a response. A null page_id
is larger than any other. An empty table gives no records. Columns other than page_id, url and html are not
read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.runtime import new_path, prepare, stage, table

#: Payloads of fewer bytes are always written in full.
LEAST = 100
#: Bytes of records (before compression) at which an archive is closed.
ARCHIVE = 32_000_000
#: Revisits whose headers are broadcast: some 10 MB.
SENT = 150_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = (1 << 63) - 1


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Staged: page_id (null as the largest number), payload_digest and refers_to of the records that become revisits."""
    headers = stage(pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id"), F.octet_length("html").alias("bytes"), F.unhex(F.sha2("html", 256)).alias("payload_digest")), "headers")
    large = headers.where(F.col("bytes") >= least)
    # a hot digest is one row here, whatever its copies
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    return stage(large.join(first, "payload_digest").where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct(), "revisits")


def resolved(pages: DataFrame, least: int = LEAST, sent: int = SENT) -> DataFrame:
    """page_id, url, html (null for revisits), payload_digest, refers_to (null for responses)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    found = revisits(pages, least).withColumnsRenamed({"page_id": "own", "payload_digest": "digest"})
    found = F.broadcast(found) if found.count() <= sent else found.hint("merge")
    rows = pages.withColumn("payload_digest", F.unhex(F.sha2("html", 256)))
    joined = rows.join(found, (F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)) == F.col("own")) & (F.col("payload_digest") == F.col("digest")), "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), F.lower(F.hex("payload_digest")).alias("payload_digest"), "refers_to")


def record_id(page: int | None, digest: str) -> str:
    """A urn:uuid that depends on the record alone."""
    h = hashlib.md5(f"record {'-' if page is None else page} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


_CONTROL = re.compile(r"[\x00-\x20\x7F]+")


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None) -> bytes:
    """One WARC record with the two line ends that close it; ``payload`` is None for a revisit."""
    number = "-" if page is None else str(page)
    uri = _CONTROL.sub(" ", url or "").strip() or f"urn:page:{number}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {number}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def write_archives(rows: DataFrame, path: str, most: int = ARCHIVE) -> None:
    """Write resolved rows as gzipped WARC files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            data = b"".join(held)
            held.clear()
            data += b"" if data.endswith(b"\0") else member(b"")
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], names=["value"])

        for b in batches:
            for page, url, html, digest, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
                data = record(page.as_py(), url.as_py(), html.as_buffer().to_pybytes() if html.is_valid else None, digest.as_py(), refers_to.as_py())
                if held and size + len(data) > most:
                    yield closed()
                    size = 0
                held.append(member(data))
                size += len(data)
        if held:
            yield closed()

    columns = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "payload_digest", "refers_to")
    archives = columns.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What the gzip members of an archive hold, one after the other."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate = zlib.decompressobj(31)
        out = []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            out.append(inflate.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(inflate.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    for text in members(data):
        if not text:
            continue
        if not text.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        end = text.index(b"\r\n\r\n") + 2
        headers = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(text, text.index(b"\r\n") + 2, end)}
        size = int(headers["content-length"])
        if len(text) != end + 2 + size + 4:
            raise ValueError("a record is not as long as it says")
        yield headers, text[end + 2 : end + 2 + size]


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, digest, refers_to, payload_bytes and payload (null for revisits, and throughout
    unless ``payloads``), and whether the digest holds."""
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary, sound boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows: list[tuple] = []
                size = 0
                for h, block in parse(data.as_py()):
                    kind = h["warc-type"]
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    number = lambda k: int(h[k]) if h.get(k, "-") != "-" else None  # noqa: B023, E731
                    sound = payload is None or hashlib.sha256(payload).hexdigest() == digest
                    rows.append((number("x-page-id"), h["warc-target-uri"], kind, digest, number("x-refers-to-page-id"), None if payload is None else len(payload), payload if payloads else None, sound))
                    size += len(block) if payloads else 0
                    if len(rows) == 1000 or size > 4_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload", "sound"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def revisit_sources(headers: DataFrame) -> DataFrame:
    """Headers (page_id, record_type, payload_digest, refers_to, payload_bytes) with revisits given the size of
    the response they name; a revisit whose response is missing, or has another digest, keeps a null size."""
    named = headers.where("record_type = 'revisit'").select(F.col("refers_to").alias("named")).distinct()
    sources = headers.where("record_type = 'response'").select(F.col("page_id").alias("source"), F.col("payload_digest").alias("source_digest"), F.col("payload_bytes").alias("source_bytes"))
    sources = sources.join(named, F.col("source") == F.col("named"), "left_semi").dropDuplicates(["source", "source_digest"])
    joined = headers.join(sources, (F.col("refers_to") == F.col("source")) & (F.col("payload_digest") == F.col("source_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "source_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages as deduplicated archives below ``path`` (a new folder of the shared ones), read them back."""
    spark = prepare(pages.sparkSession)
    path = path or new_path(spark, "warc")
    write_archives(resolved(pages), path)
    read = read_archives(spark, path, payloads=False)
    headers = read.select("page_id", "record_type", F.when(F.col("sound"), F.col("payload_digest")).alias("payload_digest"), "refers_to", "payload_bytes")
    return revisit_sources(stage(headers, "headers"))  # thin rows, used thrice; archives are parsed once


def query(spark, sf_dir: str) -> DataFrame:
    """Every page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return archive_pages(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
