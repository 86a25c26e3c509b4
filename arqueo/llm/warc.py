"""WARC: archives whose records are compressed one by one with a dictionary that each archive carries."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.llm.common import stored
from arqueo.operators.staging import broadcast_if_small

# --- Fixed values: frame magics and record lines of the formats ---
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# --- end of fixed values ---
# Spark's text writer ends each row with a line feed: it is the content of this skippable frame
LINE_FRAME = SKIPPABLE_MAGIC.to_bytes(4, "little") + (1).to_bytes(4, "little")
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
RECORDS_PER_ARCHIVE = 2000
READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header(value: str) -> str:
    """A header value on one line: percent signs and line breaks are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes, level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if len(dictionary) >= 8 else zstandard.ZstdCompressor(level=level)


def _write_partition(dictionary: bytes, level: int, per_archive: int, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor, written = _compressor(dictionary, level), 0
        leading = DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
        for batch in batches:
            frames = []
            for page_id, url, html, revisit, refers_to in zip(batch.page_id, batch.url, batch.html, batch.revisit, batch.refers_to):
                payload = html.encode()
                ident, of = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                data = record(ident, url, payload, len(payload), payload_digest(payload), of, bool(revisit), date)
                if written % per_archive == 0:
                    frames.append(leading + LINE_FRAME)
                frames.append(compressor.compress(data) + LINE_FRAME)
                written += 1
            yield pd.DataFrame({"frame": frames})

    return run


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, level: int = 3, per_archive: int = RECORDS_PER_ARCHIVE,
    date: str = "2024-01-01T00:00:00Z", sample_pages: int = SAMPLE_PAGES,
) -> None:
    """Writes one record per page into zstd archives under ``path``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id
    is a response and the others are revisits of it; rows that repeat that page_id are responses
    too. The dictionary is trained on at most ``sample_pages`` records (least hash of the id,
    the first 16 KiB of each) and stands in a skippable frame in front of every archive.

    Archives are written by Spark's own text writer from bytes, so they land in any file system
    and a task that runs twice commits once. The line feed after each row is the content of a
    skippable frame, which readers pass over. After ``per_archive`` records another file begins.

    Null html is an empty payload, a null url leaves its header out, a null page_id is smaller
    than any other. An empty table writes no records.
    """
    whole = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    # ids first: every task offers its least hashes, and those must not carry pages
    ids = whole.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id")).limit(sample_pages).distinct()
    sample = whole.select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")).join(
        F.broadcast(ids), "page_id"
    ).limit(sample_pages).collect()
    dictionary = build_dictionary([
        record(r.page_id, r.url, p := r.html.encode(), len(p), payload_digest(p), None, False, date) for r in sample
    ])
    hashed = whole.withColumns({"digest": F.unhex(F.sha1("html")), "size": F.octet_length("html")})
    first = hashed.filter(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to")
    ).filter("n > 1").drop("n")
    # a table by now: few repeated payloads are sent to the pages, which then stay where they are; of many, the
    # adaptive join can split a digest that a large part of the pages has
    first = broadcast_if_small(stored(first, "repeated_payloads"))
    same = F.col("page_id").eqNullSafe(F.col("refers_to"))
    joined = hashed.join(first.withColumn("shared", F.lit(True)), "digest", "left").withColumn(
        "revisit", F.coalesce(F.col("shared") & ~same & (F.col("size") >= min_bytes), F.lit(False))
    ).select("page_id", "url", "html", "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"))
    frames = joined.mapInPandas(_write_partition(dictionary, level, per_archive, date), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", per_archive + 1
    ).option("compression", "none").text(path)


def archive_dictionary(content: bytes) -> bytes:
    """The dictionary in the leading skippable frame; empty where there is none."""
    if int.from_bytes(content[:4], "little") != DICTIONARY_MAGIC:
        return b""
    return content[8:8 + int.from_bytes(content[4:8], "little")]


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive, decompressed as it is read."""
    import zstandard

    dictionary = archive_dictionary(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None)
    stream, held = decompressor.stream_reader(content, read_across_frames=True), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            if not (more := stream.read(max(65_536, n - len(held)))):
                return False
            held.extend(more)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and fill(len(held) + 1):
            pass
        if at < 0:
            if held.strip():
                raise ValueError("an archive ends inside a record's head")
            return
        lines = bytes(held[:at]).decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        end = at + 4 + int(headers["Content-Length"])
        if not fill(end + 4):
            raise ValueError("an archive ends inside a record's block")
        block = bytes(held[at + 4:end])
        del held[:end + 4]
        yield headers, block


def _read_archives(with_payload: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for headers, block in read_records(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rsplit(b"Content-Length: ", 1)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"record {headers['WARC-Record-ID']} does not match its digest")
                    url = headers.get("WARC-Target-URI")
                    of = headers.get("X-Refers-To-Page")
                    page = headers.get("X-Page-ID")
                    rows.append((
                        None if page is None else int(page), None if url is None else _unheader(url), size, digest, kind,
                        None if of is None else int(of), payload if with_payload and kind == "response" else None,
                    ))
                    if len(rows) >= 1000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record under ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Each response is digested again and compared with its header; a difference stops the job.
    One archive is read at a time in a task. Payloads of responses come along if asked for.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInPandas(_read_archives(with_payload), READ)
    return out if with_payload else out.drop("payload")
