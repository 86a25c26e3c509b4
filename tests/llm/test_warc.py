import base64
import hashlib

import zstandard

from arqueo.llm.queries import op9_warc
from arqueo.llm.warc import archive_dictionary, read_archives, write_archives
from tests.llm.cases import SF


def brute(pages):
    """(page_id, size, digest, type, refers_to) straight from the definition."""
    of = {}
    for i, _, html in pages:
        of.setdefault((html or "").encode(), []).append(i)
    out = []
    for i, _, html in pages:
        payload = (html or "").encode()
        known = [x for x in of[payload] if x is not None]
        most = max(known) if known else None
        revisit = i != most
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", most if revisit else None))
    return sorted(out, key=str)


def test_query_is_what_was_written(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, op9_warc(spark, SF).collect()), key=str) == brute([tuple(p) for p in pages])


PAGES = [
    (1, "http://a/\r\nX: y%", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 400_000), (6, "u", "x\r\n\r\ny"),
    (None, "u", "lost"), (None, "u", "same"), (7, "u", "twice"), (7, "u", "twice"),
]


def test_odd_rows_and_archives(spark, tmp_path):
    docs = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id bigint, url string, html string, digest string").coalesce(1)
    write_archives(docs, str(tmp_path / "w"), per_archive=4)
    rows = read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == brute(PAGES)
    assert {r.payload.decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    assert {r.url for r in rows} == {u for _, u, _ in PAGES}
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 1
    for f in files:
        content = f.read_bytes()
        dictionary = zstandard.ZstdCompressionDict(archive_dictionary(content))
        plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(content, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n")


def test_min_bytes_and_empty(spark, tmp_path):
    docs = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    write_archives(docs, str(tmp_path / "w"), min_bytes=100)
    assert {r.record_type for r in read_archives(spark, str(tmp_path / "w")).collect()} == {"response"}
    write_archives(docs.limit(0), str(tmp_path / "e"))
    assert read_archives(spark, str(tmp_path / "e")).count() == 0
