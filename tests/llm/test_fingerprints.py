import hashlib

import numpy as np
from pyspark.sql import functions as F

from arqueo.llm.fingerprints import (
    GEAR, chunk_spans, chunks, compare_with_next, containment, containment_of, edited, fingerprint_set, fingerprints, gear_hashes, parsed, written,
)
from arqueo.llm.queries import op1_fingerprints
from tests.llm.cases import SF, documents, empty, odd, odd_rows


def brute(pairs):
    """Rows of the query, from neighbours in a sorted list."""
    out = []
    for (i, text), (_, other) in zip(pairs, pairs[1:] + pairs[:1]):
        changed = edited(text, other)
        a, b, c = map(fingerprint_set, (text, changed, other))
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(a), written(b), containment_of(a, b), containment_of(a, c)))
    return out


def test_query(spark):
    pairs = sorted(documents(spark)[["doc_id", "text"]].itertuples(index=False, name=None))
    assert sorted(map(tuple, op1_fingerprints(spark, SF).collect())) == brute(pairs)


def test_rolling_hash_is_the_plain_sum():
    points = np.frombuffer("Some text, é and more of it, longer than thirty-two".encode("utf-32-le"), np.uint32)
    plain = [sum(int(GEAR[points[i - k]]) << k for k in range(min(32, i + 1))) % 2**32 for i in range(len(points))]
    assert gear_hashes(points).tolist() == plain


def test_chunks_cover_the_text_and_survive_a_shift():
    text = " ".join(f"w{i * i % 1009}" for i in range(3000))
    spans = chunks(text)
    assert [s for s, _, _ in spans] == [0] + [e for _, e, _ in spans][:-1] and spans[-1][1] == len(text)
    assert all(e - s <= 256 for s, e, _ in spans) and all(e - s >= 16 for s, e, _ in spans[:-1])
    shifted = fingerprint_set("in front " + text)
    assert containment_of(fingerprint_set(text), shifted) > 0.98
    assert parsed(written(shifted)) and len(parsed(written(shifted))) == len(shifted)


def test_columns(spark):
    docs = spark.createDataFrame([(1, "x" * 50 + " some text " * 20), (2, "x" * 50 + " some text " * 20), (3, None)], "doc_id bigint, text string")
    marked = fingerprints(docs)
    prints = {r.doc_id: r.fingerprint for r in marked.collect()}
    assert prints[1] == prints[2] and prints[3] == ""
    pair = marked.alias("a").join(marked.alias("b"), F.col("a.doc_id") == F.col("b.doc_id") - 1).select(containment(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("c"))
    assert sorted(r.c for r in pair.collect()) == [0.0, 1.0]
    assert {r.doc_id for r in chunk_spans(docs).collect()} == {1, 2}


def test_odd_rows(spark):
    rows = compare_with_next(odd(spark)).collect()
    wanted = brute(sorted(((r[0], r[1] or "") for r in odd_rows() if r[0] is not None)) + [(None, ""), (None, "no id at all here")])
    alt = brute(sorted(((r[0], r[1] or "") for r in odd_rows() if r[0] is not None)) + [(None, "no id at all here"), (None, "")])
    assert sorted(map(tuple, rows), key=str) in (sorted(wanted, key=str), sorted(alt, key=str))
    assert compare_with_next(empty(spark)).count() == 0
    one = compare_with_next(odd(spark).filter("doc_id = 4")).collect()
    assert [(r.near_next, r.doc_id) for r in one] == [(1.0, 4)]
