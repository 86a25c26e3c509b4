import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arqueo.llm.vector_codes import codebook_digest, encode_vectors, nearest_entries, with_label_error

SCHEMA = "vec_id bigint, embedding array<float>, label int, `row` string, code string, ints int, id string, `odd.name` string"


def by_hand(rows, parts, entries, rounds):
    """({(vec_id, ints): (code, error)} as a list, books) with plain loops."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        found = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for c in cut:
                taken.setdefault(near(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(col) // len(taken[e]) for col in zip(*taken[e])] if e in taken else old for e, old in enumerate(books[p])]
    codes = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    out = [(r[0], bytes(i for i, _ in c), sum(d for _, d in c), r[2]) for r, c in zip(kept, codes)]
    return out, books


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "r", "c", 1, "i", "o") for i, v, x in rows], SCHEMA)


def some_rows():
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(12)], i % 3 if i % 7 else None) for i in range(120)]
    rows += [(200 + i, rows[3][1], 1) for i in range(40)]  # copies
    rows += [(3, rows[4][1], 2), (3, rows[4][1], 2), (None, rows[5][1], None), (None, rows[6][1], 0)]
    rows += [(300, None, 1), (301, [None] * 12, 1), (302, [float("nan")] + [0.0] * 11, 1), (303, [float("inf")] * 12, 1), (304, [float("-inf")] * 12, None)]
    return rows


@pytest.mark.parametrize("entries,block", [(8, 50), (8, 65_536), (256, 7)])
def test_codes_and_books(spark, entries, block):
    rows = some_rows()
    want, books = by_hand(rows, 4, entries, 2)
    coded, found = encode_vectors(table(spark, rows).repartition(3), parts=4, entries=entries, block=block)
    assert found.tolist() == books
    assert codebook_digest(found) == hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out = with_label_error(coded)
    assert out.columns == ["vec_id", "embedding", "label", "row", "ints", "id", "odd.name", "code", "error", "label_error"]
    sums = {}
    for _, _, error, label in want:
        sums[label] = sums.get(label, 0) + error
    got = sorted(((r.vec_id, bytes(r.code), r.error, r.label, r.label_error) for r in out.collect()), key=repr)
    assert got == sorted(((*w, sums[w[3]]) for w in want), key=repr)


def test_fewer_rows_than_entries_and_ties(spark):
    rows = [(1, [0.0] * 16, 1), (2, [0.0] * 16, 1), (3, [1.0] * 16, None)]
    coded, books = encode_vectors(table(spark, rows))
    got = {r.vec_id: (bytes(r.code), r.error) for r in coded.collect()}
    assert books.shape == (16, 3, 1) and got == {1: (bytes(16), 0), 2: (bytes(16), 0), 3: (bytes([2] * 16), 0)}


def test_empty_and_bad_tables(spark):
    for rows in ([], [(1, None, 2)]):
        coded, books = encode_vectors(table(spark, rows))
        assert with_label_error(coded).count() == 0 and books.size == 0 and codebook_digest(books) == hashlib.sha256(b"").hexdigest()
    for bad in ([[0.0] * 16, [0.0] * 32], [[0.0] * 16] * 64 + [[0.0] * 32], [[0.0] * 15], [[1e6] * 16]):
        with pytest.raises(Exception, match="equal parts|different lengths|too large"):
            encode_vectors(table(spark, [(i, v, 0) for i, v in enumerate(bad)]))[0].collect()


@pytest.mark.parametrize("subtree", [1, 3, 100])
def test_trie_at_any_depth(subtree):
    draw = np.random.default_rng(1)
    parts = np.unique(draw.integers(-3, 3, (150, 4)), axis=0)
    book = draw.integers(-3, 3, (9, 4))
    index, distance = nearest_entries(parts, book, subtree)
    whole = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


def test_label_sums_without_a_broadcast(spark, monkeypatch):
    import arqueo.llm.vector_codes as module

    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.when(F.col("id") > 100, F.col("id") % 5).alias("label"), F.col("id").alias("error"))
    want = sorted(map(tuple, with_label_error(rows).collect()), key=repr)
    monkeypatch.setattr(module, "broadcast_if_small", lambda df: df.hint("merge"))
    assert sorted(map(tuple, with_label_error(rows).collect()), key=repr) == want
    assert {r[3] for r in want if r[1] is None} == {sum(range(101))}
