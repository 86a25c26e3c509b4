import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arqueo.llm.ranked_search import Shard, search, terms_of
from tests.llm.cases import empty, odd

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def spell(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def ranked(docs, items, k=10):
    """By hand: [(item place, rank, doc_id, score)]."""
    bags = [(i, Counter(spell(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, whole = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for nth, text in items:
        scores = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * count // whole
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(spell(text)) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(nth, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(found, name="item_id"):
    return sorted(((r[name], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("text", ["", "A-b C3_d", "ÀÉ straße Œ", "x\x00y\x7fz", "٣ 中文。字 ½", "İI ẞ K"])
def test_terms(text):
    assert [t.decode() for t in terms_of(text)] == spell(text)


def test_odd_rows_and_blocks(spark):
    frame = odd(spark)
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    asked = [(1, "word1 word2 WORD3"), (2, None), (3, ""), (4, "one"), (5, "tie"), (5, "tie"), (6, "A line that many documents share"), (7, "unseen"), (8, docs[6][1])]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("row", F.lit("x")).withColumn("nth", F.lit(0)).withColumn("score", F.lit("old"))
    want = ranked(docs, asked)
    for options in ({}, {"items_at_once": 2, "cells": 1}, {"cells": 7000}):
        found = search(frame, items, **options)
        assert rows(found) == want and found.columns == ["item_id", "text", "row", "nth", "rank", "doc_id", "score"]
    assert dict(found.dtypes)["rank"] == "int" and dict(found.dtypes)["score"] == "bigint"
    assert [r for r in want if r[0] == 5 and r[1] == 1] == [(5, 1, 11, r[3]) for r in want if r[0] == 5 and r[1] == 1]


def test_random_texts_and_ties(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(draw.choices(words, [1 / (i + 1) for i in range(40)], k=draw.randint(1, 30))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts * 3)]
    asked = [(i, " ".join(draw.sample(words, 8))) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5, "text")
    items = spark.createDataFrame(asked, "item_id long, text string")
    for k, cells in ((10, 400), (1, 10_000), (1000, 3000)):
        assert rows(search(frame, items, k=k, cells=cells)) == ranked(docs, asked, k)


def test_empty_sides(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search(empty(spark), items).count() == 0
    assert search(odd(spark), items.limit(0)).count() == 0
    assert search(odd(spark).filter("text is null"), items).count() == 0


def test_stops_before_the_end_of_the_lists():
    """A skewed impact in each list: few documents are met, and the best ones are right."""
    draw = np.random.default_rng(3)
    size, lists = 20_000, 4
    impacts = np.sort(draw.pareto(1.0, (lists, size)) * 1000 + 1, axis=1)[:, ::-1].astype(np.int64)
    docs = np.stack([np.argsort(np.arange(size) + draw.normal(0, 20, size)) for _ in range(lists)]).astype(np.int32)
    ids = np.empty(size, dtype=object)
    ids[:] = [(False, i) for i in range(size)]
    terms = np.repeat(np.arange(lists), size)
    shard = Shard(ids, terms, docs.ravel(), impacts.ravel(), lists)
    total = np.zeros(size, dtype=np.int64)
    for d, i in zip(docs, impacts):
        np.add.at(total, d, i)
    want = [(-int(total[d]), (False, int(d))) for d in np.lexsort((np.arange(size), -total))[:10]]
    best, scored = shard.best(np.arange(lists), 10, [])
    assert best == want and scored < size / 20
    # known results from other shards stop it at once or keep it going, without changing what is right
    better = [(-10**12, (False, -1))] * 10
    assert shard.best(np.arange(lists), 10, better) == (better, shard.best(np.arange(lists), 10, better)[1])
    assert shard.best(np.arange(lists), 10, want)[1] <= scored
