import zlib

import numpy as np
from pyspark.sql import functions as F

from arqueo.llm.quality_classifier import Buckets, features, fit, grade_texts, word_shape
from arqueo.llm.queries import op6_ordinal_quality
from tests.llm.cases import empty, odd

SF = "/root/testdata/sf0.01"


def test_shapes():
    assert word_shape(b"Word!!") == b"Aa!" and word_shape(b"x12-3") == b"a0-0" and word_shape("é".encode()) == b"x"


def test_ordered_grades_are_learned():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 4))
        words = ["good"] * g + ["bad"] * (3 - g) + [f"w{rng.integers(50)}" for _ in range(6)]
        rows.append(features(" ".join(words), Buckets()))
        grades.append(g)
    model = fit(rows, np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    linear = np.array([v @ model.weights[i] for i, v in rows])
    tails = model.tails(linear)
    assert np.corrcoef(tails.sum(axis=1), grades)[0, 1] > 0.95 and (np.diff(tails, axis=1) <= 0).all()


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op6_ordinal_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.97
    above = np.mean([[g.tail_score > b.tail_score for b in bad] for g in good])
    assert above > 0.9


def test_odd_rows(spark):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(1, 13)] + [(None, 1), (3, None)], "doc_id bigint, grade int")
    out = grade_texts(odd(spark), ratings)
    rows = out.collect()
    assert len(rows) == 16 and out.columns.count("kept") == 1 and "odd.name" in out.columns
    assert all(0 <= r.tail_score <= 1 and 0 <= r.expected_grade <= 2 for r in rows)
    assert grade_texts(empty(spark), ratings).count() == 0
    none = grade_texts(odd(spark), ratings.limit(0)).agg(F.count_distinct("tail_score")).first()[0]
    assert none == 1
