import re
from collections import Counter

from pyspark.sql import functions as F

from arqueo.llm.quality_rules import judge_quality, text_statistics
from arqueo.llm.queries import op7_quality_outliers
from tests.llm.cases import SF, documents, empty, odd, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def stats(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_query_statistics_and_base(spark):
    rows = op7_quality_outliers(spark, SF).collect()
    texts = dict(documents(spark)[["doc_id", "text"]].itertuples(index=False, name=None))
    assert len(rows) == len(texts)
    for r in rows:
        assert stats(r) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark):
    out = judge_quality(odd(spark))
    rows = out.collect()
    assert len(rows) == 16 and out.columns.count("n_words") == 1 and "text" not in out.columns
    texts = {r[0]: r[1] for r in odd_rows()}
    assert all(stats(r) == brute(texts[r.doc_id]) for r in rows if r.doc_id is not None)
    assert judge_quality(empty(spark)).count() == 0


def test_repeats(spark):
    texts = ["a b c d", "a b c a b c", "x a b c y a b c", "a a a a", "a b", "t t t", "p q r p q s p q r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in text_statistics(docs).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_outliers_are_found_beside_a_masking_crowd(spark):
    """A fifth of one group is full of symbols: plain means would hide it."""
    texts = [(i, " ".join(f"w{(i * 31 + j * 7) % 1000}{'###' if i % 5 == 0 else ''}" for j in range(120 + i % 60)), "en", "s") for i in range(600)]
    rows = judge_quality(spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in rows)


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op7_quality_outliers(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("not base_failed")
    share = {r.quality: r.share for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert share[1] > 0.97
