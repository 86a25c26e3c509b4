from arqueo.llm.line_dedup import dedup_lines
from tests.llm.cases import LINE, by_id, empty, odd


def test_odd_rows(spark):
    out = dedup_lines(odd(spark))
    assert out.count() == 16 and "odd.name" in out.columns and out.columns.count("lines") == 1
    got = {k: (r.kept_text, r.n_lines, r.n_dropped) for k, r in by_id(out).items()}
    assert got[1] == ("", 1, 0) and got[2] == ("", 1, 0) and got[3] == (" \t\n\x0b", 2, 0)
    assert got[4] == (LINE, 1, 0)
    assert got[5] == ("own text of five", 3, 2)
    assert got[6] == ("À É straße", 2, 1)
    assert got[9] == ("one", 1, 0) and got[10] == ("One", 1, 0)
    assert got[11][2] == 0 and got[12] == ("", 1, 1)


def test_threshold_and_length(spark):
    docs = spark.createDataFrame([(i, "shared by three\nshort\nby two only" if i < 2 else "shared by three\nshort") for i in range(3)], "doc_id bigint, text string")
    got = {k: r.kept_text for k, r in by_id(dedup_lines(docs, min_docs=3)).items()}
    assert got == {0: "shared by three\nshort\nby two only", 1: "short\nby two only", 2: "short"}


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "twice the same row"), (1, "twice the same row"), (None, "twice the same row")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.kept_text) for r in dedup_lines(docs).collect()) == [
        (0, ""), (1, "twice the same row"), (1, "twice the same row")
    ]


def test_empty(spark):
    assert dedup_lines(empty(spark)).count() == 0
