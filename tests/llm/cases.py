"""Odd inputs that every operator of this subpackage takes, and the documents of the smallest tables."""

from __future__ import annotations

import pandas as pd

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, size int, kept string, "
    "`n_words` string, key string, start string, part string, `class` string, lines string, `odd.name` string"
)
LINE = "A line that many documents share"


def odd_rows() -> list[tuple]:
    long_text = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = [
        (1, ""), (2, None), (3, " \t\n\x0b"), (4, LINE), (5, f"{LINE}\n{LINE}  \nown text of five"), (6, f" {LINE.upper()}\nÀ É straße"),
        (7, long_text), (8, long_text + " and one more"), (9, "one"), (10, "One"), (10, "One"), (None, "no id at all here"),
        (None, None), (11, "tie tie tie tie tie tie"), (12, "tie tie tie tie tie tie"), (13, " wide space 😀 end"),
    ]
    return [
        (i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None if t is None else len(t),
         "r", 7, "k", "w", "key", "st", "p", "c", "l", "odd")
        for k, (i, t) in enumerate(texts)
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark) -> pd.DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
