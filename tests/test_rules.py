"""Dated rules as spans, and line numbers of files that several tasks read."""

import random

from pyspark.sql import functions as F

from arqueo.operators.classify import rule_spans, with_dated_rule
from arqueo.sources.tables import read_crosswalk

SCHEMA = "rule_no bigint, valid_from int, valid_to int, source_cod_subtitulo bigint, source_cod_item bigint, canonical_group string"


def check(spark, rules, rows):
    def last(subtitle, item, year):
        held = [r for r in rules if r[3] == subtitle and r[4] == item and None not in (r[1], r[2], year, subtitle, item) and r[1] <= year <= r[2]]
        return max(held)[5] if held else None

    df = spark.createDataFrame(rows, "n int, s bigint, i bigint, y bigint")
    out = with_dated_rule(df, spark.createDataFrame(rules, SCHEMA), "y", F.col("s"), F.col("i"))
    assert out.columns == ["n", "s", "i", "y", "_dated_group"]
    got = {r.n: r._dated_group for r in out.collect()}
    assert len(got) == len(rows) and got == {n: last(s, i, y) for n, s, i, y in rows}


def test_overlapping_nested_and_odd_rules(spark):
    draw = random.Random(1)
    rules = []
    for n in range(400):
        start = draw.randint(1990, 2030)
        rules.append((n, start, start + draw.choice([0, 1, 3, 10, 9999]), draw.randint(1, 4), draw.choice([1, 2, None]), draw.choice(["IPP", "FCM", None])))
    rules += [(400, None, 2000, 1, 1, "X"), (401, 2000, None, 1, 1, "X"), (402, 2010, 2000, 1, 1, "X"), (403, 2005, 2005, 1, 1, "one year")]
    rows = [(n, draw.choice([1, 2, 3, 4, 5, None]), draw.choice([1, 2, 3, None]), draw.choice([None, *range(1985, 2045)])) for n in range(3000)]
    check(spark, rules, rows)
    spans = rule_spans(spark.createDataFrame(rules, SCHEMA)).collect()
    taken = [(r.source_cod_subtitulo, r.source_cod_item, y) for r in spans for y in range(max(r.first_year, 1990), min(r.last_year, 2100) + 1)]
    assert len(taken) == len(set(taken))


def test_no_rules(spark):
    df = spark.range(3).withColumn("y", F.lit(2000).cast("bigint"))
    out = with_dated_rule(df, spark.createDataFrame([], SCHEMA), "y", F.col("id"), F.col("id")).collect()
    assert [r._dated_group for r in out] == [None] * 3


def test_two_hundred_thousand_rules_in_several_files(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules = spark.range(0, 200_000, 1, 4).select(
        (F.lit(2000) + F.col("id") % 7).alias("valid_from"), (F.lit(2003) + F.col("id") % 9).alias("valid_to"), (F.col("id") % 5).alias("source_cod_subtitulo"),
        (F.col("id") % 1000 / 5).cast("bigint").alias("source_cod_item"), F.concat(F.lit("g"), F.col("id").cast("string")).alias("canonical_group"))
    rules.write.option("header", True).csv(path)
    read = read_crosswalk(spark, path)
    # numbered in the order of the files and of their lines
    assert read.count() == 200_000 and read.filter("canonical_group <> concat('g', rule_no)").count() == 0
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    rows = spark.range(5000).select("id", (F.col("id") % 5).alias("s"), (F.col("id") % 200).alias("i"), (F.lit(1999) + F.col("id") % 14).alias("y"))
    got = with_dated_rule(rows, read, "y", F.col("s"), F.col("i"))
    want = rows.join(read, (F.col("s") == F.col("source_cod_subtitulo")) & (F.col("i") == F.col("source_cod_item")) & F.col("y").between(F.col("valid_from"), F.col("valid_to")), "left")
    want = want.groupBy("id").agg(F.max(F.struct("rule_no", "canonical_group"))["canonical_group"].alias("g"))
    joined = got.join(want, "id")
    assert got.count() == joined.count() == 5000 and joined.filter("NOT (_dated_group <=> g)").count() == 0 and joined.filter("g IS NOT NULL").count() > 3000


def test_lines_of_several_files_and_splits(spark, tmp_path):
    path = str(tmp_path / "rules")
    spark.range(0, 3000, 1, 3).select(
        F.lit(1).alias("valid_from"), F.lit(2).alias("valid_to"), F.lit(3).alias("source_cod_subtitulo"), F.lit(4).alias("source_cod_item"),
        F.col("id").cast("string").alias("canonical_group")).write.option("header", True).csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        read = read_crosswalk(spark, path)
        assert read.filter("canonical_group <> cast(rule_no as string)").count() == 0 and read.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
