import pytest
from pyspark.sql import functions as F

from arqueo.functions import text
from arqueo.operators import dictionary, staging

NAMES = ["Ñuñoa", " ñuñoa ", "한국 Straße", "plain", "", None, "ﬁn ½"]


def rows(spark, copies=1):
    return spark.range(len(NAMES) * copies).select(
        "id", F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("id") % len(NAMES) + 1).cast("int")).alias("name"),
        F.when(F.col("id") % 2 == 0, "Other").alias("other.name"), F.lit("x").alias("texto"),
    )


@pytest.mark.parametrize("bound", [100_000, 0])
def test_forms_are_those_of_each_row(spark, monkeypatch, request, bound):
    monkeypatch.setattr(dictionary, "broadcast_if_small", lambda df: staging.broadcast_if_small(df, bound))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    df = rows(spark, 40)
    found = dictionary.text_dictionary(df, ["name", "other.name"], dictionary.NAME_FORMS)
    out = dictionary.with_forms(df, found, {
        "form": ("name", "forma"), "key": ("name", "clave"), "place": ("name", "lugar"), "words": ("name", "palabras"),
        "high": ("other.name", "mayusculas"),
    }, {"clave": ""})
    assert out.columns == ["id", "name", "other.name", "texto", "form", "key", "place", "words", "high"]
    want = df.select(
        "id", text.name_form(F.col("name")).alias("form"), text.name_key(F.col("name")).alias("key"), text.place_key(F.col("name")).alias("place"),
        text.word_set(F.col("name")).alias("words"), F.when(F.col("`other.name`").isNotNull(), text.accent_free_upper(F.col("`other.name`"))).alias("high"),
    )
    got = out.select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (bound > 0)


def test_the_fold_is_in_the_plan_of_distinct_texts_only(spark, monkeypatch):
    plans = []

    def seen(df, label, *rest):
        plans.append((label, df.count(), df._jdf.queryExecution().optimizedPlan().toString()))
        return staging.written(df, label, *rest)

    monkeypatch.setattr(dictionary, "written", seen)
    df = rows(spark, 1000)
    found = dictionary.text_dictionary(df, ["name"], {"forma": text.name_form})
    out = dictionary.with_forms(df, found, {"form": ("name", "forma")})
    (first, texts, plain), (second, entries, folding) = plans
    assert (first, second) == ("texts", "dictionary") and texts == entries == len(NAMES) - 1
    assert "translate" not in plain and "translate" in folding
    # forms are computed of a written table of distinct texts, and rows only look them up
    assert "Range" not in folding and "translate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == df.count()


def test_empty_and_all_null(spark):
    none = rows(spark).filter("name IS NULL")
    found = dictionary.text_dictionary(none, ["name"], dictionary.NAME_FORMS)
    assert found.count() == 0
    assert [tuple(r) for r in dictionary.with_forms(none, found, {"k": ("name", "clave")}, {"clave": ""}).select("k").collect()] == [("",)]


def test_broadcast_checks_bytes(spark):
    wide = spark.range(50).select(F.repeat(F.lit("x"), 2000).alias("t"), F.array(F.lit(1), F.lit(2)).alias("a"), F.struct(F.lit("y").alias("s")).alias("r"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(staging.broadcast_if_small(wide)) and not hinted(staging.broadcast_if_small(wide, max_bytes=90_000))
    assert not hinted(staging.broadcast_if_small(wide, max_rows=49)) and hinted(staging.broadcast_if_small(wide.limit(0), max_rows=0))
