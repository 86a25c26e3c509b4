import unicodedata

from pyspark.sql import functions as F

from arqueo.functions import text

SAMPLES = [
    "Ñuñoa", "  Llay-Llay ", "Viña del Mar", "STRASSE Straße", "Ångström", "Ñuñoa", "1º ª básico", "ﬁn … ½",
    "Ελλάδα", "Pucón  ", "", "a.b-c_d", "İstanbul", "ÑIQUÉN",
]


def fold(value: str) -> str:
    parts = unicodedata.normalize("NFKD", value.strip().casefold())
    return "".join(c for c in parts if not unicodedata.combining(c))


def applied(spark, function):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "n int, s string")
    return [r[0] for r in df.orderBy("n").select(function(F.col("s"))).collect()]


def test_name_form_follows_the_unicode_rule(spark):
    assert applied(spark, text.name_form) == [fold(s) for s in SAMPLES]


def test_name_key_keeps_letters_and_digits(spark):
    expected = ["".join(c for c in fold(s) if c in "abcdefghijklmnopqrstuvwxyz0123456789").upper() for s in SAMPLES]
    assert applied(spark, text.name_key) == expected


def test_place_key_collapses_space(spark):
    assert applied(spark, text.place_key) == [" ".join(fold(s).split()) for s in SAMPLES]


def test_upper_is_not_trimmed(spark):
    def rule(value):
        return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).upper()
    assert applied(spark, text.accent_free_upper) == [rule(s) for s in SAMPLES]


def test_null_gives_the_empty_key(spark):
    row = spark.range(1).select(text.name_key(F.lit(None).cast("string")), text.accent_free_upper(F.lit(None).cast("string"))).head()
    assert tuple(row) == ("", "")


def test_labels(spark):
    row = spark.range(1).select(
        text.account_code(F.lit(3), F.lit(2001002)), text.millions_label(F.lit(1234567890.0)),
        text.wrapped(F.lit("uno dos tres cuatro cinco seis"), 12), text.word_set(F.lit("De Beneficio, de Ñuñoa 2")),
    ).head()
    assert row[0] == "03-2001002" and row[1] == "$1.235 MM"
    assert row[2] == "uno dos tres<br>cuatro cinco<br>seis"
    assert sorted(row[3]) == ["2", "beneficio", "de", "nunoa"]


def test_every_compatibility_expansion(spark):
    """Ligatures, units and syllables fold like the Unicode database says, in any text that holds them."""
    import unicodedata

    from arqueo.functions import text

    samples = ["ﬀ oﬃce ㎏ ℡ ⅓", "㍿ ﷺ", "한국 straße", "plain é", "ǆ Ǆ"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text.name_form(F.col("t")).alias("f")).collect()
    for r in rows:
        parts = unicodedata.normalize("NFKD", r.t.casefold())
        assert r.f == "".join(c for c in parts if not unicodedata.combining(c)).casefold()
