"""Quality rules: text statistics, and robust outliers among them per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.llm.common import SPACE_CHARS, SPACES, WORD, packed, quoted, stored, unpacked
from arqueo.operators.staging import broadcast_if_small

SYMBOLS = r"[^#*$%&|<>]+"  # everything that is no symbol
POSITION_BITS = 26
FEATURES = ("length", "word_size", "symbols", "dup_lines", "repeats")
# least standard deviation a feature is given: most groups have no spread at all in some of them
FLOORS = (0.3, 0.08, 0.4, 0.4, 0.8)
SUBSET = 0.75
# --- Fixed value: the 0.75 quantile of chi-squared with 5 degrees of freedom ---
CHI2_AT_SUBSET = 6.6257
# --- end of fixed value ---
CUTOFF = 60.0
MIN_ROWS = 50
STEPS = 4
D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds at least twice.

    Windows are hashed, tagged with their position and sorted as plain numbers; equal windows
    are then neighbours. Neighbours with equal tags are compared word by word, so hash
    collisions do not count. The work is n log n for any text (up to 2**26 words).
    """
    last = F.size(words) - 3
    mask = F.lit(-(1 << POSITION_BITS))
    tags = F.sort_array(F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(mask).bitwiseOR(i.cast("bigint")),
    ))
    return F.when(last >= 1, tags)


def _repeat_count(words: Column, tags: Column) -> Column:
    low = F.lit((1 << POSITION_BITS) - 1)
    head = lambda k: F.shiftright(F.get(tags, k), POSITION_BITS)
    at = lambda k: F.get(tags, k).bitwiseAND(low).cast("int")
    near = F.filter(F.sequence(F.lit(1), F.size(tags) - 1), lambda k: head(k) == head(k - 1))

    def equal(k: Column, back: int) -> Column:
        p, q = at(k), at(k - back)
        same = [F.get(words, p + o) == F.get(words, q + o) for o in range(3)]
        return F.when((head(k) == head(k - back)) & same[0] & same[1] & same[2], F.array(p, q)).otherwise(F.array().cast("array<int>"))

    # two steps back as well: a colliding window may stand between equal ones
    starts = F.flatten(F.transform(near, lambda k: F.concat(equal(k, 1), F.when(k >= 2, equal(k, 2)).otherwise(F.array().cast("array<int>")))))
    covered = lambda s: F.size(F.array_distinct(F.concat(s, F.transform(s, lambda x: x + 1), F.transform(s, lambda x: x + 2))))
    return F.when(tags.isNull() | (F.size(near) == 0), F.lit(0)).otherwise(covered(starts)).cast("bigint")


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    step = packed(docs).withColumns({"body": F.btrim(text, F.lit(SPACE_CHARS))}).withColumn(
        "words", F.when(F.length("body") > 0, F.split("body", SPACES)).otherwise(F.array().cast("array<string>"))
    ).withColumns({
        "tags": repeat_words(F.col("words")),
        "lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
    })
    return unpacked(
        step,
        n_words=F.size("words").cast("bigint"),
        word_chars=F.length(F.array_join("words", "")).cast("bigint"),
        n_symbols=F.length(F.regexp_replace(text, SYMBOLS, "")).cast("bigint"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        n_repeat_words=_repeat_count(F.col("words"), F.col("tags")),
    )


def _features() -> dict[str, Column]:
    n = F.col("n_words")
    rate = lambda c: F.log1p(100.0 * F.col(c) / n)
    return {
        "x0": F.log1p(n.cast("double")), "x1": F.log(F.col("word_chars") / n), "x2": rate("n_symbols"),
        "x3": rate("n_dup_lines"), "x4": rate("n_repeat_words"),
    }


def _groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, g): groups of too few rows are pooled by language, then over all."""
    name = lambda level, *cols: F.to_json(F.struct(F.lit(level).alias("level"), *cols))
    counts = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = counts.filter(F.col("n") < min_rows).groupBy("lang").agg(F.sum("n").alias("pool")).withColumnRenamed("lang", "of")
    named = counts.join(small, F.col("lang").eqNullSafe(F.col("of")), "left")
    return named.select(
        "lang", "source",
        F.when(F.col("n") >= min_rows, name(0, "lang", "source")).when(F.col("pool") >= min_rows, name(1, "lang")).otherwise(name(2)).alias("g"),
    )


def _inverse(state: DataFrame) -> DataFrame:
    """Adds the Cholesky factor's inverse (q_ij) and the log determinant of the covariances c_ij."""
    for i, j in [(i, j) for i in range(D) for j in range(i + 1)]:
        done = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        rest = F.col(f"c{i}{j}") - done
        state = state.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    for j in range(D):
        for i in range(j, D):
            value = F.lit(1.0) if i == j else -sum((F.col(f"l{i}{k}") * F.col(f"q{k}{j}") for k in range(j, i)), F.lit(0.0))
            state = state.withColumn(f"q{i}{j}", value / F.col(f"l{i}{i}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0))
    return state.select("g", "start", *[f"m{i}" for i in range(D)], *[f"q{i}{j}" for i, j in PAIRS], logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. to m0.. by the inverse factor q."""
    total = F.lit(0.0)
    for i in range(D):
        z = sum((F.col(f"q{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


def _start(rows: DataFrame) -> DataFrame:
    """Two starts per group: medians with quartile ranges, and plain means with variances."""
    bins = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * 50).cast("bigint") for i in range(D)])).alias("dim", "bin"))
    counts = bins.groupBy("g", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g", "dim").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumns({"c": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("g", "dim"))})
    at = lambda share: F.min(F.when(F.col("c") >= share * F.col("all"), F.col("bin"))) / 50.0 + 0.01
    per_dim = reached.groupBy("g", "dim").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    wide = per_dim.groupBy("g").agg(*[F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}{i}") for i in range(D) for c in "ms"])
    plain = rows.groupBy("g").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(D)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(D)])
    both = wide.withColumn("start", F.lit(0)).unionByName(plain.withColumn("start", F.lit(1)))
    return _inverse(both.withColumns({
        f"c{i}{j}": F.col(f"s{i}") * F.col(f"s{i}") + FLOORS[i] ** 2 if i == j else F.lit(0.0) for i, j in PAIRS
    }))


def _concentrate(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One concentration step: mean and covariance of the rows nearest to the last estimate.

    Rows are reduced to sums per (group, bin of the distance) with partial aggregation; the
    nearest part of a group is then a running sum over its few hundred bins, so no group is
    sorted, whatever its size.
    """
    shift = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    binned = rows.join(state, "g").withColumn("bin", F.floor(16 * F.log2(_distance() + 1e-6)).cast("int"))
    sums = binned.groupBy("g", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(shift[i]).alias(f"a{i}") for i in range(D)],
        *[F.sum(shift[i] * shift[j]).alias(f"b{i}{j}") for i, j in PAIRS], *[F.first(f"m{i}").alias(f"m{i}") for i in range(D)],
    )
    upto = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = sums.withColumns({"c": F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("g", "start"))}).filter(
        F.col("c") < SUBSET * F.col("all")
    ).groupBy("g", "start").agg(
        F.sum("n").alias("n"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(D)],
        *[F.sum(f"b{i}{j}").alias(f"b{i}{j}") for i, j in PAIRS], *[F.first(f"m{i}").alias(f"m{i}") for i in range(D)],
    )
    n = F.col("n")
    moved = near.select(
        "g", "start", *[(F.col(f"m{i}") + F.col(f"a{i}") / n).alias(f"m{i}") for i in range(D)],
        *[(F.col(f"b{i}{j}") / n - F.col(f"a{i}") * F.col(f"a{j}") / n / n + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    return _inverse(moved)


def _scale(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The start with the smaller determinant, and the factor that makes its distances chi-squared."""
    lowest = Window.partitionBy("g").orderBy("logdet", "start")
    best = state.withColumn("nth", F.row_number().over(lowest)).filter("nth = 1").drop("nth", "start", "logdet")
    binned = rows.join(best, "g").groupBy("g", F.floor(16 * F.log2(_distance() + 1e-6)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = binned.withColumns({"c": F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("g"))}).filter(
        F.col("c") < SUBSET * F.col("all")
    ).groupBy("g").agg(F.max("bin").alias("bin"))
    # floors make distances small; they are never scaled up
    factor = F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 1) / 16.0) / CHI2_AT_SUBSET, F.lit(1.0))
    return best.join(edge, "g").withColumn("factor", factor).drop("bin")


def judge_quality(docs: DataFrame, min_rows: int = MIN_ROWS, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """``docs`` without text, with the five statistics, base_failed, distance and kept.

    A document fails the base rules with under 50 words, or with more than half of its words in
    repeated 3-word windows. The others are judged against their language and source: the
    minimum covariance determinant estimate (from two starts, by concentration steps on the
    nearest three quarters) of five transformed statistics, and the squared Mahalanobis distance
    to it. ``kept`` is false beyond ``cutoff``. Variances have a floor, since most groups have
    no symbols or repeated lines at all.

    Texts are read once and reduced to five numbers. Groups below ``min_rows`` are pooled by
    language, then over all; a pool that is still smaller gives no verdict, and its documents
    are kept. Null language or source is a value of its own. Null or empty text has zeros and
    fails the base rules. Repeated rows are judged alike; an empty table gives an empty result.
    """
    whole = [c for c in docs.columns if c.lower() != "text"]
    counted = text_statistics(docs).select(*[quoted(c) for c in whole if c.lower() not in _ADDED], *_STATISTICS)
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    base = stored(packed(
        counted.withColumn("base_failed", failed), lang=F.col("lang"), source=F.col("source"),
        base_failed=failed, **{k: F.when(~failed, v) for k, v in _features().items()},
    ), "statistics")
    candidates = base.filter(~F.col("base_failed"))
    groups = stored(_groups(candidates, min_rows), "groups").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    rows = stored(candidates.join(groups, joined).select("g", *[f"x{i}" for i in range(D)]), "vectors")
    enough = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).select("g")
    state = stored(_start(rows).join(enough, "g", "left_semi"), "start")
    for _ in range(steps):
        state = stored(_concentrate(rows, state), "step")
    # one row a group: counted, and sent to the documents, so no group's documents are dealt into one task
    final = broadcast_if_small(stored(_scale(rows, state), "final"))
    distance = F.when(~F.col("base_failed"), _distance() / F.col("factor"))
    judged = base.join(groups, joined, "left").join(final, "g", "left").withColumn("distance", distance)
    return unpacked(judged, distance=F.col("distance"), kept=~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = {*_STATISTICS, "base_failed", "distance", "kept"}
