"""Compositional profiles: amounts, shares and total per municipality, and their log-ratios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.functions.numeric import exact_sum, fail_when, share
from arqueo.functions.text import strip
from arqueo.schema import (
    COLLECTED_TOTAL, GROUP, INCOME_GROUPS, NAME, ContractError, check_group_sequence, require_columns,
)

TOTAL = "ingreso_total_clp"


def share_column(group: str) -> str:
    return f"% {group}"


SHARES = [share_column(g) for g in INCOME_GROUPS]
PROFILE_COLUMNS = [NAME, *INCOME_GROUPS, *SHARES, TOTAL]


def build_municipality_income_profile(income: DataFrame) -> DataFrame:
    """One row per municipality from classified rows; absent groups are 0.

    The checks (blank names, unknown groups, missing amounts, negative cells, totals that
    are not positive) stop the job from inside the same single aggregation.
    """
    require_columns(income, [NAME, GROUP, COLLECTED_TOTAL], "build income profiles")
    name = strip(F.col(NAME).cast("string"))
    amount = F.col(COLLECTED_TOTAL).try_cast("double")
    checked = income.select(
        fail_when(name.isNull() | (name == ""), "row without a municipality name", name).alias(NAME),
        fail_when(
            F.col(GROUP).isNull() | ~F.col(GROUP).isin(*INCOME_GROUPS), "row without a known income group", F.col(GROUP)
        ).alias(GROUP),
        fail_when(amount.isNull() | F.isnan(amount), "income that is null or no number", amount).alias("_amount"),
    )
    sums = checked.groupBy(NAME).agg(*[
        F.coalesce(exact_sum(F.when(F.col(GROUP) == g, F.col("_amount"))), F.lit(0)).alias(g) for g in INCOME_GROUPS
    ])
    cells = [F.col(g) for g in INCOME_GROUPS]
    total = reduce(lambda a, b: a + b, cells)
    sound = fail_when(
        F.least(*cells) < 0, F.concat(F.lit("negative group amount: "), F.col(NAME)),
        fail_when(total <= 0, F.concat(F.lit("income total is not positive: "), F.col(NAME)), total),
    )
    return sums.withColumn("_total", sound).select(
        NAME, *[c.cast("double").alias(g) for c, g in zip(cells, INCOME_GROUPS)],
        *[share(F.col(g), F.col("_total"), None).alias(share_column(g)) for g in INCOME_GROUPS],
        F.col("_total").cast("double").alias(TOTAL),
    )


def profile_problems(income: DataFrame) -> DataFrame:
    """(problema, filas): what would stop ``build_municipality_income_profile``, as rows.

    Row checks are counted in one aggregation; cell and total checks follow on the sums of the
    sound rows, one row per municipality.
    """
    require_columns(income, [NAME, GROUP, COLLECTED_TOTAL], "check income profiles")
    name, amount = strip(F.col(NAME).cast("string")), F.col(COLLECTED_TOTAL).try_cast("double")
    nameless, groupless = name.isNull() | (name == ""), F.col(GROUP).isNull() | ~F.col(GROUP).isin(*INCOME_GROUPS)
    amountless = amount.isNull() | F.isnan(amount)
    rows = income.select(
        name.alias("_name"), F.col(GROUP).alias("_group"), amount.alias("_amount"),
        F.struct(nameless.alias("a"), groupless.alias("b"), amountless.alias("c")).alias("_bad"),
    )
    bad = F.col("_bad.a") | F.col("_bad.b") | F.col("_bad.c")
    cells = rows.groupBy("_name", "_group", "_bad").agg(F.count(F.lit(1)).alias("_n"), exact_sum(F.when(~bad, F.col("_amount"))).alias("_sum"))
    per_name = cells.groupBy("_name").agg(
        *[F.sum(F.when(F.col(f"_bad.{c}"), F.col("_n"))).alias(c) for c in "abc"],
        F.count(F.when(F.col("_sum") < 0, 1)).alias("d"), F.max(F.when(~bad, 1)).alias("_sound"), F.sum("_sum").alias("_total"),
    )
    counts = per_name.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in "abcd"],
                          F.count(F.when((F.col("_sound") == 1) & (F.col("_total") <= 0), 1)).alias("e"))
    told = {"a": "row without a municipality name", "b": "row without a known income group", "c": "income that is null or no number",
            "d": "negative group amount", "e": "income total is not positive"}
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("problema"), F.col(c).alias("filas")) for c, t in told.items()]))).filter("filas > 0")


def ensure_municipality_income_profile(income: DataFrame) -> DataFrame:
    """Takes classified rows or a finished profile."""
    if not isinstance(income, DataFrame):
        raise TypeError("income must be a DataFrame of classified rows or of profiles")
    ready = set(PROFILE_COLUMNS) <= set(income.columns)
    return income if ready else build_municipality_income_profile(income)


def share_order(sort_priority: Sequence[str] | None = None, ascending: bool = False) -> list[Column]:
    """Sort columns: shares in order of priority, then the name; the name alone by default."""
    groups = () if sort_priority is None else check_group_sequence(
        sort_priority, parameter="sort_priority", require_all=False
    )
    shares = [F.col(share_column(g)) for g in groups]
    return [*[c.asc() if ascending else c.desc() for c in shares], F.col(NAME).asc()]


def sort_municipalities_by_share(
    profile: DataFrame, *, sort_priority: Sequence[str] | None = None, ascending: bool = False,
) -> DataFrame:
    return profile.orderBy(*share_order(sort_priority, ascending))


def sort_municipalities_by_total(profile: DataFrame, ascending: bool = False) -> DataFrame:
    total = F.col(TOTAL)
    return profile.orderBy(total.asc() if ascending else total.desc(), F.col(NAME).asc())


def clr(shares: Sequence[Column], zero_replacement: float = 0.001) -> Column:
    """Centred log-ratio of percentages: zeros replaced, row closed to 1, logs centred."""
    if not 0 < zero_replacement < 1:
        raise ContractError("zero_replacement must be between 0 and 1")
    parts = F.array(*[
        F.when(s <= 0, F.lit(float(zero_replacement))).otherwise(s.cast("double") / 100) for s in shares
    ])
    whole = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    logs = F.transform(parts, lambda x: F.ln(x / whole))
    mean = F.aggregate(logs, F.lit(0.0), lambda total, x: total + x) / len(shares)
    return F.transform(logs, lambda x: x - mean)


def clr_features(profile: DataFrame, zero_replacement: float = 0.001) -> DataFrame:
    """(name, clr array) per municipality."""
    return profile.select(NAME, clr([F.col(s) for s in SHARES], zero_replacement).alias("clr"))
