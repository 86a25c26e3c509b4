"""Number parsing and sums as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.functions.text import BLANKS

MONEY = T.DecimalType(38, 6)
THOUSANDS = r"^[+-]?\d{1,3}([.,]\d{3})+$"


def quoted(column: str) -> str:
    return f"`{column}`"


def trimmed_sql(column: str) -> str:
    """The trimmed text of a column, as SQL text: wide tables do this to dozens of columns.

    A text that begins and ends with a printable ASCII character is its own trimmed text; only
    others are searched for each of the many blanks.
    """
    text = f"CAST({quoted(column)} AS STRING)"
    inside = [rf"{end} >= '!' AND {end} < '\u007f'" for end in (text, f"substr({text}, -1)")]
    bare = " AND ".join(inside)
    return f"CASE WHEN {bare} THEN {text} ELSE btrim({text}, '{BLANKS}') END"


def _suffix_free(text: str) -> str:
    """No letter that the cast to a number would take as a type suffix of Java (``1.5d``)."""
    return "NOT (" + " OR ".join(f"contains({text}, '{letter}')" for letter in "dDfF") + ")"


def fail_when(condition: Column, message: Column | str, value: Column) -> Column:
    """``value``, unless ``condition`` holds: then the job stops with ``message``.

    The check rides in the plan that uses the value, so it costs no pass of its own.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.raise_error(text)).otherwise(value)


def to_number(column: str) -> Column:
    """Double, null where the text of the column is no number.

    The cast trims by itself. Texts with the letter of a type suffix are no numbers, nor are
    those that begin like none: a failing cast costs as much as a hundred others.
    """
    text = f"CAST({quoted(column)} AS STRING)"
    begins = f"({text} < ':' OR lower(substr({text}, 1, 3)) = 'nan')"
    # most cells of a wide row are empty: nothing but the first test is run on them
    return F.expr(f"CASE WHEN {text} IS NOT NULL AND {begins} AND {_suffix_free(text)} THEN try_cast({text} AS DOUBLE) END")


def code_number(column: str) -> Column:
    """The number behind a code text, thousands separators removed; may be fractional.

    Most codes are short whole numbers and only need a cast to an integer. That cast would cut
    fractions and drop a delete mark, and only up to 15 digits does a double hold the same number.
    The rest is trimmed of all blanks, and the pattern is only tried on texts that hold a separator.
    """
    raw, text = f"CAST({quoted(column)} AS STRING)", trimmed_sql(column)
    short = f"{raw} IS NOT NULL AND {raw} < ':' AND octet_length({raw}) < 16"
    digits = f"CASE WHEN {short} AND NOT contains({raw}, '.') AND NOT contains({raw}, '\u007f') THEN try_cast({raw} AS BIGINT) END"
    plain = f"{raw} < ':' AND NOT contains({raw}, '.') AND NOT contains({raw}, ',') AND {_suffix_free(raw)}"
    separated = f"(contains({raw}, '.') OR contains({raw}, ','))"
    bare = f"CASE WHEN {separated} AND {text} RLIKE r'{THOUSANDS}' THEN replace(replace({text}, '.'), ',') ELSE {text} END"
    other = f"CASE WHEN {_suffix_free(raw)} AND {raw} RLIKE '[0-9]|(?i:nan)' THEN try_cast({bare} AS DOUBLE) END"
    return F.expr(
        f"CASE WHEN {raw} IS NOT NULL THEN coalesce(CAST({digits} AS DOUBLE), CASE WHEN {plain} THEN try_cast({raw} AS DOUBLE) END, {other}) END"
    )


def whole_number(number: str, column: str) -> Column:
    """A code number as an integer; a fraction stops the job."""
    message = f"concat('column {column} holds a code that is no integer: ', CAST({quoted(number)} AS STRING))"
    return F.expr(
        f"CASE WHEN {quoted(number)} <> floor({quoted(number)}) THEN raise_error({message}) "
        f"ELSE CAST({quoted(number)} AS BIGINT) END"
    )


def parse_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Integer codes from text; no number gives null, a fraction stops the job.

    Two projections, so that each text is parsed once though its number is used three times.
    """
    return df.withColumns({c: code_number(c) for c in columns}).withColumns({c: whole_number(c, c) for c in columns})


def audit_integer(text: Column) -> Column:
    """Integer from an audit text that may read ``7.0``."""
    return text.try_cast("double").try_cast("bigint")


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns; null only when every column is null."""
    names = [quoted(c) for c in columns]
    total = " + ".join(f"coalesce({n}, 0D)" for n in names)
    return F.expr(f"CASE WHEN coalesce({', '.join(names)}) IS NOT NULL THEN {total} END")


def exact_sum(amount: Column, precision: T.DecimalType = MONEY) -> Column:
    """Sum in decimals: the same on every run whatever the order rows arrive in.

    ``precision`` is that of the amounts and of the sum: six places by default, with room for
    32 digits before the point.
    """
    return F.sum(amount.cast(precision)).cast(precision)


def share(part: Column, whole: Column, when_zero: float | None) -> Column:
    """Percent of ``whole``; ``when_zero`` where the whole is 0."""
    zero = F.lit(when_zero).cast("double")
    return F.when(whole != 0, part.cast("double") / whole.cast("double") * 100).otherwise(zero)
