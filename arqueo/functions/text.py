"""Text normal forms as built-in Column expressions.

Spark has no accent-stripping function, so the fold is a ``translate`` whose table is
generated once from the Unicode database: for every character whose compatibility
decomposition, without marks, is one character, that character; marks map to nothing.
The two common characters that expand to several letters are replaced before it. All other
such characters become one mark in the same pass, and only texts with that mark are spelt
out. Texts that are plain ASCII skip all of it.

The tables are long constants, and a fold costs a lookup per character. Facts repeat few
names very often: fold those by ``operators.dictionary``, once per distinct name.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPANDING = "ß…"
SPELT = "\ue000"  # private use: stands where a character is to be spelt out
# what str.strip() and str.split() treat as white space
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _decomposed(char: str) -> str:
    parts = unicodedata.normalize("NFKD", char)
    return "".join(c for c in parts if not unicodedata.combining(c))


@lru_cache(maxsize=2)
def _expansions(casefold: bool) -> tuple[str, str]:
    """Other characters of the basic plane that become several, and what each becomes (parted by line feeds)."""
    found = {}
    for point in (p for p in range(0x80, 0x10000) if not 0xD800 <= p < 0xE000):
        folded = _decomposed(chr(point).casefold()) if casefold else _decomposed(chr(point))
        if len(folded) > 1 and chr(point) not in EXPANDING:
            found[chr(point)] = folded
    return "".join(found), "\n".join(found.values())


@lru_cache(maxsize=2)
def _fold_tables(casefold: bool) -> tuple[str, str, str]:
    """(from, to, marks to drop) over the basic plane, one character to one character."""
    source, target, dropped = [], [], []
    for point in range(0x80, 0x10000):
        char = chr(point)
        if 0xD800 <= point < 0xE000:
            continue  # surrogates
        folded = _decomposed(char.casefold()) if casefold else _decomposed(char).upper()
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif not folded:
            dropped.append(char)
    return "".join(source), "".join(target), "".join(dropped)


def _fold(text: Column, casefold: bool) -> Column:
    plain = text
    for char in EXPANDING:
        expansion = _decomposed(char.casefold()) if casefold else _decomposed(char)
        plain = F.replace(plain, F.lit(char), F.lit(expansion))
    change_case = F.lower if casefold else F.upper
    source, target, dropped = _fold_tables(casefold)
    chars, expanded = _expansions(casefold)
    quick = F.translate(plain, source + chars + dropped, target + SPELT * len(chars))
    # the few different characters of a text that are to be spelt out, one after another
    listed = F.split(F.lit(chars), "")
    spelt = F.aggregate(
        F.array_intersect(F.split(plain, ""), listed), plain,
        lambda done, c: F.replace(done, c, F.element_at(F.split(F.lit(expanded), "\n"), F.array_position(listed, c).cast("int"))),
    )
    folded = F.when(quick.contains(SPELT), F.translate(spelt, source + dropped, target)).otherwise(quick)
    # only ASCII texts have as many bytes as characters
    ascii_only = F.octet_length(text) == F.char_length(text)
    return change_case(F.when(ascii_only, text).otherwise(folded))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def plain_casefold(text: Column) -> Column:
    """Trimmed, case ignored, accents kept."""
    return F.lower(strip(text))


def name_form(text: Column) -> Column:
    """Trimmed, case ignored, accents dropped; inner spaces and punctuation kept."""
    return _fold(strip(text), casefold=True)


def key_of_form(form: Column) -> Column:
    """``name_key`` of a text whose ``name_form`` is at hand."""
    return F.coalesce(F.upper(F.regexp_replace(form, "[^a-z0-9]+", "")), F.lit(""))


def name_key(text: Column) -> Column:
    """Letters and digits only, upper case; null gives the empty key."""
    return key_of_form(name_form(text))


def place_of_form(form: Column) -> Column:
    """``place_key`` of a text whose ``name_form`` is at hand."""
    return strip(F.regexp_replace(form, f"{SPACE}+", " "))


def place_key(text: Column) -> Column:
    """``name_form`` with runs of white space collapsed to one space."""
    return place_of_form(name_form(text))


def accent_free_upper(text: Column) -> Column:
    """Upper case without accents; not trimmed; null gives the empty text."""
    return _fold(F.coalesce(text, F.lit("")), casefold=False)


def words_of_form(form: Column) -> Column:
    """``word_set`` of a text whose ``name_form`` is at hand."""
    words = F.split(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def word_set(text: Column) -> Column:
    """Distinct alphanumeric words of ``name_form``."""
    return words_of_form(name_form(text))


def account_code(subtitle: Column, subassignment: Column) -> Column:
    return F.format_string("%02d-%07d", subtitle, subassignment)


def millions_label(amount: Column) -> Column:
    """``$1.234 MM``: millions with a dot between thousands."""
    return F.concat(
        F.lit("$"), F.translate(F.format_number(F.bround(amount / 1e6, 0), 0), ",", "."), F.lit(" MM")
    )


def wrapped(text: Column, width: int = 38) -> Column:
    """Words packed greedily into lines of at most ``width``, joined by ``<br>``."""
    packed = F.regexp_replace(strip(text), rf"(.{{1,{width}}}|\S{{{width + 1},}})(?:\s+|$)", "$1<br>")
    return F.regexp_replace(packed, "<br>$", "")
