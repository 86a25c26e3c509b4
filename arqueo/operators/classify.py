"""Income scope and exclusive income groups, as Columns."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo import rules
from arqueo.functions.numeric import audit_integer, quoted
from arqueo.functions.text import accent_free_upper, plain_casefold
from arqueo.operators.staging import broadcast_if_small, join_same
from arqueo.schema import (
    CANONICAL_GROUP, CAPITAL, CURRENT, FCM, FIRST_MODERN_YEAR, GROUP, INCOME_GROUPS, IPP,
    MAPPING_METHOD, MAPPING_STATUS, OTHER, SERVICE_CODE, SERVICE_NAME, SUBASSIGNMENT, SUBTITLE,
    TYPE_CODE, YEAR,
)

Key = tuple[int, int]
ACCOUNT_TEXT = (
    "source_nombre_subtitulo", "source_nombre_item",
    "source_nombre_asignacion", "source_nombre_subasignacion",
)


# what ``mapping_facts`` adds and ``decided_income`` takes away
MAPPING_FACTS = ("_unruled", "_transfer", "_early")


def municipal_income(columns: Iterable[str]) -> Column:
    """Account type 1 of the municipal service, told by code or by name; null is no."""
    service = plain_casefold(F.col(SERVICE_NAME)).isin(*rules.MUNICIPAL_SERVICE_NAMES)
    if SERVICE_CODE in columns:
        service = F.coalesce(F.col(SERVICE_CODE) == 1, F.lit(False)) | F.coalesce(service, F.lit(False))
    return (F.col(TYPE_CODE) == 1) & service


def key_in(pairs: Iterable[Key], subtitle: str = SUBTITLE, subassignment: str = SUBASSIGNMENT) -> Column:
    """Membership of (subtitle, sub-assignment) in a short list of pairs; null never matches."""
    by_subtitle = defaultdict(list)
    for first, second in pairs:
        by_subtitle[int(first)].append(str(int(second)))
    found = " OR ".join(
        f"({quoted(subtitle)} = {first} AND {quoted(subassignment)} IN ({', '.join(seconds)}))"
        for first, seconds in by_subtitle.items()
    )
    return F.expr(f"coalesce({found or 'false'}, false)")


def income_key(columns: Iterable[str]) -> Column:
    """(subtitle, sub-assignment) of a municipal income row, else null."""
    known = F.col(SUBTITLE).isNotNull() & F.col(SUBASSIGNMENT).isNotNull()
    return F.when(municipal_income(columns) & known, F.struct(SUBTITLE, SUBASSIGNMENT))


def is_ipp(columns: Iterable[str], keys: Iterable[Key] = rules.IPP_KEYS) -> Column:
    return F.coalesce(municipal_income(columns) & key_in(keys), F.lit(False))


def is_fcm(columns: Iterable[str], keys: Iterable[Key] = rules.FCM_KEYS) -> Column:
    return F.coalesce(municipal_income(columns) & key_in(keys), F.lit(False))


def income_group(
    columns: Iterable[str], ipp_keys: Iterable[Key] = rules.IPP_KEYS,
    fcm_keys: Iterable[Key] = rules.FCM_KEYS,
) -> Column:
    """The canonical group when there is a valid one, else the group told by the account key."""
    by_key = (
        F.when(key_in(ipp_keys), IPP)
        .when(key_in(fcm_keys), FCM)
        .when(F.col(SUBTITLE) == 5, CURRENT)
        .when(F.col(SUBTITLE) == 13, CAPITAL)
        .otherwise(OTHER)
    )
    fallback = F.when(income_key(columns).isNotNull(), by_key)
    if CANONICAL_GROUP not in columns:
        return fallback
    canonical = F.col(CANONICAL_GROUP)
    return F.when(canonical.isin(*INCOME_GROUPS), canonical).otherwise(fallback)


def classified_income(df: DataFrame) -> DataFrame:
    """Municipal income rows with their group; a row without one stops the job."""
    group = income_group(df.columns)
    checked = F.coalesce(group, F.raise_error(F.lit("municipal income row that could not be classified")))
    return df.filter(municipal_income(df.columns)).withColumn(GROUP, checked)


def account_text() -> Column:
    """The four source account names, accent-free and upper case, each preceded by `` | ``."""
    return accent_free_upper(F.expr("concat(" + ", ".join(f"' | ', coalesce({c}, '')" for c in ACCOUNT_TEXT) + ")"))


def rule_spans(crosswalk: DataFrame) -> DataFrame:
    """(source_cod_subtitulo, source_cod_item, first_year, last_year, canonical_group): dated rules without overlaps.

    The first years of a key's rules and the years after their last ones cut time into spans. A
    rule that holds at the start of a span holds in all of it, and of several the last one wins.
    Years are few, so a key has few spans however many rules it has; rules meet their spans by
    the key, and the winner is a partial aggregate. A rule without a year never holds, one without
    a group wins with a null.
    """
    keys = ["source_cod_subtitulo", "source_cod_item"]
    dated = crosswalk.filter("valid_from <= valid_to").select("rule_no", "canonical_group", *keys, *[F.col(c).cast("int").alias(c) for c in ("valid_from", "valid_to")])
    cuts = dated.select(*keys, F.explode(F.array("valid_from", F.col("valid_to") + 1)).alias("_at")).groupBy(*keys).agg(
        F.sort_array(F.collect_set("_at")).alias("_cuts")
    )
    inside = join_same(dated, cuts, keys).withColumn(
        "first_year", F.explode(F.filter("_cuts", lambda y: (y >= F.col("valid_from")) & (y <= F.col("valid_to"))))
    ).withColumn("last_year", F.array_min(F.filter("_cuts", lambda y: y > F.col("first_year"))) - 1)
    last = F.max(F.struct("rule_no", "canonical_group"))["canonical_group"]
    return inside.groupBy(*keys, "first_year", "last_year").agg(last.alias("canonical_group"))


def with_dated_rule(df: DataFrame, crosswalk: DataFrame, year: str, subtitle: Column, item: Column) -> DataFrame:
    """Adds ``_dated_group``: the last rule whose key and period match, or null.

    Spans of a key do not overlap, so a row meets one at most: no regrouping of the large side.
    """
    spans = broadcast_if_small(rule_spans(crosswalk)).withColumnsRenamed({
        "source_cod_subtitulo": "_rule_subtitle", "source_cod_item": "_rule_item", "first_year": "_rule_from", "last_year": "_rule_to",
        "canonical_group": "_dated_group",
    })
    return df.withColumns({"_subtitle": subtitle, "_item": item}).join(
        spans,
        (F.col("_subtitle") == F.col("_rule_subtitle")) & (F.col("_item") == F.col("_rule_item")) & F.col(year).between(F.col("_rule_from"), F.col("_rule_to")),
        "left",
    ).drop("_subtitle", "_item", "_rule_subtitle", "_rule_item", "_rule_from", "_rule_to")


# decisions made without a dated rule: group, status, method
DECISIONS = (
    *((g, "mapped", "modern_code") for g in (FCM, IPP, CAPITAL, CURRENT, OTHER)),
    (FCM, "mapped", "legacy_text"), (IPP, "mapped", "legacy_text"), (OTHER, "mapped", "legacy_other"),
    (CAPITAL, "review", "legacy_transfer_capital_keyword"), (CURRENT, "review", "legacy_transfer_default_current"),
)


def _decision(group: str, method: str) -> Column:
    """The place of a decision in ``DECISIONS``: one number takes the way through the joins."""
    return F.lit(next(i for i, (g, _, m) in enumerate(DECISIONS) if (g, m) == (group, method)))


def mapping_facts(
    df: DataFrame, ipp_keys: Iterable[Key] = rules.IPP_KEYS, fcm_keys: Iterable[Key] = rules.FCM_KEYS,
) -> DataFrame:
    """Adds what the decision needs besides the dated rule (``MAPPING_FACTS``), row by row.

    ``_unruled`` is the decision where no dated rule holds, ``_transfer`` that of early
    transfers, ``_early`` tells municipal income of the years that dated rules are for.
    """
    scope = (F.col(TYPE_CODE) == 1) & (
        F.coalesce(F.col(SERVICE_CODE) == 1, F.lit(False))
        | (accent_free_upper(F.col(SERVICE_NAME)) == "GESTION MUNICIPAL")
    )
    staged = df.withColumn("_scope", F.coalesce(scope, F.lit(False)))
    modern, legacy = F.col(YEAR) >= FIRST_MODERN_YEAR, F.col(YEAR) < FIRST_MODERN_YEAR
    staged = staged.withColumn("_text", F.when(F.col("_scope") & legacy, account_text()))
    text, early = F.col("_text"), F.col("_text").isNotNull()
    by_code = (
        F.when(key_in(fcm_keys), _decision(FCM, "modern_code")).when(key_in(ipp_keys), _decision(IPP, "modern_code"))
        .when(F.col(SUBTITLE) == 13, _decision(CAPITAL, "modern_code")).when(F.col(SUBTITLE) == 5, _decision(CURRENT, "modern_code"))
        .otherwise(_decision(OTHER, "modern_code"))
    )
    transfer = audit_integer(F.col("source_cod_subtitulo")) == 6
    by_keyword = F.when(
        text.rlike(rules.LEGACY_CAPITAL_PATTERN), _decision(CAPITAL, "legacy_transfer_capital_keyword")
    ).otherwise(_decision(CURRENT, "legacy_transfer_default_current"))
    by_text = (
        F.when(text.rlike(rules.LEGACY_FCM_PATTERN), _decision(FCM, "legacy_text"))
        .when(text.rlike(rules.LEGACY_IPP_PATTERN), _decision(IPP, "legacy_text"))
        .when(transfer, by_keyword)
        .otherwise(_decision(OTHER, "legacy_other"))
    )
    return staged.withColumns({
        "_unruled": F.when(F.col("_scope") & modern, by_code).when(early, by_text),
        "_transfer": F.when(early & transfer, by_keyword),
        "_early": early,
    }).drop("_scope", "_text")


def decided_income(df: DataFrame, crosswalk: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Group, status and method from ``MAPPING_FACTS`` and the dated rules.

    Read off the joined rows by one projection: nothing between it and the join keeps columns
    alive that the job does not read. With ``whole`` a projection of its own makes the decision
    and hands packed rows on as one value, for jobs that filter rows by several of its fields:
    Spark would name each field anew at every join and copy the filter for all these names.
    """
    if crosswalk is None:
        ruled = df.withColumn("_dated_group", F.lit(None).cast("string"))
    else:
        ruled = with_dated_rule(
            df, crosswalk, YEAR,
            audit_integer(F.col("source_cod_subtitulo")), audit_integer(F.col("source_cod_item")),
        )
    dated = F.col("_dated_group")
    held = F.col("_early") & dated.isNotNull()
    # transfers give way to permanent income only, not to other dated rules
    by_rule = held & (dated.isin(IPP, FCM) | F.col("_transfer").isNull())
    number = F.when(held, F.col("_transfer")).otherwise(F.col("_unruled"))

    def chosen(rule: Column, field: int) -> Column:
        made = F.get(F.array(*[F.lit(d[field]) for d in DECISIONS]), number)
        return F.when(by_rule, rule).otherwise(made)

    fields = {
        CANONICAL_GROUP: chosen(dated, 0),
        MAPPING_STATUS: F.coalesce(chosen(F.lit("mapped"), 1), F.lit("not_applicable")),
        MAPPING_METHOD: F.coalesce(chosen(F.lit("legacy_crosswalk"), 2), F.lit("not_applicable")),
    }
    if whole:
        none = F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(fields, (None, "not_applicable", "not_applicable"))])
        made = F.when(by_rule | number.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()])).otherwise(none)
        ruled = ruled.withColumn("_decision", made)
        fields = {n: F.col("_decision")[n] for n in fields}
    return ruled.withColumns(fields).drop("_dated_group", "_decision", *MAPPING_FACTS)


def add_income_mapping(
    df: DataFrame, crosswalk: DataFrame | None = None,
    ipp_keys: Iterable[Key] = rules.IPP_KEYS, fcm_keys: Iterable[Key] = rules.FCM_KEYS,
) -> DataFrame:
    """Canonical group, mapping status and mapping method of every row.

    Modern years go by account key. Earlier years go by dated rule, then by account text;
    transfers of those years are split by keyword and marked for review.
    """
    return decided_income(mapping_facts(df, ipp_keys, fcm_keys), crosswalk)
