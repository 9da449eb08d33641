"""Text cleaning, tokens, keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .country_values import COUNTRY_LABELS, FOLD_FROM, FOLD_TO


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    """Trim; text that is empty after trimming becomes NULL."""
    return F.nullif(F.trim(_c(value)), F.lit(""))


def collapse_whitespace(value: Column | str) -> Column:
    return F.regexp_replace(_c(value), r"\s+", " ")


def text_token(value: Column | str) -> Column:
    """Lower-case token with whitespace runs as underscores."""
    return F.regexp_replace(F.lower(F.trim(_c(value))), r"\s+", "_")


def location_token(value: Column | str) -> Column:
    """``text_token`` without anything but ``a-z``, digits and underscores.

    The text is lower case by then, so non-word characters are exactly the ones to drop.
    A negated range such as ``[^a-z0-9_]`` makes concurrent tasks of one JVM contend in
    the regex engine and ran ten times slower with eight of them.
    """
    return F.regexp_replace(text_token(value), r"\W+", "")


def presence_flag(value: Column | str) -> Column:
    return _c(value).isNotNull().cast("int")


def equality_flag(left: Column | str, right: Column | str) -> Column:
    """1 when both sides are equal; unknown on either side counts as 0."""
    return F.coalesce((_c(left) == _c(right)).cast("int"), F.lit(0))


def label_or(value: Column | str, fallback: Column | str) -> Column:
    """The label, or ``fallback`` (text or Column) when it is NULL or empty."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(_c(value), F.lit("")), other)


def composite_key(*parts: Column | str, sep: str = "_") -> Column:
    """Join the non-NULL parts as text."""
    return F.concat_ws(sep, *[_c(p).cast("string") for p in parts])


def country_token(value: Column | str) -> Column:
    """Look-up form of a country name: separators, accents and case removed."""
    plain = F.trim(F.regexp_replace(_c(value).cast("string"), "[_-]+", " "))
    folded = F.lower(F.regexp_replace(F.translate(plain, FOLD_FROM, FOLD_TO), r"\s+", " "))
    return F.regexp_replace(folded, r"[^\w ]", "")


def country_label(value: Column | str, labels: dict[str, str] | None = None) -> Column:
    """English display label; names outside the table are shown in title case."""
    table = COUNTRY_LABELS if labels is None else labels
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    shown = F.initcap(F.trim(F.regexp_replace(_c(value).cast("string"), "[_-]+", " ")))
    return F.coalesce(F.try_element_at(lookup, country_token(value)), shown)
