"""Scalar column expressions: safe arithmetic and text parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts accepted in raw text, tried in this order.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "M/d/yyyy",
    "M-d-yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
)

# Spellings of booleans in text.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")

_NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF](inity)?)$"


def finite(value: Column) -> Column:
    """Map NaN and both infinities to null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null for a zero denominator or a non-finite result."""
    return finite(F.try_divide(numerator.cast("double"), denominator.cast("double")))


def ratio_sql(numerator: str, denominator: str) -> str:
    """SQL text of :func:`safe_ratio` for finite operands."""
    return f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))"


def percent_change(current: Column, base: Column) -> Column:
    """Percentage change against a base; null when the base is zero or unknown."""
    return safe_ratio(current - base, base) * 100


def percent_of_magnitude(current: Column, base: Column) -> Column:
    """Percentage change against the magnitude of the base."""
    return safe_ratio(current - base, F.abs(base)) * 100


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First declared layout that fits; null when none does."""
    trimmed = F.trim(text)
    return F.coalesce(
        *[F.try_to_timestamp(trimmed, F.lit(f)) for f in formats]
    ).cast("date")


def count_text(text: Column, accounting_negatives: bool = True) -> Column:
    """Canonical text of a count: no thousands commas, ``(n)`` as ``-n``, blank as null."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    if accounting_negatives:
        plain = F.regexp_replace(plain, r"^\((.*)\)$", r"-$1")
    return F.nullif(plain, F.lit(""))


def parse_count(text: Column, accounting_negatives: bool = True) -> Column:
    """Number in a count text; null when blank or not numeric. Infinities are kept."""
    plain = count_text(text, accounting_negatives)
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def invalid_count(text: Column, accounting_negatives: bool = True) -> Column:
    """True when a count text is present but is not a number."""
    plain = count_text(text, accounting_negatives)
    return plain.isNotNull() & parse_count(text, accounting_negatives).isNull()


def parse_boolean(value: Column) -> Column:
    """Text boolean; anything unrecognised, and null, is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def invalid_boolean(value: Column) -> Column:
    word = F.lower(F.trim(value.cast("string")))
    return F.coalesce(
        (word != "") & ~word.isin(*TRUE_WORDS, *FALSE_WORDS), F.lit(False)
    )


def truthy(flag: Column) -> Column:
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def exceeds(left: Column, right: Column) -> Column:
    """``left > right`` with an unknown side counting as no."""
    return F.coalesce(left > right, F.lit(False))


def is_fractional(value: Column) -> Column:
    """Fractional part above the tolerance, with the sign rule of Python's modulo.

    A value just below an integer counts as fractional.
    """
    rest = finite(value) % F.lit(1.0)
    return F.coalesce(F.when(rest < 0, rest + 1).otherwise(rest) > 1e-9, F.lit(False))


def joined_labels(*pairs: tuple[Column, str], default: str | None = None) -> Column:
    """``; ``-joined names of the conditions that hold, in the given order."""
    text = F.concat_ws("; ", *[F.when(cond, F.lit(name)) for cond, name in pairs])
    text = F.nullif(text, F.lit(""))
    return F.coalesce(text, F.lit(default)) if default is not None else text


def right_closed_band(value: Column, edges: Sequence[float | Column], names: Sequence[str]) -> Column:
    """Name of the right-closed interval that holds ``value``; ``len(names) == len(edges) + 1``."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, names):
        out = out.when(value <= edge, F.lit(name))
    return out.otherwise(F.lit(names[-1]))
