"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions.columns import quoted

Name = str | Column


def column(c: Name) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def as_code(c: Name) -> Column:
    return column(c).cast("string")


def as_double(c: Name) -> Column:
    """Number of a text; text that is no number is null."""
    return column(c).try_cast("double")


def as_int(c: Name) -> Column:
    """Whole part of a number or of a number's text; anything else is null."""
    return as_double(c).try_cast("int")


def padded_code(c: Name, width: int) -> Column:
    """Code as text, zeros on the left up to ``width``; a longer code is cut to ``width``."""
    return F.lpad(as_code(c), width, "0")


def parent_code(c: Name, width: int) -> Column:
    return F.substring(column(c), 1, width)


def code_is(c: Name, code: str) -> Column:
    return as_code(c) == F.lit(code)


def matches_any(c: Name, terms: Iterable[str]) -> Column:
    return column(c).rlike("(?i)(" + "|".join(terms) + ")")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, 1).otherwise(0)


def target(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def first_case(cases: Sequence[tuple[Column, object]], default: object) -> Column:
    """First case whose condition holds; null conditions fall to the default."""
    head, *rest = [(cond, F.lit(value)) for cond, value in cases]
    return reduce(lambda acc, cv: acc.when(*cv), rest, F.when(*head)).otherwise(F.lit(default))


def below_cuts(value: Column, cuts: Sequence[tuple[str, float]], default: str) -> Column:
    return first_case([(value < F.lit(top), label) for label, top in cuts], default)


def in_bands(value: Column, bands: Sequence[tuple[str, float, float]], default: str | None = None) -> Column:
    """Label of the band ``[low, high)`` that holds the value."""
    return first_case(
        [((value >= F.lit(lo)) & (value < F.lit(hi)), label) for label, lo, hi in bands], default
    )


def mean_of(parts: Sequence[Column]) -> Column:
    return reduce(add, parts) / F.lit(len(parts))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null for an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole)


def cell_bytes(c: str, dtype: str) -> Column:
    """Bytes one cell needs: the text or binary length, or 8 for a number."""
    if dtype in ("string", "binary"):
        return F.coalesce(F.octet_length(column(c)), F.lit(0)) + F.lit(8)
    if dtype.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column(c)))), F.lit(0)) + F.lit(8)
    return F.lit(8)
