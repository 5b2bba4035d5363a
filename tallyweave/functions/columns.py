"""Choosing columns by name. An operator whose input column is absent returns its input."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def select_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[F.col(quoted(n)) for n in present(df, names)])


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    return next(iter(present(df, names)), None)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def renamed(names: Mapping[str, str], columns: Iterable[str]) -> list[str]:
    """``selectExpr`` items ``old AS new`` for the columns that exist."""
    have = set(columns)
    return [f"{quoted(a)} AS {quoted(b)}" for a, b in names.items() if a in have]


def containing(
    columns: Iterable[str],
    terms: Iterable[str],
    exclude: Iterable[str] = (),
    limit: int | None = None,
) -> list[str]:
    """Columns whose name contains a term, whatever the case, and no excluded term."""
    terms = [t.lower() for t in terms]
    exclude = [t.lower() for t in exclude]
    hits = [
        c
        for c in columns
        if any(t in c.lower() for t in terms) and not any(t in c.lower() for t in exclude)
    ]
    return hits[:limit]


def starting(columns: Iterable[str], prefixes: Iterable[str], limit: int | None = None) -> list[str]:
    prefixes = tuple(p.lower() for p in prefixes)
    return [c for c in columns if c.lower().startswith(prefixes)][:limit]


def with_label(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.col(quoted(target)))
