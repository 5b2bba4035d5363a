"""Rows placed in partitions by sort order, also where many rows are copies of one another."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import quoted
from tallyweave.sources.workspace import stored

SALT = "__salt"
#: Values of a column that travels as a digit, and the most that the digits of one number may reach.
FOLD_VALUES, FOLD_TOP = 64, 1 << 62
FOLDED_TYPES = ("string", "boolean", "int", "bigint")


def folded(df: DataFrame, keep: Collection[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all columns of few values folded into a few long numbers, and the way back after a shuffle.

    Every value found becomes a digit of a number, null the digit 0; other columns and those of ``keep``
    stay. The way back restores names, types and order of the columns and leaves further columns at the end.
    The table is read twice to find the values, so it should be cheap to read.
    """
    names = [c for c, t in df.dtypes if t in FOLDED_TYPES and c not in keep]
    if not names:
        return df, lambda rows: rows
    kinds = dict(df.dtypes)
    about = df.agg(*[F.approx_count_distinct(quoted(c)) for c in names]).first()
    few = [c for c, n in zip(names, about, strict=True) if n <= FOLD_VALUES]
    if not few:
        return df, lambda rows: rows
    # few values a column
    found = df.agg(*[F.sort_array(F.collect_set(quoted(c))).alias(f"v{i}") for i, c in enumerate(few)]).first()
    digits: list[list[tuple[str, Column, int, int]]] = [[]]
    top = 1
    for c, values in zip(few, found, strict=True):
        if top * (len(values) + 1) > FOLD_TOP:
            digits.append([])
            top = 1
        listed = F.array(*map(F.lit, values)).cast(f"array<{kinds[c]}>")
        digits[-1].append((c, listed, top, len(values) + 1))
        top *= len(values) + 1

    def number(part: list[tuple[str, Column, int, int]]) -> Column:
        terms = [F.coalesce(F.array_position(listed, F.col(quoted(c))), F.lit(0)) * F.lit(unit).cast("long") for c, listed, unit, _ in part]
        return sum(terms[1:], terms[0])

    def unfold(rows: DataFrame) -> DataFrame:
        back = {}
        for i, part in enumerate(digits):
            for c, listed, unit, base in part:
                digit = F.expr(f"CAST((__fold{i} div {unit}L) % {base}L AS INT)")
                back[c] = F.get(listed, digit - 1).alias(c)
        further = [c for c in rows.columns if c not in df.columns and not c.startswith("__fold")]
        own = [back[c] if c in back else _apart(c) if [c] == rest[:1] else F.col(quoted(c)) for c in df.columns]
        return rows.select(*own, *map(quoted, further))

    rest = [c for c in df.columns if c not in few]
    numbers = [number(part).alias(f"__fold{i}") for i, part in enumerate(digits)]
    return df.select(*[_apart(c) for c in rest[:1]], *map(quoted, rest[1:]), *numbers), unfold


def _apart(c: str) -> Column:
    """The column itself, by a lambda: Spark generates the code of its step in many small methods then.

    In one they are too long for the JVM to compile, and the step takes ten times as long.
    """
    return F.transform(F.array(quoted(c)), lambda value: value)[0].alias(c)


def range_placed(
    df: DataFrame, keys: list[str], descending: Collection[str] = (), partitions: int | None = None, fold: bool = False
) -> DataFrame:
    """Range partitions sorted by the keys.

    A random number on every row ends the order, so that rows of one key, however many, spread
    over partitions. It is fixed by writing the table once; the range bounds and the rows are
    then read from that copy and the input is evaluated once. A table that carries the number
    already is not written again. With ``fold`` columns of few values travel as the digits of a number.
    """
    if SALT not in df.columns:
        df = stored(df.withColumn(SALT, F.rand(17)), "salted")
    order = [F.col(quoted(k)).desc() if k in descending else F.col(quoted(k)) for k in keys]
    order.append(F.col(SALT))
    rows, unfold = folded(df, {*keys, SALT}) if fold else (df, lambda placed: placed)
    placed = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return unfold(placed.sortWithinPartitions(*order)).drop(SALT)
