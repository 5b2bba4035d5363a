"""Values of a whole group on each of its rows.

Each is an aggregate joined back to the rows instead of a window, so that a group with
a large share of all rows is reduced before the shuffle and never sits in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions.columns import first_present, present, quoted
from tallyweave.functions.expressions import as_double, as_int, flag
from tallyweave.operators.bounded import broadcast_checked
from tallyweave.operators.joins import null_safe
from tallyweave.operators.ranking import dense_rank_of_sizes, ntile_of, with_global_index
from tallyweave.sources.workspace import stored


def with_group_values(
    df: DataFrame, keys: list[str], values: Mapping[str, Column], few_groups: bool = False
) -> DataFrame:
    """Add aggregates over the rows with the same keys (null is a key like any other).

    ``few_groups`` writes the aggregates once and tries a size-checked broadcast of them;
    without it, or if they are too many, the join is shuffled.
    """
    stats = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*[v.alias(n) for n, v in values.items()])
    return join_group_values(df, stats, keys, list(values), few_groups)


def join_group_values(
    df: DataFrame, stats: DataFrame, keys: list[str], values: list[str], few_groups: bool = False
) -> DataFrame:
    own = {k: f"__g{i}" for i, k in enumerate(keys)}
    stats = stats.select(*[F.col(quoted(k)).alias(a) for k, a in own.items()], *[quoted(v) for v in values])
    if few_groups:
        stats = broadcast_checked(stored(stats, "groups"))
    kept = [df[quoted(c)] for c in df.columns if c not in values]
    return df.join(stats, null_safe(df, stats, own), "left").select(*kept, *[stats[quoted(v)] for v in values])


def province_sizes(df: DataFrame, province: str, name: str) -> DataFrame:
    return with_group_values(df, [province], {name: F.count("*")}, few_groups=True)


def geographic_aggregates(
    df: DataFrame,
    dataset: str,
    tie_break: list[str],
    province: str | None = None,
    tiles: int = 100,
    base: int = presets.DENSITY_BASE,
) -> DataFrame:
    """Rows per province, density, rank of the province and percentile of the row.

    Rows of equally large provinces are ordered by province and then by ``tie_break``,
    which should identify a row.
    """
    province = province or first_present(df, presets.PROVINCE_WINDOW_COLUMNS)
    if province is None:
        return df
    total, density, rank, tile = (
        f"{stem}_{dataset}"
        for stem in (
            "poblacion_total_provincia",
            "densidad_relativa_provincia",
            "ranking_provincial",
            "percentil_poblacional",
        )
    )
    sizes = df.groupBy(F.col(quoted(province))).agg(F.count("*").alias(total))
    ranked = dense_rank_of_sizes(sizes, total, rank)
    out = join_group_values(df, ranked, [province], [total, rank], few_groups=True)
    out = out.withColumn(density, F.col(total) / F.lit(base))
    order = list(dict.fromkeys([total, province, *tie_break]))
    indexed = with_global_index(out, order, "__idx", "__n", descending=[total])
    return indexed.withColumn(tile, ntile_of(F.col("__idx"), F.col("__n"), tiles)).select(
        *[quoted(c) for c in df.columns], total, density, rank, tile
    )


HOUSEHOLD_KEYS = ("ID_VIV", "ID_HOG")


def household_values(df: DataFrame, keys: tuple[str, str] = HOUSEHOLD_KEYS, age: str = "P03") -> DataFrame:
    """One row per household: persons and, where the age is known, mean, extremes and dependency."""
    size = "tamaño_hogar_calculado"
    values = {size: F.count("*")}
    if age in df.columns:
        years, whole = as_double(age), as_int(age)
        low, high = presets.WORKING_AGE
        values |= {
            "edad_promedio_hogar": F.avg(years),
            "edad_maxima_hogar": F.max(years),
            "edad_minima_hogar": F.min(years),
            "dependientes_hogar": F.sum(flag((whole < low) | (whole >= high))),
        }
    out = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*[v.alias(n) for n, v in values.items()])
    if age in df.columns:
        out = out.withColumn("ratio_dependencia_hogar", F.col("dependientes_hogar") / F.col(quoted(size)))
    return out


def household_aggregates(
    df: DataFrame, keys: tuple[str, str] = HOUSEHOLD_KEYS, age: str = "P03", onto: DataFrame | None = None
) -> DataFrame:
    """Household values on each person, or on the rows of another table with the same keys."""
    onto = df if onto is None else onto
    if len(present(df, keys)) < len(keys) or len(present(onto, keys)) < len(keys):
        return onto
    values = household_values(df, keys, age)
    return join_group_values(onto, values, list(keys), [c for c in values.columns if c not in keys])
