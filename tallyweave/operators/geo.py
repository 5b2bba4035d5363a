"""Three-level geography: province (2 digits), canton (4), parish (6)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions.columns import first_present, present, quoted
from tallyweave.functions.expressions import (
    as_code,
    code_is,
    first_case,
    flag,
    matches_any,
    padded_code,
    parent_code,
)
from tallyweave.operators.bounded import proven_small
from tallyweave.sources.workspace import stored


def province_names(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(
        padded_code("CODIGO", 2).alias("codigo_provincia_2d"),
        F.col("NOMBRE").alias("provinciaNombre"),
    ).distinct()


def canton_names(dictionary: DataFrame) -> DataFrame:
    code = padded_code("CODIGO", 4)
    return dictionary.select(
        parent_code(code, 2).alias("codigo_provincia_2d"),
        code.alias("codigo_canton_4d"),
        F.col("NOMBRE").alias("cantonNombre"),
    ).distinct()


def parish_names(dictionary: DataFrame) -> DataFrame:
    code = padded_code("CODIGO", 6)
    return dictionary.select(
        parent_code(code, 2).alias("codigo_provincia_2d"),
        parent_code(code, 4).alias("codigo_canton_4d"),
        code.alias("codigo_parroquia_6d"),
        F.col("NOMBRE").alias("parroquiaNombre"),
    ).distinct()


def with_parents(parishes: DataFrame, cantons: DataFrame, provinces: DataFrame) -> DataFrame:
    """Parishes with the names of their canton and province, where those are known."""
    return parishes.join(cantons, ["codigo_provincia_2d", "codigo_canton_4d"], "left").join(
        provinces, ["codigo_provincia_2d"], "left"
    )


def geographic_lookup(dictionaries: Mapping[str, DataFrame]) -> DataFrame | None:
    """Unified lookup, or None unless all three dictionaries are there."""
    parts = [dictionaries.get(k) for k in ("dict_parroquia", "dict_canton", "dict_provincia")]
    if any(p is None for p in parts):
        return None
    parish, canton, province = parts
    return (
        with_parents(parish_names(parish), canton_names(canton), province_names(province))
        .select(
            "codigo_parroquia_6d",
            "parroquiaNombre",
            "codigo_canton_4d",
            "cantonNombre",
            "codigo_provincia_2d",
            "provinciaNombre",
        )
        .distinct()
    )


def homologated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add fixed-width code columns for the geography columns that exist."""
    found = present(df, columns)
    if not found:
        return df
    return df.withColumns(
        {name: padded_code(c, width) for c in found for name, width in [presets.GEO_COLUMNS[c]]}
    )


def homologated_table(df: DataFrame, table: str) -> DataFrame:
    return homologated(df, presets.GEO_COLUMNS_BY_TABLE.get(table.lower(), []))


def lookup_levels(lookup: DataFrame | None) -> dict[str, DataFrame]:
    """Code column -> distinct names of that level, most specific level first.

    The lookup is evaluated once, into a written table that every level and every table located
    by it reads. A small one is broadcast at every level; a large one is checked level by level and
    shuffled where it stays large.
    """
    if lookup is None:
        return {}
    wanted = {
        "codigo_parroquia_6d": lookup.columns,
        "codigo_canton_4d": ["codigo_canton_4d", "cantonNombre", "codigo_provincia_2d", "provinciaNombre"],
        "codigo_provincia_2d": ["codigo_provincia_2d", "provinciaNombre"],
    }
    lookup = stored(lookup, "lookup")
    small = proven_small(lookup)

    def level(names: list[str]) -> DataFrame:
        distinct = lookup.select(*names).distinct()
        return F.broadcast(distinct) if small or proven_small(distinct) else distinct

    return {k: level(names) for k, names in wanted.items()}


def enriched(df: DataFrame, levels: Mapping[str, DataFrame]) -> DataFrame:
    """Add geography names by the most specific code level the table has."""
    for code, names in levels.items():
        if f"{code}_homo" in df.columns:
            return df.join(names, df[f"{code}_homo"] == names[code], "left")
    return df


def with_urban_flag(df: DataFrame, columns: tuple[str, ...] = ("area", "AUR")) -> DataFrame:
    c = first_present(df, columns)
    return df if c is None else df.withColumn("es_urbano", flag(code_is(c, "1")))


def with_regions(df: DataFrame) -> DataFrame:
    """Natural region by province code and named region by province name."""
    code = first_present(df, presets.PROVINCE_CODE_COLUMNS)
    name = first_present(df, presets.PROVINCE_NAME_COLUMNS)
    added = {}
    if code:
        added["region_geografica"] = first_case(
            [(as_code(code).isin(codes), region) for region, codes in presets.REGION_BY_PROVINCE.items()],
            presets.REGION_DEFAULT,
        )
    if name:
        added["region_especifica"] = first_case(
            [(matches_any(name, terms), region) for region, terms in presets.REGION_BY_NAME.items()],
            presets.REGION_BY_NAME_DEFAULT,
        )
    return df.withColumns(added) if added else df


def geographic_recode(df: DataFrame, table: str, levels: Mapping[str, DataFrame]) -> DataFrame:
    """Code columns, names, urban flag and regions of one table."""
    return with_regions(with_urban_flag(enriched(homologated_table(df, table), levels)))


def lookup_uniqueness(lookup: DataFrame, key: str = "codigo_parroquia_6d") -> DataFrame:
    return lookup.agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.struct(quoted(key))).alias("distinct_keys"),
        (F.count("*") == F.count_distinct(F.struct(quoted(key)))).alias("unique"),
    )
