"""Row-level demographic rules, indices and targets.

Each function adds its columns in one step and returns the table unchanged if the
columns it needs are absent. Null or non-numeric input falls to a rule's default.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions.columns import containing
from tallyweave.functions.expressions import (
    as_code,
    as_double,
    as_int,
    below_cuts,
    code_is,
    column,
    first_case,
    flag,
    in_bands,
    matches_any,
    mean_of,
    target,
)
from tallyweave.operators.groups import geographic_aggregates, household_aggregates


def _or_null_label(value: Column, rule: Column, null_label: str | None) -> Column:
    return rule if null_label is None else F.when(value.isNull(), F.lit(null_label)).otherwise(rule)


def age_features(df: DataFrame, age: str = "P03", null_label: str | None = None) -> DataFrame:
    """Age groups and flags; ``null_label`` names the group of unknown ages."""
    if age not in df.columns:
        return df
    years = as_int(age)
    low, high = presets.WORKING_AGE
    detail = below_cuts(years, presets.AGE_DETAIL, presets.AGE_DETAIL_DEFAULT)
    economic = below_cuts(years, presets.AGE_ECONOMIC, presets.AGE_ECONOMIC_DEFAULT)
    return df.withColumns(
        {
            "grupo_edad_detallado": _or_null_label(years, detail, null_label),
            "grupo_edad_economico": _or_null_label(years, economic, null_label),
            "es_dependiente_demografico": flag((years < low) | (years >= high)),
            "es_poblacion_activa": flag((years >= low) & (years < high)),
        }
    )


def age_bands(df: DataFrame, age: str = "P03", name: str = "banda_edad") -> DataFrame:
    """Configured age bands and the active-age range, both ends included."""
    if age not in df.columns:
        return df
    low, high = presets.ACTIVE_AGE_RANGE
    return df.withColumns(
        {
            name: in_bands(as_int(age), presets.AGE_BANDS),
            "en_edad_activa": flag(as_int(age).between(low, high)),
        }
    )


def income_bands(
    df: DataFrame,
    income: str = "ingrl",
    thresholds: Mapping[str, float] = presets.INCOME_THRESHOLDS,
    name: str = "nivel_ingreso",
) -> DataFrame:
    """Name of the first threshold the income is below, else ``superior``."""
    if income not in df.columns:
        return df
    value = as_double(income)
    return df.withColumn(
        name, F.when(value.isNotNull(), below_cuts(value, list(thresholds.items()), "superior"))
    )


def sex_features(df: DataFrame, sex: str = "P02") -> DataFrame:
    if sex not in df.columns:
        return df
    return df.withColumns(
        {
            "sexo_descripcion": first_case(
                [(code_is(sex, code), label) for code, label in presets.SEX_CODES.items()],
                presets.SEX_DEFAULT,
            ),
            "es_mujer": flag(code_is(sex, "2")),
            "es_hombre": flag(code_is(sex, "1")),
        }
    )


def education_features(df: DataFrame, source_columns: Iterable[str] | None = None) -> DataFrame:
    found = containing(source_columns or df.columns, presets.EDUCATION_COLUMN_TERMS)
    if not found:
        return df
    level = as_code(found[0])
    return df.withColumns(
        {
            "tiene_educacion_superior": flag(matches_any(level, presets.HIGHER_EDUCATION)),
            "completo_educacion_basica": flag(matches_any(level, presets.BASIC_EDUCATION)),
            "nivel_educativo_numerico": first_case(
                [(matches_any(level, terms), n) for terms, n in presets.EDUCATION_LEVELS],
                presets.EDUCATION_LEVEL_DEFAULT,
            ),
        }
    )


def _categorised(df: DataFrame, parts: list[Column], index: str, category: str, labels) -> DataFrame:
    """Mean of the parts and its category by the two cuts."""
    if not parts:
        return df
    high, middle = presets.INDEX_CUTS
    value = mean_of(parts)
    return df.withColumns(
        {
            index: value,
            category: first_case([(value >= high, labels[0]), (value >= middle, labels[1])], labels[2]),
        }
    )


def vulnerability_index(df: DataFrame, source_columns: Iterable[str] | None = None) -> DataFrame:
    have, top = set(df.columns), presets.EDUCATION_LEVEL_MAX
    parts = []
    if "es_dependiente_demografico" in have:
        parts.append(column("es_dependiente_demografico"))
    if "tiene_educacion_superior" in have:
        parts.append(F.lit(1) - column("tiene_educacion_superior"))
    elif "nivel_educativo_numerico" in have:
        parts.append((F.lit(top) - column("nivel_educativo_numerico")) / F.lit(top))
    jobs = containing(source_columns or df.columns, presets.EMPLOYMENT_COLUMN_TERMS)
    if jobs:
        parts.append(flag(matches_any(as_code(jobs[0]), presets.NOT_EMPLOYED)))
    return _categorised(
        df, parts, "indice_vulnerabilidad_compuesto", "categoria_vulnerabilidad", presets.VULNERABILITY_LABELS
    )


def development_index(df: DataFrame) -> DataFrame:
    parts = []
    if "nivel_educativo_numerico" in df.columns:
        parts.append(column("nivel_educativo_numerico") / F.lit(presets.EDUCATION_LEVEL_MAX))
    parts += [column(c) for c in ("es_poblacion_activa", "es_urbano") if c in df.columns]
    return _categorised(
        df, parts, "indice_desarrollo_compuesto", "categoria_desarrollo", presets.DEVELOPMENT_LABELS
    )


def census_targets(df: DataFrame, source_columns: Iterable[str] | None = None) -> DataFrame:
    added = {}
    if "categoria_vulnerabilidad" in df.columns:
        added["target_vulnerabilidad_alta"] = target(column("categoria_vulnerabilidad") == "ALTA")
    if "tiene_educacion_superior" in df.columns:
        added["target_educacion_superior"] = column("tiene_educacion_superior").cast("double")
    kinship = containing(source_columns or df.columns, presets.KINSHIP_COLUMN_TERMS)
    if kinship:
        added["target_jefe_hogar"] = target(matches_any(as_code(kinship[0]), presets.HOUSEHOLD_HEAD))
    if "es_urbano" in df.columns:
        added["target_area_urbana"] = column("es_urbano").cast("double")
    return df.withColumns(added) if added else df


def survey_targets(df: DataFrame, source_columns: Iterable[str] | None = None) -> DataFrame:
    """Targets of the labour survey. ``source_columns`` keeps derived columns out of the search."""
    columns = list(source_columns or df.columns)
    added = {}
    jobs = containing(columns, presets.OCCUPATION_COLUMN_TERMS)
    if jobs:
        added["target_empleo_formal"] = target(matches_any(as_code(jobs[0]), presets.FORMAL_EMPLOYMENT))
    income = containing(columns, presets.INCOME_COLUMN_TERMS)
    if income:
        added["target_ingresos_suficientes"] = target(as_double(income[0]) >= presets.SUFFICIENT_INCOME)
    if "es_urbano" in df.columns:
        added["target_area_urbana_enemdu"] = column("es_urbano").cast("double")
    return df.withColumns(added) if added else df


def is_census(table: str) -> bool:
    return "censo" in table.lower() or table in presets.REQUIRED_TABLES


def table_features(
    df: DataFrame,
    table: str,
    tie_break: list[str] | None = None,
    age: str | None = None,
    sex: str | None = None,
    province_values: bool = True,
    household_values: bool = True,
) -> DataFrame:
    """All features of one table: person rules, group values, indices, then targets.

    ``age`` and ``sex`` name the columns of a table that are not the usual ones of that table.
    ``province_values=False`` leaves out the province totals, ranks and percentiles, which
    sort the whole table, and ``household_values=False`` the values of the household, which
    shuffle it, for callers that do not use them or add them elsewhere.
    """
    source = df.columns
    usual = presets.AGE_SEX_COLUMNS_BY_TABLE.get(table, presets.AGE_SEX_COLUMNS)
    age, sex = age or usual[0], sex or usual[1]
    tie_break = tie_break or [c for c in presets.ID_COLUMNS.get(table, []) if c in source] or source
    # group values first: they move the rows, and the source columns are the fewest to move
    grouped = geographic_aggregates(df, "censo" if is_census(table) else "enemdu", tie_break) if province_values else df
    if household_values and table == "poblacion":
        grouped = household_aggregates(grouped, age=age)
    ruled = education_features(sex_features(age_features(grouped, age), sex), source)
    out = development_index(vulnerability_index(ruled, source))
    out = census_targets(out, source) if is_census(table) else survey_targets(out, source)
    rules = [c for c in ruled.columns if c not in grouped.columns]
    values = [c for c in grouped.columns if c not in source]
    rest = [c for c in out.columns if c not in ruled.columns]
    return out.select(*[column(c) for c in (*source, *rules, *values, *rest)])


def all_features(tables: Mapping[str, DataFrame], **options) -> dict[str, DataFrame]:
    """Features of every data table; dictionaries pass through."""
    return {
        name: df if name.startswith(presets.DICTIONARY_PREFIX) else table_features(df, name, **options)
        for name, df in tables.items()
    }
