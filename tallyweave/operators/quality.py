"""Data-quality profiles, checks and scores. Every metric table comes from one pass."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions.columns import first_present, present, quoted, starting
from tallyweave.functions.expressions import as_code, as_double, percent

# --- nulls and duplicates ---------------------------------------------------------


def _null_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(quoted(c)).isNull()) for c in df.columns]


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, nulls and null percent (2 decimals)."""
    nulls = [n.alias(f"n{i}") for i, n in enumerate(_null_counts(df))]
    counts = df.agg(F.count("*").alias("rows"), *nulls)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select(
        "c.*",
        F.coalesce(F.round(percent(F.col("c.null_count"), F.col("c.rows")), 2), F.lit(0.0)).alias("null_percent"),
    )


def null_summary(profile: DataFrame, high: float = presets.HIGH_NULL_PERCENT) -> DataFrame:
    """One row: columns with nulls, mean null percent, columns above ``high`` percent."""
    high_names = F.sort_array(F.collect_list(F.when(F.col("null_percent") > high, F.col("column"))))
    return profile.agg(
        F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
        F.round(F.avg("null_percent"), 2).alias("avg_null_percent"),
        F.array_join(high_names, ",").alias("high_null_columns"),
    )


def null_share(df: DataFrame) -> DataFrame:
    """One row: rows, columns, null cells and their percent; an empty table counts as all null."""
    rows = F.count("*")
    nulls = reduce(add, _null_counts(df))
    cells = rows * F.lit(len(df.columns))
    return df.agg(
        rows.alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        nulls.alias("null_cells"),
        F.coalesce(percent(nulls, cells), F.lit(100.0)).alias("null_percent"),
    )


def id_columns(columns: list[str], table: str) -> list[str]:
    """Key columns of a known table, else the first three whose name looks like a key."""
    if table in presets.ID_COLUMNS:
        return [c for c in presets.ID_COLUMNS[table] if c in columns]
    return [c for c in columns if any(p in c for p in presets.ID_PATTERNS)][:3]


def duplicate_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys (null is a value), surplus rows and their percent."""
    rows = F.count("*")
    distinct = F.count_distinct(F.struct(*[quoted(k) for k in keys])) if keys else rows
    return df.agg(
        rows.alias("rows"),
        distinct.alias("distinct_keys"),
        (rows - distinct).alias("duplicate_count"),
        F.coalesce(percent(rows - distinct, rows), F.lit(0.0)).alias("duplicate_percent"),
    )


# --- scores ---------------------------------------------------------------------------


def _penalised(pct: Column, weight: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100.0) - pct * F.lit(weight))


def quality_score(null_pct: Column, dup_pct: Column) -> Column:
    return F.round(_penalised(null_pct, 2) * 0.6 + _penalised(dup_pct, 5) * 0.4, 1)


def wide_table_score(null_pct: Column, dup_pct: Column, provinces: Column, features: Column) -> Column:
    def capped(value: Column, weight: float) -> Column:
        return F.least(F.lit(100.0), value * F.lit(float(weight)))

    return F.round(
        _penalised(null_pct, 2) * 0.3
        + _penalised(dup_pct, 5) * 0.4
        + capped(provinces, 4) * 0.2
        + capped(features, 2) * 0.1,
        1,
    )


def table_quality(df: DataFrame, table: str) -> DataFrame:
    """One row: rows, columns, mean null percent, duplicate percent, score and validity."""
    keys = id_columns(df.columns, table)
    rows = F.count("*")
    share = [F.coalesce(F.round(percent(n, rows), 2), F.lit(0.0)) for n in _null_counts(df)]
    distinct = F.count_distinct(F.struct(*[quoted(k) for k in keys])) if keys else rows
    out = df.agg(
        F.lit(table).alias("table_name"),
        rows.alias("total_records"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.round(reduce(add, share) / F.lit(len(share)), 2).alias("avg_null_percent"),
        F.coalesce(F.round(percent(rows - distinct, rows), 2), F.lit(0.0)).alias("duplicate_percent"),
    )
    score = F.when(F.col("total_records") == 0, F.lit(0.0)).otherwise(
        quality_score(F.col("avg_null_percent"), F.col("duplicate_percent"))
    )
    return out.withColumn("quality_score", score).withColumn(
        "is_valid", F.col("quality_score") >= presets.QUALITY_VALID_SCORE
    )


# --- schema -----------------------------------------------------------------------------


def _known_counts(df: DataFrame, names: Iterable[str]) -> Column:
    """Map from each present name to its number of known values, as one aggregate."""
    items = [x for c in present(df, names) for x in (F.lit(c), F.count(quoted(c)))]
    return F.create_map(*items) if items else F.create_map().cast("map<string,bigint>")


def schema_compliance(df: DataFrame, expected: list[str]) -> DataFrame:
    """One row: expected columns present, missing and extra ones, rows that fill all present ones."""
    have, want = set(df.columns), list(dict.fromkeys(expected))
    matching = [c for c in want if c in have]
    missing = sorted(set(want) - have)
    share = 100.0 * len(matching) / len(want) if want else 100.0
    filled = reduce(lambda a, c: a & F.col(quoted(c)).isNotNull(), matching, F.lit(True))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(filled).alias("complete_rows"),
        F.lit(not missing).alias("is_compliant"),
        F.round(F.lit(share), 1).alias("compliance_percent"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(",".join(sorted(have - set(want)))).alias("extra_columns"),
        F.lit(len(matching)).alias("matching_columns"),
    )


def type_check(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per expected column: its types, whether they agree, and its known values."""
    actual = dict(df.dtypes)
    counts = df.agg(_known_counts(df, expected).alias("known"))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("expected"),
            F.lit(actual.get(c)).cast("string").alias("actual"),
            F.lit(c not in actual or actual[c] == t).alias("type_ok"),
            F.try_element_at("known", F.lit(c)).alias("known_values"),
        )
        for c, t in expected.items()
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def structure_check(df: DataFrame, schema: presets.TableSchema) -> DataFrame:
    """One row: missing required and key columns, extra columns, score, rows with a whole key."""
    have = set(df.columns)
    lost = [c for c in schema.required if c not in have]
    lost_keys = [c for c in schema.keys if c not in have]
    extra = sorted(have - set(schema.required) - set(schema.optional))
    expected = len(schema.required) + len(schema.keys)
    score = 100.0 * (expected - len(lost) - len(lost_keys)) / expected if expected else 100.0
    keyed = reduce(
        lambda a, c: a & F.col(quoted(c)).isNotNull(), present(df, schema.keys), F.lit(not lost_keys)
    )
    return df.agg(
        F.lit(schema.name).alias("table_name"),
        F.count("*").alias("rows"),
        F.count_if(keyed).alias("keyed_rows"),
        F.lit(not lost and not lost_keys).alias("is_valid"),
        F.lit(",".join(sorted(lost))).alias("missing_required"),
        F.lit(",".join(sorted(lost_keys))).alias("missing_keys"),
        F.lit(",".join(extra)).alias("extra_columns"),
        F.lit(score).alias("compliance_score"),
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per data type: number of columns, their names and their known values."""
    counts = df.agg(_known_counts(df, df.columns).alias("known"))
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("data_type"),
            F.try_element_at("known", F.lit(c)).alias("known_values"),
        )
        for c, t in df.dtypes
    ]
    return (
        counts.select(F.explode(F.array(*rows)).alias("r"))
        .groupBy(F.col("r.data_type").alias("data_type"))
        .agg(
            F.count("*").alias("columns"),
            F.array_join(F.sort_array(F.collect_list("r.column")), ",").alias("names"),
            F.sum("r.known_values").alias("known_values"),
        )
    )


def table_metadata(df: DataFrame, table: str) -> DataFrame:
    """One row per column: table size, type, nulls and the time of the profile."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return null_profile(df).select(
        F.lit(table).alias("table_name"),
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "column",
        types[F.col("column")].alias("data_type"),
        "null_count",
        "null_percent",
        F.current_timestamp().alias("profiled_at"),
    )


# --- domains, thresholds, skew ---------------------------------------------------------


def domain_coverage(
    df: DataFrame,
    code: str,
    domain: list[str] = presets.PROVINCE_CODES,
    least: int = presets.MIN_PROVINCES,
) -> DataFrame:
    """One row: expected codes observed, their percent, the missing ones, and adequacy."""
    value = as_code(code)
    seen = df.filter(value.isin(domain)).agg(F.collect_set(value).alias("seen"))  # within the domain
    missing = F.array_except(F.array(*[F.lit(d) for d in domain]), F.col("seen"))
    covered = F.size("seen")
    return seen.select(
        covered.alias("covered"),
        F.lit(len(domain)).alias("expected"),
        F.round(covered * 100.0 / F.lit(len(domain)), 1).alias("coverage_percent"),
        F.array_join(F.sort_array(missing), ",").alias("missing"),
        (covered >= least).alias("adequate"),
    )


def domain_difference(observed: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """Values of either side with the side they are on: both, observed only, domain only."""
    sides = (
        observed.select(quoted(key))
        .distinct()
        .withColumn("__o", F.lit(1))
        .join(domain.select(quoted(key)).distinct().withColumn("__d", F.lit(1)), [key], "full")
    )
    status = (
        F.when(F.col("__o").isNull(), "domain_only").when(F.col("__d").isNull(), "observed_only").otherwise("both")
    )
    return sides.select(quoted(key), status.alias("status"))


def threshold_check(
    metrics: DataFrame,
    profile: str | None = None,
    null: str = "null_share",
    rows: str = "rows",
    duplicate: str = "duplicate_share",
) -> DataFrame:
    """Add one flag per rule. Shares are fractions."""
    limits = presets.QUALITY_LIMITS | presets.QUALITY_PROFILES.get(profile or "", {})
    return metrics.withColumns(
        {
            "null_percentage_ok": F.coalesce(F.col(null), F.lit(0.0)) <= limits["max_null"],
            "record_count_ok": F.coalesce(F.col(rows), F.lit(0)) >= limits["min_rows"],
            "duplicate_percentage_ok": F.coalesce(F.col(duplicate), F.lit(0.0)) <= limits["max_duplicate"],
        }
    )


def skew_report(df: DataFrame, key: str, limit: float = 3.0) -> DataFrame:
    """One row: groups, rows, mean, largest and smallest group, their ratio."""
    sizes = df.groupBy(F.col(quoted(key))).agg(F.count("*").alias("n"))
    ratio = F.try_divide(F.max("n").cast("double"), F.min("n"))
    return sizes.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.avg("n").alias("mean_size"),
        F.max("n").alias("max_size"),
        F.min("n").alias("min_size"),
        ratio.alias("skew_ratio"),
        (ratio > limit).alias("is_skewed"),
    )


# --- table checks -------------------------------------------------------------------------


def _checks(df: DataFrame, table: str, checks: Mapping[str, Column]) -> DataFrame:
    """One row per named check of a table, all evaluated in one aggregate."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    named = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("passed")) for n in checks]
    return row.select(F.explode(F.array(*named)).alias("c")).select(F.lit(table).alias("table_name"), "c.*")


def _has(df: DataFrame, *names: str) -> Column:
    return F.lit(all(n in df.columns for n in names))


def person_checks(df: DataFrame, table: str = "poblacion", age: str = "P03") -> DataFrame:
    ages = as_double(age) if age in df.columns else None
    return _checks(
        df,
        table,
        {
            "record_count_valid": F.count("*") > 1000,
            "required_columns_present": _has(df, "ID_VIV", "ID_HOG", "ID_PER"),
            "age_values_reasonable": F.lit(True) if ages is None else (F.min(ages) >= 0) & (F.max(ages) <= 120),
            "geographic_coverage_adequate": F.lit(True),
        },
    )


def household_checks(df: DataFrame, table: str = "hogar", size: str = "H1303") -> DataFrame:
    return _checks(
        df,
        table,
        {
            "record_count_valid": F.count("*") > 500,
            "required_columns_present": _has(df, "ID_VIV", "ID_HOG"),
            "household_size_reasonable": F.max(as_double(size)) <= 20 if size in df.columns else F.lit(True),
        },
    )


def dwelling_checks(df: DataFrame, table: str = "vivienda", kind: str = "V01") -> DataFrame:
    types = F.count_distinct(F.struct(quoted(kind))) if kind in df.columns else None
    return _checks(
        df,
        table,
        {
            "record_count_valid": F.count("*") > 500,
            "required_columns_present": _has(df, "ID_VIV"),
            "housing_types_valid": F.lit(True) if types is None else (types > 0) & (types < 50),
        },
    )


def census_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    makers = {"poblacion": person_checks, "hogar": household_checks, "vivienda": dwelling_checks}
    parts = [make(tables[t]) for t, make in makers.items() if t in tables]
    if not parts:
        raise ValueError("no census table to check")
    return reduce(DataFrame.unionByName, parts)


def overall_score(checks: DataFrame) -> DataFrame:
    """One row: checks, passed checks, passed percent (1 decimal); no checks score 0."""
    passed = F.count_if("passed")
    return checks.agg(
        F.count("*").alias("checks"),
        passed.alias("passed"),
        F.coalesce(F.round(percent(passed, F.count("*")), 1), F.lit(0.0)).alias("overall_quality_score"),
    )


# --- wide tables ----------------------------------------------------------------------------


def wide_table_metrics(
    df: DataFrame, table: str, keys: list[str] | None = None, province: str | None = None
) -> DataFrame:
    """One row of integrity metrics of a wide table.

    The nulls of a row are added up before they are aggregated; distinct keys and provinces
    are counted in passes that read their own columns only. ``keys`` and ``province`` name the
    columns to check; by default those of a wide table, else those of its source table.
    """
    census = "censo" in table.lower() or table in presets.REQUIRED_TABLES
    default = presets.ID_COLUMNS["poblacion" if census else "enemdu_personas"]
    keys = present(df, keys) if keys else present(df, presets.WIDE_TABLE_KEYS) or present(df, default)
    province = province or first_present(df, [*presets.WIDE_TABLE_PROVINCE, *presets.PROVINCE_COVERAGE_COLUMNS])
    features = starting(df.columns, presets.FEATURE_NAME_PREFIXES)
    targets = starting(df.columns, ["target_"])
    empty = reduce(add, [F.col(quoted(c)).isNull().cast("long") for c in df.columns])
    passes = [df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(empty), F.lit(0)).alias("nulls"))]
    for name, chosen in (("keys", keys), ("provinces", [province] if province else [])):
        if chosen:
            passes.append(df.select(*map(quoted, chosen)).distinct().agg(F.count("*").alias(name)))
    counts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), passes)
    rows, nulls = F.max("rows"), F.max("nulls")
    distinct = F.max("keys") if keys else rows
    provinces = F.max("provinces") if province else F.lit(0).cast("long")
    out = counts.agg(
        F.lit(table).alias("table_name"),
        rows.alias("record_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.coalesce(percent(nulls, rows * F.lit(len(df.columns))), F.lit(100.0)).alias("null_percentage"),
        F.coalesce(percent(rows - distinct, rows), F.lit(0.0)).alias("duplicate_percentage"),
        provinces.alias("geographic_coverage"),
        F.lit(len(features)).alias("feature_count"),
        F.lit(",".join(targets)).alias("target_variables"),
    )
    return out.withColumn(
        "data_quality_score",
        wide_table_score(
            F.col("null_percentage"),
            F.col("duplicate_percentage"),
            F.col("geographic_coverage"),
            F.col("feature_count"),
        ),
    )


def all_wide_table_metrics(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [wide_table_metrics(df, name) for name, df in tables.items()])


def load_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: kind, rows, columns."""

    def one(name: str, df: DataFrame) -> DataFrame:
        kind = "dictionary" if name.startswith(presets.DICTIONARY_PREFIX) else "data"
        return df.agg(
            F.lit(name).alias("table_name"),
            F.lit(kind).alias("kind"),
            F.count("*").alias("rows"),
            F.lit(len(df.columns)).alias("columns"),
        )

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def load_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(
        F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.sum("columns").alias("columns")
    )
