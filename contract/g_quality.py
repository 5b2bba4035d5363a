"""Data-quality profiles, checks and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import GEO_LOOKUP, PERSON_RULES, SOURCES, dictionaries, sub, view, views
from contract.registry import query, table
from tallyweave import presets
from tallyweave.operators import geo, quality
from tallyweave.operators.bounded import size_estimate
from tallyweave.operators.features import age_features, sex_features

PERSON_COLUMNS = [i.rsplit(" AS ", 1)[1] for i in SOURCES["poblacion"][1]]


def _nulls(c: str) -> str:
    return f"count(*) FILTER ({c} IS NULL)"


@query(
    "g01_null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, {_nulls(c)} AS null_count, "
        f"round({_nulls(c)} * 100.0::DOUBLE / count(*), 2) AS null_percent FROM {sub('poblacion')}"
        for c in PERSON_COLUMNS
    ),
)
def g01(spark, sf):
    return quality.null_profile(view(spark, sf, "poblacion"))


def _mean_null_sql(columns: list[str]) -> str:
    parts = " + ".join(f"round({_nulls(c)} * 100.0::DOUBLE / count(*), 2)" for c in columns)
    return f"round(({parts}) / {len(columns)}, 2)"


@query(
    "g01_null_summary",
    f"SELECT {' + '.join(f'CASE WHEN {_nulls(c)} > 0 THEN 1 ELSE 0 END' for c in PERSON_COLUMNS)} AS columns_with_nulls, "
    f"{_mean_null_sql(PERSON_COLUMNS)} AS avg_null_percent, '' AS high_null_columns FROM {sub('poblacion')}",
)
def g01b(spark, sf):
    return quality.null_summary(quality.null_profile(view(spark, sf, "poblacion")))


@query(
    "g02_null_cells",
    f"SELECT count(*) AS rows, {len(PERSON_COLUMNS)} AS columns, {' + '.join(_nulls(c) for c in PERSON_COLUMNS)} AS null_cells, "
    f"({' + '.join(_nulls(c) for c in PERSON_COLUMNS)}) * 100.0::DOUBLE / (count(*) * {len(PERSON_COLUMNS)}) AS null_percent "
    f"FROM {sub('poblacion')}",
)
def g02(spark, sf):
    return quality.null_share(view(spark, sf, "poblacion"))


KEYS = "count(DISTINCT (ID_VIV, ID_HOG, ID_PER))"


@query(
    "g03_duplicate_profile",
    f"SELECT count(*) AS rows, {KEYS} AS distinct_keys, count(*) - {KEYS} AS duplicate_count, "
    f"(count(*) - {KEYS}) * 100.0::DOUBLE / count(*) AS duplicate_percent FROM {sub('poblacion')}",
)
def g03(spark, sf):
    df = view(spark, sf, "poblacion")
    return quality.duplicate_profile(df, quality.id_columns(df.columns, "poblacion"))


@query(
    "g04_id_columns",
    f"SELECT count(*) AS rows, count(DISTINCT (id_vivienda, id_hogar, id_persona)) AS distinct_keys FROM {sub('enemdu_personas')}",
)
def g04(spark, sf):
    """Keys found by the look of the column names, as for a table no preset knows."""
    df = view(spark, sf, "enemdu_personas")
    return quality.duplicate_profile(df, quality.id_columns(df.columns, "otra")).select("rows", "distinct_keys")


@query(
    "g05_quality_score",
    f"""SELECT 'poblacion' AS table_name, rows AS total_records, {len(PERSON_COLUMNS)} AS total_columns,
    n AS avg_null_percent, d AS duplicate_percent,
    round(greatest(0, 100 - n * 2) * 0.6::DOUBLE + greatest(0, 100 - d * 5) * 0.4::DOUBLE, 1) AS quality_score,
    round(greatest(0, 100 - n * 2) * 0.6::DOUBLE + greatest(0, 100 - d * 5) * 0.4::DOUBLE, 1) >= 70 AS is_valid
    FROM (SELECT count(*) AS rows, {_mean_null_sql(PERSON_COLUMNS)} AS n,
          round((count(*) - {KEYS}) * 100.0::DOUBLE / count(*), 2) AS d FROM {sub('poblacion')})""",
)
def g05(spark, sf):
    return quality.table_quality(view(spark, sf, "poblacion"), "poblacion")


@query(
    "g06_schema_compliance",
    f"""SELECT count(*) AS rows, count(*) FILTER (I01 IS NOT NULL AND I02 IS NOT NULL AND P02 IS NOT NULL AND P03 IS NOT NULL)
    AS complete_rows, false AS is_compliant, 80.0::DOUBLE AS compliance_percent, 'ESCOLA' AS missing_columns,
    'AUR,CANTON,ID_HOG,ID_PER,ID_VIV,nivel_instruccion,ocupacion,parentesco,registro_a,registro_b' AS extra_columns,
    4 AS matching_columns FROM {sub('poblacion')}""",
)
def g06(spark, sf):
    return quality.schema_compliance(view(spark, sf, "poblacion"), ["I01", "I02", "P02", "P03", "ESCOLA"])


@query(
    "g07_domain_coverage",
    f"""WITH seen AS (SELECT DISTINCT lpad(I01, 2, '0') AS c FROM {sub('poblacion')}),
    domain AS (SELECT lpad(i::VARCHAR, 2, '0') AS c FROM range(1, 25) t(i))
    SELECT count(s.c)::INT AS covered, 24 AS expected, round(count(s.c) * 100.0::DOUBLE / 24, 1) AS coverage_percent,
    coalesce(string_agg(CASE WHEN s.c IS NULL THEN d.c END, ',' ORDER BY d.c), '') AS missing, count(s.c) >= 20 AS adequate
    FROM domain d LEFT JOIN seen s ON d.c = s.c""",
)
def g07(spark, sf):
    return quality.domain_coverage(geo.homologated_table(view(spark, sf, "poblacion"), "poblacion"), "codigo_provincia_2d_homo")


@query(
    "g08_type_check",
    "SELECT 'o_orderkey' AS \"column\", 'bigint' AS expected, 'bigint' AS actual, true AS type_ok, count(o_orderkey) AS known_values FROM orders "
    "UNION ALL SELECT 'o_totalprice', 'string', 'double', false, count(o_totalprice) FROM orders "
    "UNION ALL SELECT 'o_orderstatus', 'string', 'string', true, count(o_orderstatus) FROM orders "
    "UNION ALL SELECT 'no_existe', 'int', NULL, true, NULL",
)
def g08(spark, sf):
    expected = {"o_orderkey": "bigint", "o_totalprice": "string", "o_orderstatus": "string", "no_existe": "int"}
    return quality.type_check(table(spark, sf, "orders"), expected)


@query(
    "g09_structure_check",
    f"SELECT 'vivienda' AS table_name, count(*) AS rows, count(ID_VIV) AS keyed_rows, true AS is_valid, '' AS missing_required, "
    f"'' AS missing_keys, 'CANTON,I01,ID_VIV,tipo_techo' AS extra_columns, 100.0::DOUBLE AS compliance_score FROM {sub('vivienda')} "
    f"UNION ALL SELECT 'hogar', count(*), count(*), false, 'H01,H1303', '', 'AUR,ID_HOG,ID_VIV', 50.0 FROM {sub('poblacion')}",
)
def g09(spark, sf):
    persons = view(spark, sf, "poblacion").select("ID_VIV", "ID_HOG", "AUR")
    lacking = quality.structure_check(persons, presets.SCHEMAS["hogar"])
    return quality.structure_check(view(spark, sf, "vivienda"), presets.SCHEMAS["vivienda"]).unionByName(lacking)


@query(
    "g10_threshold_rules",
    f"""SELECT I01, rows, null_share, duplicate_share, null_share <= 0.05 AS null_percentage_ok, rows >= 1000 AS record_count_ok,
    duplicate_share <= 0.01 AS duplicate_percentage_ok FROM
    (SELECT I01, count(*) AS rows, count(*) FILTER (P03 IS NULL)::DOUBLE / count(*) AS null_share,
    (count(*) - {KEYS})::DOUBLE / count(*) AS duplicate_share FROM {sub('poblacion')} GROUP BY 1)""",
)
def g10(spark, sf):
    rows = F.count("*")
    distinct = F.count_distinct(F.struct("ID_VIV", "ID_HOG", "ID_PER"))
    metrics = (
        view(spark, sf, "poblacion")
        .groupBy("I01")
        .agg(
            rows.alias("rows"),
            (F.count_if(F.col("P03").isNull()) / rows).alias("null_share"),
            ((rows - distinct) / rows).alias("duplicate_share"),
        )
    )
    return quality.threshold_check(metrics)


@query(
    "g11_schema_profile",
    "SELECT 'bigint' AS data_type, 2 AS columns, 'o_custkey,o_orderkey' AS names, count(*) * 2 AS known_values FROM orders "
    "UNION ALL SELECT 'double', 1, 'o_totalprice', count(*) FROM orders "
    "UNION ALL SELECT 'string', 2, 'o_orderpriority,o_orderstatus', count(*) * 2 FROM orders "
    "UNION ALL SELECT 'timestamp_ntz', 1, 'o_orderdate', count(*) FROM orders",
)
def g11(spark, sf):
    return quality.schema_profile(table(spark, sf, "orders"))


@query("g12_table_metadata")
def g12(spark, sf):
    return quality.table_metadata(view(spark, sf, "poblacion"), "poblacion")


CHECK = "SELECT '{t}' AS table_name, '{n}' AS check_name, {e} AS passed FROM {s}"


def _checks_sql(table_name: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(
        CHECK.format(t=table_name, n=n, e=e, s=sub(table_name)) for n, e in checks.items()
    )


PERSON_CHECKS = _checks_sql(
    "poblacion",
    {
        "record_count_valid": "count(*) > 1000",
        "required_columns_present": "count(*) >= 0",
        "age_values_reasonable": "min(TRY_CAST(P03 AS DOUBLE)) >= 0 AND max(TRY_CAST(P03 AS DOUBLE)) <= 120",
        "geographic_coverage_adequate": "count(*) >= 0",
    },
)
HOUSEHOLD_CHECKS = _checks_sql(
    "hogar",
    {
        "record_count_valid": "count(*) > 500",
        "required_columns_present": "count(*) >= 0",
        "household_size_reasonable": "max(TRY_CAST(H1303 AS DOUBLE)) <= 20",
    },
)
DWELLING_CHECKS = _checks_sql(
    "vivienda",
    {
        "record_count_valid": "count(*) > 500",
        "required_columns_present": "count(*) >= 0",
        "housing_types_valid": "count(DISTINCT V01) BETWEEN 1 AND 49",
    },
)


@query("g13_person_checks", PERSON_CHECKS)
def g13(spark, sf):
    return quality.person_checks(view(spark, sf, "poblacion"))


@query("g14_household_checks", HOUSEHOLD_CHECKS)
def g14(spark, sf):
    return quality.household_checks(view(spark, sf, "hogar"))


@query("g15_dwelling_checks", DWELLING_CHECKS)
def g15(spark, sf):
    return quality.dwelling_checks(view(spark, sf, "vivienda"))


@query(
    "g16_overall_score",
    f"""SELECT count(*) AS checks, count(*) FILTER (passed) AS passed,
    round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 1) AS overall_quality_score
    FROM ({PERSON_CHECKS} UNION ALL {HOUSEHOLD_CHECKS} UNION ALL {DWELLING_CHECKS})""",
)
def g16(spark, sf):
    return quality.overall_score(quality.census_checks(views(spark, sf, ["poblacion", "hogar", "vivienda"])))


WIDE_COLUMNS = [*PERSON_COLUMNS, *"grupo_edad_detallado grupo_edad_economico es_dependiente_demografico "
                "es_poblacion_activa sexo_descripcion es_mujer es_hombre".split()]  # fmt: skip
WIDE_SQL = f"""SELECT 'censo_master' AS table_name, count(*) AS record_count, {len(WIDE_COLUMNS)} AS column_count,
    ({' + '.join(_nulls(c) for c in WIDE_COLUMNS)}) * 100.0::DOUBLE / (count(*) * {len(WIDE_COLUMNS)}) AS null_percentage,
    (count(*) - {KEYS}) * 100.0::DOUBLE / count(*) AS duplicate_percentage, count(DISTINCT I01) AS geographic_coverage,
    6 AS feature_count, '' AS target_variables FROM {PERSON_RULES}"""


def _wide(spark, sf):
    return sex_features(age_features(view(spark, sf, "poblacion")))


@query("g17_wide_table_metrics", WIDE_SQL)
def g17(spark, sf):
    return quality.wide_table_metrics(_wide(spark, sf), "censo_master").drop("data_quality_score")


@query(
    "g18_wide_table_score",
    f"""SELECT table_name, round(greatest(0, 100 - null_percentage * 2) * 0.3::DOUBLE + greatest(0, 100 - duplicate_percentage * 5) * 0.4::DOUBLE
    + least(100, geographic_coverage * 4) * 0.2::DOUBLE + least(100, feature_count * 2) * 0.1::DOUBLE, 1) AS data_quality_score
    FROM ({WIDE_SQL})""",
)
def g18(spark, sf):
    return quality.wide_table_metrics(_wide(spark, sf), "censo_master").select("table_name", "data_quality_score")


@query(
    "g19_lookup_uniqueness",
    f'SELECT count(*) AS rows, count(DISTINCT codigo_parroquia_6d) AS distinct_keys, '
    f'count(*) = count(DISTINCT codigo_parroquia_6d) AS "unique" FROM {GEO_LOOKUP}',
)
def g19(spark, sf):
    return geo.lookup_uniqueness(geo.geographic_lookup(dictionaries(spark, sf)))


@query(
    "g20_skew_report",
    """SELECT count(*) AS groups, sum(n)::BIGINT AS rows, avg(n) AS mean_size, max(n) AS max_size, min(n) AS min_size,
    max(n)::DOUBLE / min(n) AS skew_ratio, max(n)::DOUBLE / min(n) > 3 AS is_skewed
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def g20(spark, sf):
    return quality.skew_report(table(spark, sf, "lineitem"), "l_orderkey")


@query(
    "g21_size_estimate",
    "SELECT count(*) AS rows, 2 AS columns, count(*) * 100 / 1048576.0::DOUBLE AS estimated_mb, "
    "(sum(8 + strlen(text) + 8))::BIGINT / 1048576.0::DOUBLE AS measured_mb FROM documents",
)
def g21(spark, sf):
    return size_estimate(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "g22_load_report",
    "SELECT 'data' AS kind, 2 AS tables, (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) AS rows, 19 AS columns "
    "UNION ALL SELECT 'dictionary', 1, (SELECT count(*) FROM nation), 2",
)
def g22(spark, sf):
    return quality.load_totals(quality.load_report(views(spark, sf, ["poblacion", "hogar", "dict_provincia"])))
