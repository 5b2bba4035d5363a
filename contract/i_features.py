"""Row-level demographic rules, indices and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import PERSON_RULES, age_rules, rx, sub, view
from contract.registry import query
from tallyweave.operators import features, geo

ID = ["ID_HOG", "ID_PER"]


def _persons(spark, sf):
    return view(spark, sf, "poblacion")


def _rules(spark, sf):
    df = _persons(spark, sf)
    source = df.columns
    out = features.education_features(features.sex_features(features.age_features(df)), source)
    out = features.vulnerability_index(geo.with_urban_flag(out), source)
    return features.development_index(out), source


def _register(key: str, make, columns: list[str], source: str = PERSON_RULES, keys: list[str] = ID) -> None:
    names = [*keys, *columns]
    query(key, f"SELECT {', '.join(names)} FROM {source}")(lambda spark, sf: make(spark, sf).select(*names))


def _aged(spark, sf):
    return features.age_features(_persons(spark, sf))


def _sexed(spark, sf):
    return features.sex_features(_persons(spark, sf))


def _educated(spark, sf):
    return features.education_features(_persons(spark, sf))


_register("i01_age_detail", _aged, ["P03", "grupo_edad_detallado"])
_register("i02_age_economic", _aged, ["P03", "grupo_edad_economico"])
_register("i03_dependant", _aged, ["P03", "es_dependiente_demografico"])
_register("i04_working_age", _aged, ["P03", "es_poblacion_activa"])
_register("i05_sex_label", _sexed, ["P02", "sexo_descripcion"])
_register("i06_sex_flags", _sexed, ["P02", "es_mujer", "es_hombre"])
_register("i07_higher_education", _educated, ["nivel_instruccion", "tiene_educacion_superior"])
_register("i08_basic_education", _educated, ["nivel_instruccion", "completo_educacion_basica"])
_register("i09_education_level", _educated, ["nivel_instruccion", "nivel_educativo_numerico"])
_register("i10_vulnerability_index", lambda s, d: _rules(s, d)[0], ["indice_vulnerabilidad_compuesto"])
_register("i11_vulnerability_category", lambda s, d: _rules(s, d)[0], ["categoria_vulnerabilidad"])
_register("i12_development_index", lambda s, d: _rules(s, d)[0], ["indice_desarrollo_compuesto"])
_register("i13_development_category", lambda s, d: _rules(s, d)[0], ["categoria_desarrollo"])

CENSUS_TARGETS = f"""(SELECT *, CASE WHEN categoria_vulnerabilidad = 'ALTA' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_vulnerabilidad_alta,
    tiene_educacion_superior::DOUBLE AS target_educacion_superior,
    CASE WHEN {rx('parentesco', 'jefe|representante')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_jefe_hogar,
    es_urbano::DOUBLE AS target_area_urbana FROM {PERSON_RULES})"""


def _census_targets(spark, sf):
    out, source = _rules(spark, sf)
    return features.census_targets(out, source)


_register("i14_target_vulnerability", _census_targets, ["target_vulnerabilidad_alta"], CENSUS_TARGETS)
_register("i15_target_higher_education", _census_targets, ["target_educacion_superior"], CENSUS_TARGETS)
_register("i16_target_household_head", _census_targets, ["parentesco", "target_jefe_hogar"], CENSUS_TARGETS)
_register("i17_target_urban", _census_targets, ["target_area_urbana"], CENSUS_TARGETS)

SURVEY_TARGETS = f"""(SELECT *, CASE WHEN {rx('ocupacion', 'empleado|asalariado')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_empleo_formal,
    CASE WHEN TRY_CAST(ingrl AS DOUBLE) >= 400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_ingresos_suficientes,
    CASE WHEN area = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_area_urbana_enemdu FROM {sub('enemdu_personas')})"""


def _survey_targets(spark, sf):
    df = view(spark, sf, "enemdu_personas")
    return features.survey_targets(geo.with_urban_flag(df), df.columns)


SURVEY_ID = ["id_persona"]
_register("i17_target_urban_survey", _survey_targets, ["area", "target_area_urbana_enemdu"], SURVEY_TARGETS, SURVEY_ID)
_register("i18_target_formal_employment", _survey_targets, ["ocupacion", "target_empleo_formal"], SURVEY_TARGETS, SURVEY_ID)
_register("i19_target_income", _survey_targets, ["ingrl", "target_ingresos_suficientes"], SURVEY_TARGETS, SURVEY_ID)

AGE = "TRY_CAST(P03 AS INT)"
BANDS_SQL = f"""(SELECT ID_HOG, ID_PER, P03, CASE WHEN {AGE} < 0 THEN NULL WHEN {AGE} < 15 THEN 'MENOR_15' WHEN {AGE} < 25 THEN 'JOVEN_15_24'
    WHEN {AGE} < 35 THEN 'ADULTO_25_34' WHEN {AGE} < 50 THEN 'ADULTO_35_49' WHEN {AGE} < 65 THEN 'ADULTO_50_64'
    WHEN {AGE} < 120 THEN 'ADULTO_MAYOR_65' END AS banda_edad,
    CASE WHEN {AGE} BETWEEN 15 AND 64 THEN 1 ELSE 0 END AS en_edad_activa FROM {sub('poblacion')})"""
INCOME = "TRY_CAST(ingrl AS DOUBLE)"
INCOME_SQL = f"""(SELECT id_persona, ingrl, CASE WHEN {INCOME} IS NULL THEN NULL WHEN {INCOME} < 400 THEN 'bajo' WHEN {INCOME} < 800 THEN 'medio'
    WHEN {INCOME} < 1500 THEN 'alto' ELSE 'superior' END AS nivel_ingreso FROM {sub('enemdu_personas')})"""

_register("i20_age_bands", lambda s, d: features.age_bands(_persons(s, d)), ["P03", "banda_edad", "en_edad_activa"], BANDS_SQL)
_register(
    "i20_income_bands",
    lambda s, d: features.income_bands(view(s, d, "enemdu_personas")),
    ["ingrl", "nivel_ingreso"],
    INCOME_SQL,
    SURVEY_ID,
)

TIES = ["ID_HOG", "ID_PER", "registro_a", "registro_b"]
PERSON_FEATURES_SQL = f"""
SELECT *, CASE WHEN categoria_vulnerabilidad = 'ALTA' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target_vulnerabilidad_alta
FROM (SELECT *, n AS poblacion_total_provincia_censo, dense_rank() OVER (ORDER BY n DESC)::INT AS ranking_provincial_censo,
    ntile(100) OVER (ORDER BY n DESC, I01, {', '.join(TIES)})::INT AS percentil_poblacional_censo,
    count(*) OVER (PARTITION BY ID_VIV, ID_HOG) AS "tamaño_hogar_calculado",
    avg(TRY_CAST(P03 AS DOUBLE)) OVER (PARTITION BY ID_VIV, ID_HOG) AS edad_promedio_hogar
  FROM (SELECT *, count(*) OVER (PARTITION BY I01) AS n FROM {PERSON_RULES}))"""
PERSON_OUT = [
    *TIES, "grupo_edad_detallado", "sexo_descripcion", "nivel_educativo_numerico", "poblacion_total_provincia_censo",
    "ranking_provincial_censo", "percentil_poblacional_censo", "edad_promedio_hogar", "categoria_vulnerabilidad",
    "categoria_desarrollo", "target_vulnerabilidad_alta",
]


@query(
    "i21_person_features",
    f'SELECT {", ".join(PERSON_OUT)}, "tamaño_hogar_calculado" FROM ({PERSON_FEATURES_SQL})',
)
def i21(spark, sf):
    out = features.all_features({"poblacion": geo.with_urban_flag(_persons(spark, sf))}, tie_break=TIES)["poblacion"]
    return out.select(*PERSON_OUT, "tamaño_hogar_calculado")


@query(
    "i21_survey_features",
    f"""SELECT id_persona, {age_rules('TRY_CAST(p03 AS INT)')}, target_empleo_formal, target_ingresos_suficientes,
    target_area_urbana_enemdu FROM {SURVEY_TARGETS}""",
)
def i21b(spark, sf):
    df = geo.with_urban_flag(view(spark, sf, "enemdu_personas"))
    out = features.all_features({"enemdu_personas": df}, age="p03", sex="p02")["enemdu_personas"]
    return out.select(
        "id_persona", "grupo_edad_detallado", "grupo_edad_economico", "es_dependiente_demografico", "es_poblacion_activa",
        "target_empleo_formal", "target_ingresos_suficientes", "target_area_urbana_enemdu",
    )


# feature, type, named sources, columns of the table it is made from in the end
CATALOG = [
    ("grupo_edad_detallado", "demographic", "P03", "P03"),
    ("grupo_edad_economico", "demographic", "P03", "P03"),
    ("es_dependiente_demografico", "demographic", "P03", "P03"),
    ("es_poblacion_activa", "demographic", "P03", "P03"),
    ("sexo_descripcion", "demographic", "P02", "P02"),
    ("es_mujer", "demographic", "P02", "P02"),
    ("es_hombre", "demographic", "P02", "P02"),
    ("tiene_educacion_superior", "demographic", "educacion", "nivel_instruccion"),
    ("completo_educacion_basica", "demographic", "educacion", "nivel_instruccion"),
    ("nivel_educativo_numerico", "demographic", "educacion", "nivel_instruccion"),
    ("es_urbano", "geographic", "AUR", "AUR"),
    (
        "indice_vulnerabilidad_compuesto", "composite_index", "es_dependiente_demografico,tiene_educacion_superior",
        "P03,nivel_instruccion,ocupacion",
    ),
    ("categoria_vulnerabilidad", "composite_index", "indice_vulnerabilidad_compuesto", "P03,nivel_instruccion,ocupacion"),
    (
        "indice_desarrollo_compuesto", "composite_index", "nivel_educativo_numerico,es_poblacion_activa,es_urbano",
        "P03,AUR,nivel_instruccion",
    ),
    ("categoria_desarrollo", "composite_index", "indice_desarrollo_compuesto", "P03,AUR,nivel_instruccion"),
    ("target_vulnerabilidad_alta", "target_variable", "categoria_vulnerabilidad", "P03,nivel_instruccion,ocupacion"),
    ("target_educacion_superior", "target_variable", "tiene_educacion_superior", "nivel_instruccion"),
    ("target_jefe_hogar", "target_variable", "parentesco", "parentesco"),
    ("target_area_urbana", "target_variable", "es_urbano", "AUR"),
]


def _entry_sql(feature: str, kind: str, sources: str, roots: str) -> str:
    known = " + ".join(f"(count({c}) > 0)::BIGINT" for c in roots.split(","))
    return f"""SELECT 'poblacion' AS table_name, '{feature}' AS feature_name, '{kind}' AS feature_type,
    '{sources}' AS source_columns, count(*) AS rows, count({feature}) AS known_values, '{roots}' AS root_columns,
    {known} AS known_roots, count({feature}) > 0 AND {known} = {roots.count(",") + 1} AS supported FROM {CENSUS_TARGETS}"""


@query("i22_feature_catalog", " UNION ALL ".join(_entry_sql(*entry) for entry in CATALOG))
def i22(spark, sf):
    from tallyweave.operators.catalog import feature_usage

    usage = feature_usage(_census_targets(spark, sf), "poblacion").drop("description", "creation_method", "data_type")
    joined = {c: F.array_join(c, ",") for c in ("source_columns", "root_columns")}
    return usage.withColumns(joined)
