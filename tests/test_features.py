import pytest

from tallyweave import presets
from tallyweave.operators import catalog, features

AGES = ["0", "4", "5", "11", "12", "14", "15", "17", "18", "26", "27", "59", "60", "64", "65", "120", None, "x"]


def by(df, key, c):
    return {r[key]: r[c] for r in df.collect()}


def test_age_rules_at_the_boundaries(spark):
    df = features.age_features(spark.createDataFrame([(a,) for a in AGES], "P03 string"))
    detail = by(df, "P03", "grupo_edad_detallado")
    assert [detail[a] for a in ("4", "5", "11", "12", "17", "18", "26", "27", "59", "60")] == [
        "PRIMERA_INFANCIA", "INFANCIA", "INFANCIA", "ADOLESCENCIA", "ADOLESCENCIA",
        "JUVENTUD", "JUVENTUD", "ADULTEZ", "ADULTEZ", "ADULTO_MAYOR",
    ]
    assert detail[None] == detail["x"] == "ADULTO_MAYOR"
    economic = by(df, "P03", "grupo_edad_economico")
    assert (economic["14"], economic["15"], economic["64"], economic["65"], economic[None]) == (
        "DEPENDIENTE_MENOR", "POBLACION_ACTIVA", "POBLACION_ACTIVA", "DEPENDIENTE_MAYOR", "DEPENDIENTE_MAYOR",
    )
    dependant = by(df, "P03", "es_dependiente_demografico")
    active = by(df, "P03", "es_poblacion_activa")
    assert (dependant["14"], dependant["15"], dependant["64"], dependant["65"], dependant[None]) == (1, 0, 0, 1, 0)
    assert (active["14"], active["15"], active["64"], active["65"], active["x"]) == (0, 1, 1, 0, 0)


def test_null_label(spark):
    df = spark.createDataFrame([("3",), (None,)], "P03 string")
    out = features.age_features(df, null_label="SIN_DATO")
    assert by(out, "P03", "grupo_edad_detallado") == {"3": "PRIMERA_INFANCIA", None: "SIN_DATO"}


def test_absent_columns_leave_the_table_alone(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for rule in (features.age_features, features.sex_features, features.education_features,
                 features.vulnerability_index, features.development_index, features.census_targets):
        assert rule(df).columns == ["a"]


def test_sex_of_text_and_number(spark):
    for schema, rows in (("P02 string", [("1",), ("2",), ("9",), (None,)]), ("P02 int", [(1,), (2,), (9,), (None,)])):
        out = features.sex_features(spark.createDataFrame(rows, schema)).collect()
        assert [r.sexo_descripcion for r in out] == ["HOMBRE", "MUJER", "NO_ESPECIFICADO", "NO_ESPECIFICADO"]
        assert [(r.es_mujer, r.es_hombre) for r in out] == [(0, 1), (1, 0), (0, 0), (0, 0)]


def test_education_level_first_match_wins(spark):
    texts = ["Analfabeta", "Primaria", "Secundaria superior", "Superior universitario", "Maestria", "Otro", None]
    df = spark.createDataFrame([(t,) for t in texts], "escolaridad string")
    out = by(features.education_features(df), "escolaridad", "nivel_educativo_numerico")
    assert [out[t] for t in texts] == [0, 1, 2, 3, 4, 1, 1]


@pytest.mark.parametrize(
    ("value", "label"), [(0.39, "BAJA"), (0.4, "MEDIA"), (0.69, "MEDIA"), (0.7, "ALTA")]
)
def test_index_cuts(spark, value, label):
    from pyspark.sql import functions as F

    df = features._categorised(spark.range(1), [F.lit(value)], "i", "c", presets.VULNERABILITY_LABELS)
    assert df.first().c == label


def test_vulnerability_uses_the_components_there_are(spark):
    one = spark.createDataFrame([(1,)], "es_dependiente_demografico int")
    assert features.vulnerability_index(one).first().indice_vulnerabilidad_compuesto == 1.0
    level = spark.createDataFrame([(1,)], "nivel_educativo_numerico int")
    assert features.vulnerability_index(level).first().indice_vulnerabilidad_compuesto == 0.75
    three = spark.createDataFrame(
        [(1, 1, "Inactivo")], "es_dependiente_demografico int, tiene_educacion_superior int, ocupacion string"
    )
    row = features.vulnerability_index(three).first()
    assert abs(row.indice_vulnerabilidad_compuesto - 2 / 3) < 1e-12 and row.categoria_vulnerabilidad == "MEDIA"


def test_survey_targets_ignore_derived_columns(spark):
    df = spark.createDataFrame([("ALTA", "Asalariado", "399"), ("x", None, "400")], "categoria_v string, ocup string, ingrl string")
    out = features.survey_targets(df, ["ocupacion_no", "ingrl"][1:])
    assert "target_empleo_formal" not in out.columns
    assert [r.target_ingresos_suficientes for r in out.collect()] == [0.0, 1.0]


def test_income_bands(spark):
    df = spark.createDataFrame([("399",), ("400",), ("1499",), ("1500",), (None,)], "ingrl string")
    assert [r.nivel_ingreso for r in features.income_bands(df).collect()] == ["bajo", "medio", "alto", "superior", None]


def test_person_features_and_catalog(spark, census):
    out = features.table_features(census["poblacion"], "poblacion")
    assert out.count() == 4
    usage = catalog.feature_usage(out, "poblacion")
    counts = {r.feature_type: r.features for r in catalog.features_by_type(usage).collect()}
    assert counts == {"demographic": 10, "distributed_aggregate": 10, "composite_index": 4, "target_variable": 3}
    cover = {r.question: r.coverage_adequate for r in catalog.question_coverage(usage).collect()}
    assert set(cover.values()) == {True}
    assert catalog.feature_catalog(spark, out.columns).count() == 27


def test_support_follows_the_rows(spark, census):
    from pyspark.sql import functions as F

    def support(df):
        usage = catalog.feature_usage(features.table_features(df, "poblacion"), "poblacion")
        kinds = {r.feature_type: r.supported_features for r in catalog.features_by_type(usage).collect()}
        return kinds, {r.question: r.coverage_adequate for r in catalog.question_coverage(usage).collect()}

    persons = census["poblacion"]
    kinds, cover = support(persons)
    # without any age: 4 rules of the age and the household's values of it go, and what is made from them
    fewer, less = support(persons.withColumn("P03", F.lit(None).cast("string")))
    assert fewer["demographic"] == kinds["demographic"] - 4
    assert fewer["distributed_aggregate"] < kinds["distributed_aggregate"]
    assert fewer["composite_index"] == 0 and fewer["target_variable"] < kinds["target_variable"]
    assert cover["question_2_automated_features"] and not less["question_2_automated_features"]
    empty, none = support(persons.limit(0))
    assert set(empty.values()) == {0} and set(none.values()) == {False}
