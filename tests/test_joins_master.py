from tallyweave.operators import features, joins
from tallyweave.operators.groups import household_aggregates
from tallyweave.plans.master import census_master, master_tables, survey_master
from tallyweave.plans.medallion import run_silver


def test_join_keeping_equal_names(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "k int, v string")
    out = joins.join_keeping(a, b, {"k": "k"}, ["k", "v AS va"], ["v AS vb"])
    assert sorted(map(tuple, out.collect())) == [(1, "x", "p"), (1, "x", "q")]
    assert out.columns == ["k", "va", "vb"]


def test_fan_out_and_key_audit(spark):
    a = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "k int, h int")
    b = spark.createDataFrame([(1, 1), (1, 1)], "k int, h int")
    assert tuple(joins.fan_out(a, a.join(b, "k")).first()) == (3, 2, True)
    audit = {r.side: r for r in joins.join_key_audit(a, b, ["k", "h"]).collect()}
    assert (audit["left"].rows, audit["left"].distinct_keys, audit["left"].null_keys) == (3, 3, 2)
    assert (audit["right"].rows, audit["right"].distinct_keys) == (2, 1)


def test_census_master(spark, census):
    tables = dict(census)
    tables["poblacion"] = features.age_features(tables["poblacion"])
    tables["hogar"] = household_aggregates(tables["poblacion"], onto=tables["hogar"])
    wide = census_master(tables)
    assert wide.count() == 4
    row = wide.filter("idVivienda = 2 AND idPersona = 2").first()
    assert (row.edad, row.numeroDormitorios, row.tipoViviendaCodigo, row.material_techo) == ("70", 2, "2", "zinc")
    assert (row.grupo_edad_detallado, row["tamaño_hogar_calculado"], row.ratio_dependencia_hogar) == ("ADULTO_MAYOR", 2, 0.5)
    assert "V01" not in wide.columns and len(set(wide.columns)) == len(wide.columns)
    assert census_master({"poblacion": census["poblacion"]}) is None


def test_household_values_on_persons_or_households_agree(spark, census):
    direct = dict(census, poblacion=household_aggregates(census["poblacion"]))
    moved = dict(census, hogar=household_aggregates(census["poblacion"], onto=census["hogar"]))
    names = ["idVivienda", "idPersona", "tamaño_hogar_calculado", "edad_promedio_hogar", "edad_maxima_hogar"]
    rows = lambda t: sorted(map(tuple, census_master(t).select(*names).collect()))
    assert rows(direct) == rows(moved)


def test_orphans_drop_out(spark, census):
    tables = dict(census, vivienda=census["vivienda"].filter("ID_VIV = 1"))
    assert census_master(tables).count() == 2


def test_survey_master_drops_null_keys(spark):
    person = spark.createDataFrame(
        [(1, 1, 1, "40", "800", "30"), (1, 1, 2, "35", "600", "20"), (None, 1, 1, "1", "1", "1")],
        "id_vivienda long, id_hogar long, id_persona long, p24 string, ingrl string, p03 string",
    )
    home = spark.createDataFrame([(1, 1, "a", "b", "red"), (None, 1, "c", "d", "pozo")],
                                 "id_vivienda long, id_hogar long, vi01 string, vi02 string, agua string")
    wide = survey_master({"enemdu_personas": person, "enemdu_vivienda": home})
    assert sorted(map(tuple, wide.collect())) == [
        (1, 1, 1, "40", "800", "30", "a", "b", "red"),
        (1, 1, 2, "35", "600", "20", "a", "b", "red"),
    ]
    assert set(master_tables({"enemdu_personas": person, "enemdu_vivienda": home})) == {"enemdu_master"}


def test_silver_run(spark, census, tmp_path):
    run = run_silver(spark, census, str(tmp_path))
    wide = run.tables["censo_master"]
    assert wide.count() == 4 and "target_vulnerabilidad_alta" in wide.columns
    write = run.writes.first()
    assert (write.partition_column, write.integrity_check) == ("provinciaCodigo", True)
    row = wide.filter("idVivienda = 1 AND idPersona = 2").first()
    assert (row.provinciaCodigo, row.provinciaNombre, row.es_urbano) == ("01", "Azuay", 1)
    metric = run.metrics.first()
    assert metric.record_count == 4 and metric.success
    assert run.recoding_log.filter("NOT success").count() == 0
    assert run.seconds > 0
