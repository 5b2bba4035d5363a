from tallyweave.operators import geo, recode, reports


def test_lookup_pads_codes_and_keeps_orphans(spark, census):
    lookup = {r.codigo_parroquia_6d: r for r in geo.geographic_lookup(census).collect()}
    assert set(lookup) == {"010101", "020150", "030101"}
    assert (lookup["010101"].cantonNombre, lookup["010101"].provinciaNombre) == ("Cuenca", "Azuay")
    assert (lookup["030101"].cantonNombre, lookup["030101"].provinciaNombre) == (None, None)
    assert geo.geographic_lookup({"dict_canton": census["dict_canton"]}) is None
    assert geo.lookup_levels(None) == {}


def test_two_names_for_a_code_show_in_the_check(spark, census):
    more = census["dict_canton"].union(spark.createDataFrame([(101, "Otra")], "CODIGO int, NOMBRE string"))
    lookup = geo.geographic_lookup(census | {"dict_canton": more})
    check = geo.lookup_uniqueness(lookup).first()
    assert (check.rows, check.distinct_keys, check.unique) == (4, 3, False)


def test_most_specific_level_is_used(spark, census):
    levels = geo.lookup_levels(geo.geographic_lookup(census))
    df = spark.createDataFrame([("0101", "1"), ("999", "1"), (None, "1")], "CANTON string, I01 string")
    out = geo.geographic_recode(df, "poblacion", levels).collect()
    assert [r.cantonNombre for r in out] == ["Cuenca", None, None]
    assert [r.region_especifica for r in out] == ["PATRIMONIAL", "OTRAS_PROVINCIAS", "OTRAS_PROVINCIAS"]
    by_province = geo.enriched(geo.homologated(df.select("I01"), ["I01"]), levels)
    assert [r.provinciaNombre for r in by_province.collect()] == ["Azuay"] * 3


def test_large_lookup_joins_without_broadcast(spark, census, monkeypatch):
    monkeypatch.setattr(geo, "proven_small", lambda df: False)
    levels = geo.lookup_levels(geo.geographic_lookup(census))
    assert "broadcast" not in levels["codigo_canton_4d"]._jdf.queryExecution().analyzed().toString().lower()
    df = spark.createDataFrame([("101",), ("999",)], "CANTON string")
    out = geo.enriched(geo.homologated(df, ["CANTON"]), levels)
    assert sorted((r.CANTON, r.cantonNombre) for r in out.collect()) == [("101", "Cuenca"), ("999", None)]


def test_natural_regions(spark):
    codes = ["01", "18", "07", "24", "14", "22", "20", "10", "11", "17", None]
    df = spark.createDataFrame([(c,) for c in codes], "codigo_provincia_2d string")
    assert [r.region_geografica for r in geo.with_regions(df).collect()] == [
        "SIERRA", "SIERRA", "COSTA", "COSTA", "AMAZONIA", "AMAZONIA", "GALAPAGOS", "OTRAS", "OTRAS", "OTRAS", "OTRAS",
    ]


def test_urban_flag_prefers_the_survey_column(spark):
    df = spark.createDataFrame([(1, "2"), (2, "1"), (None, "1")], "area int, AUR string")
    assert [r.es_urbano for r in geo.with_urban_flag(df).collect()] == [1, 0, 0]


def test_recode_rules(spark, census):
    df = spark.createDataFrame([("1", 1, "a"), ("2", 2, "b"), ("9", None, "a"), (None, 3, None)], "P02 string, AUR int, I02 string")
    rows = census["dict_censo"].union(
        spark.createDataFrame([("P02", "2", "Dama", "sexo", "SI")], census["dict_censo"].schema)
    )
    out, done = recode.recode_table(df, rows)
    assert [r.sexo for r in out.collect()] == ["Hombre", "Mujer", "9", None]
    assert [r.AUR_recoded for r in out.collect()] == ["Urbano", "2", None, "3"]
    assert [(d.variable, d.target, d.codes) for d in done] == [("AUR", "AUR_recoded", 1), ("P02", "sexo", 3)]
    assert "ubicacion" not in out.columns


def test_large_dictionary_gives_the_same(spark, census, monkeypatch):
    rows = census["poblacion"].unionByName(census["poblacion"])
    small, a = recode.recode_table(rows, census["dict_censo"])
    monkeypatch.setattr(recode, "proven_small", lambda df: False)
    joined, b = recode.recode_table(rows, census["dict_censo"])
    assert a == b and len(a) > 1 and sorted(small.columns) == sorted(joined.columns)
    joined = joined.select(small.columns)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)


def test_a_large_dictionary_joins_once_for_all_variables(spark):
    df = spark.range(500).selectExpr("id", "id % 7 AS a", "CASE WHEN id % 3 > 0 THEN id END AS b", "1 AS c", "'x' AS lost")
    words = spark.range(300).selectExpr(
        "explode(array('a', 'b', 'c')) AS variable_codigo", "CAST(id AS string) AS codigo",
        "concat(variable_codigo, id) AS etiqueta", "CASE WHEN variable_codigo = 'c' THEN 'lost' END AS campo",
        "'SI' AS requiere_recodificacion",
    )
    mappings = recode.mappings_for(words)
    out = recode.recode_unpivoted(df, mappings, recode.recodings(mappings))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # the dictionary, and the labels with their rows
    found = {r.id: r for r in out.collect()}
    assert len(found) == 500 and out.columns == ["id", "a", "b", "c", "a_recoded", "b_recoded", "lost"]
    for i, r in found.items():
        b = None if i % 3 == 0 else f"b{i}" if i < 300 else str(i)
        assert (r.a_recoded, r.b_recoded, r.lost) == (f"a{i % 7}", b, "c1")
    assert recode.recode_unpivoted(df, mappings, []) is df


def test_codes_are_read_before_any_target_is_written(spark, monkeypatch):
    """Target of a is b, which is a variable too; both ways read the old b."""
    df = spark.createDataFrame([("1", "2"), ("2", "1"), (None, "1")], "a string, b string")
    rows = [("a", "1", "one", "b", "SI"), ("a", "2", "two", "b", "SI"), ("b", "1", "uno", "c", "SI")]
    words = spark.createDataFrame(
        rows, "variable_codigo string, codigo string, etiqueta string, campo string, requiere_recodificacion string"
    )
    expected = [(None, None, "uno"), ("1", "one", "2"), ("2", "two", "uno")]
    for small in (True, False):
        monkeypatch.setattr(recode, "proven_small", lambda df, small=small: small)
        out = recode.recode_table(df, words)[0]
        assert sorted(map(tuple, out.select("a", "b", "c").collect()), key=str) == sorted(expected, key=str)


def test_lookup_is_evaluated_once(spark, census):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    lookup = geo.geographic_lookup(census)
    counted = lookup.mapInPandas(count, lookup.schema)
    levels = geo.lookup_levels(counted)
    for level in levels.values():
        level.collect()
    assert seen.value == lookup.count()


def test_recode_all_logs_operations(spark, census):
    names = ["poblacion", "hogar", "vivienda", "dict_censo"]
    tables, log = recode.recode_all({n: census[n] for n in names}, census)
    assert tables["dict_censo"] is census["dict_censo"]
    df = spark.createDataFrame(log, recode.LOG_SCHEMA)
    stats = {(r.level, r.name): r for r in reports.operation_statistics(df).collect()}
    assert stats[("overall", None)].total_operations == 5
    assert stats[("table", "poblacion")].total_operations == 3
    assert stats[("operation", "variable_recoding")].success_rate == 100.0


def test_log_statistics(spark):
    log = spark.createDataFrame(
        [
            ("t1", "variable_recoding", "a", "b", 2, True, None),
            ("t1", "geographic_recoding", "c", "d", 1, True, None),
            ("t2", "variable_recoding", "e", "", 0, False, "boom"),
        ],
        recode.LOG_SCHEMA,
    )
    stats = {(r.level, r.name): r for r in reports.operation_statistics(log).collect()}
    total = stats[("overall", None)]
    assert (total.total_operations, total.successful_operations, total.failed_operations) == (3, 2, 1)
    assert stats[("table", "t2")].success_rate == 0.0
    assert [r.error_message for r in reports.failed_operations(log).collect()] == ["boom"]
