import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyweave.operators import layout, reports
from tallyweave.sources import ingest, sinks, tables, text, workspace


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dictionary_keys():
    assert tables.dictionary_key("ZR_Sftp_DICCIONARIO_PROVINCIA_2022.parquet") == "dict_provincia"
    assert tables.dictionary_key("ZR_Sftp_DICCIONARIO_ENEMDU_2022") == "dict_enemdu"
    assert tables.dictionary_key("Otro") == "dict_otro"
    assert tables.table_key("poblacion.parquet") == "poblacion"


def test_load_tables(spark, census, tmp_path):
    folder = str(tmp_path)
    for name in ("poblacion", "hogar", "vivienda"):
        census[name].write.parquet(f"{folder}/{name}.parquet")
    census["dict_provincia"].write.parquet(f"{folder}/ZR_Sftp_DICCIONARIO_PROVINCIA_2022.parquet")
    loaded, records = tables.load_tables(spark, folder)
    assert set(loaded) == {"poblacion", "hogar", "vivienda", "dict_provincia"}
    log = {r.table_name: r for r in spark.createDataFrame(records, tables.LOAD_SCHEMA).collect()}
    assert (log["poblacion"].rows, log["poblacion"].compliance_score, log["poblacion"].success) == (4, 100.0, True)
    assert log["enemdu_personas"].success is False and log["enemdu_personas"].error_message
    data, dicts = tables.separated(loaded)
    assert set(dicts) == {"dict_provincia"} and len(data) == 3
    with pytest.raises(ValueError, match="dict_provincia|required"):
        tables.load_tables(spark, folder, required=["poblacion", "enemdu_personas"])
    with pytest.raises(FileNotFoundError):
        tables.load_tables(spark, f"{folder}/falta")
    assert set(tables.discovered(spark, folder)) == {"poblacion", "hogar", "vivienda", "ZR_Sftp_DICCIONARIO_PROVINCIA_2022"}
    assert tables.path_size_mb(spark, f"{folder}/hogar.parquet") > 0
    assert tables.path_size_mb(spark, f"{folder}/falta.parquet") == 0.0


def test_delimited_text_quotes_and_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a|b\n01|"x|y"\n2|"dijo ""no"""\n3|"dos\nlineas"\n', encoding="utf-8")
    df = text.scan_delimited(spark, str(path), "|", multiline=True)
    assert content(df) == [("01", "x|y"), ("2", 'dijo "no"'), ("3", "dos\nlineas")]


CONTROL = """id_ingesta,estado,nombre_archivo,nombre_tabla,path_origen,path_destino,delimitador,columna_particion,grupo_ingesta,orden_grupo
2,1,b.csv,tb,{d},{d}/out,;,,g2,1
1,1,a.csv,ta,{d},{d}/out,,codigo,g1,2
3,1,c.csv,tc,{d},{d}/out,,falta,,
4,0,d.csv,td,{d},{d}/out,,,g1,1
"""


def test_control_table_and_ingestion(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "control.csv").write_text(CONTROL.format(d=d))
    (tmp_path / "a.csv").write_text("codigo,v\n01,1\n02,2\n01,3\n")
    (tmp_path / "b.csv").write_text("x;y\n1;2\n")
    control = text.load_control(spark, f"{d}/control.csv")
    rows = control.collect()
    assert [r.id_ingesta for r in rows] == ["3", "1", "2"]
    assert (rows[0].delimitador, rows[0].grupo_ingesta, rows[0].orden_grupo) == (",", "default", 1)
    assert rows[1].columna_particion == "codigo" and rows[2].columna_particion is None
    summary = {r.grupo_ingesta: r for r in text.control_summary(control).collect()}
    assert summary["g1"].entries == 1 and summary["g1"].first_entry == "2. a.csv -> ta"
    log = ingest.ingest_all(spark, text.scan_delimited(spark, f"{d}/control.csv"))
    got = {r.id_ingesta: r for r in log.collect()}
    assert got["1"].success and got["1"].records_processed == 3 and got["1"].partition_applied
    assert got["2"].success and got["2"].columns_count == 2 and not got["2"].partition_applied
    assert not got["3"].success and "no encontrado" in got["3"].error_message
    lines = tmp_path / "lines.csv"
    lines.write_text('codigo,v\n01,"one\ntwo"\n02,"say ""so"""\n')
    entry = control.first().asDict() | {"path_origen": str(tmp_path), "nombre_archivo": "lines.csv", "nombre_tabla": "tl", "delimitador": ",", "path_destino": f"{d}/out"}
    assert ingest.ingest_file(spark, Row(**entry))[2:5] == (True, 2, 2)
    assert content(tables.scan_as(spark, f"{d}/out/tl.parquet", spark.createDataFrame([], "codigo string, v string").schema)) == [("01", "one\ntwo"), ("02", 'say "so"')]
    assert [r.category for r in reports.failure_categories(log).collect()] == ["archivo_no_encontrado"]
    stats = reports.ingestion_statistics(log).first()
    assert (stats.ingestions, stats.total_records_processed, stats.files_with_partitioning) == (3, 4, 1)
    like = spark.createDataFrame([], "codigo string, v string")
    assert content(tables.scan_as(spark, f"{d}/out/ta.parquet", like.schema)) == [("01", "1"), ("01", "3"), ("02", "2")]


def test_control_table_needs_its_columns(spark):
    with pytest.raises(ValueError, match="estado"):
        text.active_control_rows(spark.createDataFrame([("1",)], "id_ingesta string"))
    none = spark.createDataFrame(
        [], "id_ingesta string, estado string, nombre_archivo string, nombre_tabla string, path_origen string, path_destino string"
    )
    assert ingest.ingest_all(spark, none).count() == 0


def test_write_and_verify(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("02", 2), ("01", 3)], "c string, v int")
    path = str(tmp_path / "t")
    sinks.write_table(df, path, "c")
    back = tables.scan_as(spark, path, df.schema)
    assert content(back) == content(df)
    assert sinks.verification(spark, path, 2, 3).first().integrity_check is True
    assert sinks.verification(spark, path, 2, 4).first().integrity_check is False
    sinks.write_table(df, path, "no_hay")
    assert content(spark.read.parquet(path)) == content(df)


def test_persisted_tables_report_their_layout(spark, tmp_path):
    df = spark.createDataFrame([("01", 30), ("02", 40)], "provinciaCodigo string, edad int")
    rows = sinks.persist_tables({"censo_master": df, "otra": df}, str(tmp_path))
    log = {r.table_name: r for r in spark.createDataFrame(rows, sinks.WRITE_SCHEMA).collect()}
    assert (log["censo_master"].partition_column, log["censo_master"].layout_applied) == ("provinciaCodigo", True)
    assert (log["otra"].partition_column, log["otra"].layout_applied) == (None, False)
    assert all(r.integrity_check for r in log.values())


def test_footers_count_the_rows_and_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(3).write.parquet(path)
    assert sinks.footer_rows(spark, path) == 1000
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    with pytest.raises(FileNotFoundError):
        sinks.footer_rows(spark, str(tmp_path / "none"))
    part = next((tmp_path / "t").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-30])
    for crc in (tmp_path / "t").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        sinks.footer_rows(spark, path)


def test_an_overwrite_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    old = spark.createDataFrame([("01", 1), ("02", 2)], "c string, v int")
    sinks.write_table(old, path, "c")
    bad = spark.range(100).select(F.lit("03").alias("c"), F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(bad, path, "c")
    assert content(tables.scan_as(spark, path, old.schema)) == content(old)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t.parquet"]
    # a table may be made from itself
    sinks.write_table(tables.scan_as(spark, path, old.schema).withColumn("v", F.col("v") + 1), path, "c")
    assert content(tables.scan_as(spark, path, old.schema)) == [("01", 2), ("02", 3)]
    # a crash between the renames leaves the old table aside: it comes back
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.old-1")
    assert sinks.recovered(spark, path) and not sinks.recovered(spark, path)
    assert content(tables.scan_as(spark, path, old.schema)) == [("01", 2), ("02", 3)]


def test_a_wide_table_is_evaluated_once_and_clustered(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(3000).select(
        (F.col("id") % 3).cast("string").alias("I01"), (F.col("id") % 97).cast("string").alias("provinciaCodigo"), (F.col("id") * 7919 % 91).cast("string").alias("edad")
    )
    path = str(tmp_path / "m.parquet")
    row = sinks.persist_table(df.mapInPandas(counted, df.schema), "censo_master", path, files=24)
    assert row[3:8] == (3000, 3, "I01", True, True) and seen.value == 3000
    back = tables.scan_as(spark, path, df.schema)
    assert content(back) == content(df)
    ranges = sinks.file_ranges(back.select(F.col("provinciaCodigo").cast("int").alias("p"), F.col("edad").cast("int").alias("e"), "_metadata"), ["p", "e"]).collect()
    assert len(ranges) >= 24 and all(r.max_p - r.min_p < 90 or r.max_e - r.min_e < 84 for r in ranges)


def test_compaction_and_clustering_keep_the_rows(spark, tmp_path):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("g"), F.rand(3).alias("x"))
    small = str(tmp_path / "small")
    df.repartition(12).write.parquet(small)
    stored = spark.read.parquet(small)
    compact = sinks.compacted(spark, small, str(tmp_path / "compact"))
    assert content(compact) == content(stored) and tables.file_sizes(compact).count() == 1
    clustered = sinks.write_clustered(stored, ["id", "x"], str(tmp_path / "z"), files=4)
    assert content(clustered) == content(stored)
    spans = clustered.groupBy(F.col("_metadata.file_path")).agg(
        (F.max("id") - F.min("id")).alias("i"), (F.max("x") - F.min("x")).alias("x")
    )
    assert all(r.i < 400 or r.x < 0.8 for r in spans.collect())


def test_partition_counts():
    assert [layout.ingest_partitions(n) for n in (10, 1_000_000, 1_000_001, 5_000_000, 10**9)] == [4, 4, 20, 100, 200]
    assert [layout.persist_partitions(n) for n in (10, 1_000_001, 5_000_001)] == [8, 16, 32]
    assert layout.size_partitions(10**9, 10) == 3725 and layout.size_partitions(0, 10) == 1


def test_repacking_keeps_the_rows(spark):
    df = spark.range(100).repartition(12)
    for out in (layout.repacked_for_ingest(df, 100), layout.repacked_for_persist(df, 100), layout.repacked_to_size(df, 100, 12)):
        assert out.count() == 100
    assert layout.repacked_for_ingest(df, 100).rdd.getNumPartitions() == 4


def test_reports_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame([("t", 3, 1.5)], "table_name string, rows long, share double")
    path = str(tmp_path / "r")
    sinks.write_json_report(metrics, path)
    assert content(spark.read.schema(metrics.schema).json(path)) == [("t", 3, 1.5)]
    lines = reports.text_summary(metrics, {"rows": "Filas", "share": "Parte"})
    sinks.write_text_report(lines, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["Filas: 3", "Parte: 1.5"]


def test_shared_folder_is_the_one_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert workspace.new_path(spark).startswith(folder)
    df = spark.range(3)
    assert content(workspace.stored(df)) == [(0,), (1,), (2,)]


def test_experiment_and_run_summaries(spark):
    log = spark.createDataFrame(
        [("Q1", True, 0.8, 2.0, 4), ("Q1", False, 0.0, 0.0, 0), ("Q2", False, 0.0, 0.0, 0)],
        "research_question string, success boolean, auc_score double, training_time_seconds double, feature_count int",
    )
    rows = reports.experiment_summary(log).collect()
    assert [(r.research_question, r.total_experiments, r.average_auc_score) for r in rows] == [("Q1", 2, 0.8)]
    metrics = spark.createDataFrame(
        [(10, 80.0, 1.0, 0.0, 2.0, True), (30, 60.0, 3.0, 0.0, 2.0, True)],
        "record_count long, data_quality_score double, null_percentage double, duplicate_percentage double, "
        "processing_time_seconds double, success boolean",
    )
    row = reports.run_summary(metrics).first()
    assert (row.average_quality_score, row.average_throughput_records_per_second, row.quality_threshold_met) == (70.0, 10.0, False)
