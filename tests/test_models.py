import random
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import catalog, indexing, models, search, trees, trials

SMALL = {
    "RandomForest": {"numTrees": 3, "maxDepth": 3},
    "GradientBoosting": {"maxIter": 2, "maxDepth": 2},
    "LogisticRegression": {"maxIter": 5, "regParam": 0.01},
}
GRID = {"LogisticRegression": {"regParam": [0.01, 0.1]}}


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        edad, urbano = rng.randint(0, 90), rng.randint(0, 1)
        label = 1.0 if edad + 20 * urbano + rng.gauss(0, 10) > 60 else 0.0
        group = "A" if edad < 30 else "B"
        rows.append((i, 1, 1, edad, group, urbano, rng.randint(0, 1), rng.random(), rng.randint(0, 4), label))
    return spark.createDataFrame(
        rows,
        "idVivienda long, idHogar long, idPersona long, edad int, grupo_edad_detallado string, es_poblacion_activa int, "
        "es_mujer int, indice_x double, nivel_educativo_numerico int, target_jefe_hogar double",
    ).withColumns({"sexo_descripcion": F.when(F.col("es_mujer") == 1, "M").otherwise("H"), "es_urbano": F.col("es_poblacion_activa")}).cache()


def test_preparation_errors(spark, wide):
    with pytest.raises(ValueError, match="no features"):
        models.prepared(wide, "target_jefe_hogar", ["falta"])
    with pytest.raises(ValueError, match="no target"):
        models.prepared(wide, "falta", ["edad"])
    with pytest.raises(ValueError, match="fewer than two"):
        models.prepared(wide.withColumn("t", F.lit(1.0)), "t", ["edad"])
    with pytest.raises(ValueError, match="smallest class"):
        models.prepared(wide.withColumn("t", (F.col("idVivienda") < 99).cast("double")), "t", ["edad"])
    data, names = models.prepared(wide, "target_jefe_hogar", ["edad", "falta"])
    assert names == ["edad"] and data.columns == ["edad", "target_jefe_hogar", "label"]


def test_types_decide_the_stages(wide):
    numeric, text = models.by_type(wide, ["edad", "grupo_edad_detallado", "indice_x"])
    assert (numeric, text) == (["edad", "indice_x"], ["grupo_edad_detallado"])
    with pytest.raises(ValueError, match="unknown model"):
        models.classifier("Otro")


def test_numbers_as_text_and_texts_of_many_values(wide):
    df = wide.withColumn("edad", F.col("edad").cast("string")).withColumn("nombre", F.col("idVivienda").cast("string"))
    data, names = models.prepared(df, "target_jefe_hogar", ["edad", "nombre", "grupo_edad_detallado"])
    assert dict(data.dtypes)["edad"] == "double"
    assert names == ["edad", "nombre", "grupo_edad_detallado"]


def test_settings_and_grids(wide):
    rf = models.classifier("RandomForest", "tuned")
    assert (rf.getNumTrees(), rf.getMaxDepth(), rf.getMinInstancesPerNode(), rf.getSeed()) == (50, 15, 10, 42)
    gbt = models.classifier("GradientBoosting")
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getSeed()) == (20, 10, 42)
    lr = models.classifier("LogisticRegression", "tuned")
    assert (lr.getMaxIter(), lr.getRegParam(), lr.getElasticNetParam()) == (100, 0.01, 0.1)
    for kind, size in (("RandomForest", 8), ("GradientBoosting", 8), ("LogisticRegression", 9)):
        assert len(search.grid_points(kind, models.GRIDS)) == size


def test_hash_split_is_whole_and_stable(wide):
    train, test = models.hash_split(wide, ["idVivienda"])
    assert train.count() + test.count() == 1200 and 0.75 < train.count() / 1200 < 0.85
    again, _ = models.hash_split(wide.repartition(7), ["idVivienda"])
    assert {r.idVivienda for r in again.collect()} == {r.idVivienda for r in train.collect()}


def test_rank_auc_equals_the_evaluator_of_the_library(spark):
    rng = random.Random(8)
    rows = [(float(rng.randint(0, 60)) if rng.random() < 0.5 else rng.random() * 60, rng.choice([0.0, 1.0, 1.0])) for _ in range(3000)]
    df = spark.createDataFrame([*rows, (None, 1.0), (3.0, None)], "s double, label double")
    theirs = models.auc_evaluator("s").setNumBins(0).evaluate(df.dropna())
    assert models.rank_auc(df, "s").first().auc == pytest.approx(theirs, abs=1e-12)
    assert models.rank_auc(df.where("label = 1"), "s").first().auc is None
    assert models.rank_auc(df.limit(0), "s").first().auc is None


def test_vote_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "a double, b double")
    got = df.select(models.vote(["a", "b"]), models.vote(["a", "b"], "majority")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    with pytest.raises(ValueError, match="rule"):
        models.vote(["a"], "otra")


def test_leaking_features_are_left_out():
    found = catalog.sources_of("target_vulnerabilidad_alta")
    assert {"categoria_vulnerabilidad", "indice_vulnerabilidad_compuesto", "es_dependiente_demografico"} <= found
    assert catalog.sources_of("target_area_urbana") == {"es_urbano", "AUR"}


@pytest.mark.parametrize("target", [f[0] for f in models.presets.FEATURES if f[0].startswith("target_")])
def test_chosen_features_hold_no_key_and_no_source_of_the_target(wide, target):
    names = [*models.presets.CENSUS_PERSON_COLUMNS.values(), "ingresoLaboral", "horasTrabajadasSemana", "nivel_instruccion",
             "ocupacion", "parentesco", *[f[0] for f in models.presets.FEATURES]]
    df = wide.sparkSession.createDataFrame([], ", ".join(f"`{n}` string" for n in dict.fromkeys(names)))
    keys = set(models.presets.WIDE_TABLE_KEYS)
    forbidden = {
        "target_vulnerabilidad_alta": {"edad", "es_poblacion_activa", "nivel_educativo_numerico", "ocupacion", "categoria_desarrollo"},
        "target_educacion_superior": {"nivel_instruccion", "nivel_educativo_numerico", "indice_vulnerabilidad_compuesto"},
        "target_jefe_hogar": {"parentesco"},
        "target_area_urbana": {"es_urbano", "indice_desarrollo_compuesto"},
        "target_area_urbana_enemdu": {"es_urbano", "indice_desarrollo_compuesto"},
        "target_empleo_formal": {"ocupacion", "categoria_vulnerabilidad", "indice_vulnerabilidad_compuesto"},
        "target_ingresos_suficientes": {"ingresoLaboral"},
    }[target]
    for choose in (models.benchmark_features, models.baseline_features, models.automated_features, models.ensemble_features, models.relevant_features):
        chosen = set(choose(df, target))
        assert not chosen & (keys | forbidden) and not any(c.startswith("target_") for c in chosen)
    assert "sexoCodigo" not in models.relevant_features(df, target)


def test_index_equals_the_indexer_of_the_library(spark, wide):
    from pyspark.ml.feature import StringIndexer

    df = wide.withColumn("nombre", F.concat(F.lit("n"), (F.col("idVivienda") % 300).cast("string"))).withColumn(
        "nombre", F.when(F.col("idVivienda") % 7 != 0, F.col("nombre"))
    )
    columns, names = ["nombre", "sexo_descripcion"], ["a", "b"]
    theirs = StringIndexer(inputCols=columns, outputCols=names, handleInvalid="skip").fit(df).transform(df)
    ours = indexing.FrequencyIndexer(columns, names).fit(df).transform(df)
    get = lambda out: sorted(map(tuple, out.select("idVivienda", *names).collect()))
    assert get(ours) == get(theirs)


def test_a_text_of_very_many_values_trains_and_is_saved(spark, tmp_path):
    df = spark.range(120_000).select(
        "id", F.md5(F.col("id").cast("string")).alias("nombre"), (F.col("id") % 2).cast("double").alias("label"),
        F.when(F.col("id") % 3 == 0, F.lit("uno")).otherwise(F.col("id").cast("string")).alias("frecuente"),
    )
    model = models.model_pipeline(df, ["nombre", "frecuente"], "LogisticRegression", SMALL).fit(df)
    models.save_model(model, str(tmp_path / "m"), {"target": "x"})
    again, _ = models.load_model(spark, str(tmp_path / "m"))
    sums = [m.transform(df).agg(F.count("*"), F.sum("nombre_indexed"), F.max("frecuente_indexed"), F.sum("prediction")).first() for m in (model, again)]
    assert sums[0] == sums[1] and sums[0][0] == 120_000 and sums[0][1] == 120_000 * 119_999 / 2
    assert sums[0][2] == 80_000
    assert model.transform(df.withColumn("nombre", F.lit("otro"))).count() == 0


def test_a_search_that_was_cut_off_fits_only_what_is_missing(spark, wide, tmp_path, monkeypatch):
    grids = {"LogisticRegression": {"regParam": [0.01, 0.1]}, "RandomForest": {"numTrees": [2, 3], "maxDepth": [2]}}
    split = trials.split_data(wide, "target_jefe_hogar", ["edad", "grupo_edad_detallado"], trials.TrialSettings())
    fits, whole = [], models.classifier

    def counted(model_type, *args):
        if len(fits) == 5:
            raise ValueError("driver lost")
        fits.append(model_type)
        return whole(model_type, *args)

    monkeypatch.setattr(models, "classifier", counted)
    ask = lambda: search.searched(split.train, split.features, str(tmp_path), "s", list(grids), SMALL, grids, 2, side_by_side=1)
    with pytest.raises(ValueError, match="driver lost"):
        ask()
    assert len(fits) == 5
    fits.append("again")
    scores = ask()
    assert len(fits) == 9 and scores.count() == 8
    ask()
    assert len(fits) == 9
    split.release()
    points = {(r.model_type, r.grid_point): r for r in search.point_scores(scores).collect()}
    assert len(points) == 4 and all(r.folds == 2 and 0.5 < r.mean_auc <= 1 for r in points.values())
    for r in search.best_points(scores).collect():
        assert r.mean_auc == max(p.mean_auc for k, p in points.items() if k[0] == r.model_type)


def test_folds_do_not_depend_on_the_order_of_rows(wide, tmp_path):
    def found(df):
        split = trials.split_data(df, "target_jefe_hogar", ["edad", "es_urbano"], trials.TrialSettings())
        try:
            scores = search.searched(split.train, split.features, str(tmp_path / uuid.uuid4().hex), "s", ["LogisticRegression"], SMALL, GRID, 2)
            return [r.auc for r in scores.orderBy("grid_point", "fold").collect()]
        finally:
            split.release()

    assert found(wide) == pytest.approx(found(wide.repartition(5, "edad")), abs=1e-9)


def test_trials(wide):
    settings = trials.TrialSettings(estimators=SMALL)
    for rows, size in (
        (trials.timed_benchmark(wide, "censo_master", settings), 1),
        (trials.model_comparison(wide, "censo_master", settings), 3),
        (trials.ensemble_trial(wide, "censo_master", settings), 1),
        (trials.feature_set_comparison(wide, "censo_master", settings), 2),
    ):
        assert len(rows) == size
        for r in rows:
            row = dict(zip([f.split()[0] for f in trials.EXPERIMENT_SCHEMA.split(", ")], r))
            assert row["success"], row["error_message"]
            assert 0.0 <= row["auc_score"] <= 1.0 and row["training_records"] + row["testing_records"] == 1200


def test_failures_are_rows(wide):
    few = wide.limit(50)
    rows = trials.timed_benchmark(few, "x_master", trials.TrialSettings(estimators=SMALL))
    assert rows[0][-2] is False and "smallest class" in rows[0][-1]


def test_training_tunes_saves_and_explains(spark, wide, tmp_path):
    settings = trials.TrialSettings(estimators=SMALL, grids=GRID, folds=2)
    row = trials.train_all(spark, {"m": wide}, str(tmp_path), settings, ["LogisticRegression"]).first()
    assert row.success, row.error_message
    assert set(row.best_parameters) == {"regParam"} and 0.5 < row.validation_auc_score <= 1.0
    model, metadata = models.load_model(spark, row.model_path)
    assert metadata["target"] == "target_jefe_hogar"
    again = trials.train_all(spark, {"m": wide}, str(tmp_path), settings, ["LogisticRegression"]).first()
    assert again == row
    assert model.transform(models.training_data(wide, "target_jefe_hogar", models.relevant_features(wide, "target_jefe_hogar"))).count() == 1200


def test_importance_follows_the_assembled_order(wide):
    names = ["grupo_edad_detallado", "edad", "indice_x"]
    data, _ = models.prepared(wide, "target_jefe_hogar", names)
    model = models.model_pipeline(data, names, "RandomForest", SMALL).fit(data)
    importance = dict(models.feature_importance(model))
    assert list(importance) == ["edad", "indice_x", "grupo_edad_detallado"]
    assert importance["edad"] > importance["indice_x"]


def test_rows_to_fit_are_spread(spark):
    # one file of many rows came as one partition, so that one core did all passes of a fit
    cores = spark.sparkContext.defaultParallelism
    many = models.spread_rows(spark.range(10_000 * cores, numPartitions=1))
    assert many.rdd.getNumPartitions() == cores and many.count() == 10_000 * cores
    few = models.spread_rows(spark.range(100, numPartitions=40))
    assert few.rdd.getNumPartitions() == 1 and few.agg({"id": "sum"}).first()[0] == 4950
    assert models.fit_partitions(100_000_000, 12) == 200
    many.unpersist(), few.unpersist()


def test_experiments_run_side_by_side(spark):
    # each waits for the others: one after another they would never end
    meet = threading.Barrier(3, timeout=60)
    assert trials._together(spark, [lambda i=i: (meet.wait(), i)[1] for i in range(3)]) == [0, 1, 2]


def test_the_query_that_trains_all_searches_whole_grids(spark, wide, monkeypatch):
    # it had one target, two folds and two points a type
    from contract import k_models

    seen = {}

    def caught(spark, tables, folder, settings, model_types=models.presets.MODEL_TYPES, targets=2):
        seen.update(tables=list(tables), grids=settings.grids, folds=settings.folds, types=list(model_types), targets=targets)

    monkeypatch.setattr(k_models, "views", lambda spark, sf: {})
    monkeypatch.setattr(k_models, "silver_tables", lambda tables: ({"censo_master": wide, "enemdu_master": wide}, []))
    monkeypatch.setattr(trials, "train_all", caught)
    k_models.k24(spark, "")
    assert seen == {
        "tables": ["censo_master", "enemdu_master"], "grids": models.GRIDS, "folds": 3, "types": models.presets.MODEL_TYPES, "targets": 2,
    }


@pytest.fixture(scope="module")
def many(spark):
    """120,000 rows ready for a fit: values of few kinds, of many, and one that never changes."""
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(120_000, numPartitions=4).selectExpr(
        "CAST(abs(hash(id, 1)) % 7 AS DOUBLE) AS a", "CAST(abs(hash(id, 2)) % 9 AS DOUBLE) AS b",
        "CAST(abs(hash(id, 3)) % 10007 AS DOUBLE) / 10007 AS c", "0.0D AS d", "abs(hash(id, 4)) % 100 AS noise", "id",
    )
    df = df.selectExpr("*", "CAST(a + b + 4 * c + noise / 25 > 10 AS DOUBLE) AS label")
    ready = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="scaled_features").transform(df)
    return ready.select("label", "scaled_features", *"abcd", (F.col("id") % 10 / 10).alias("fold_place")).cache()


@pytest.mark.parametrize("model_type, settings", [
    ("GradientBoosting", {"maxIter": 4, "maxDepth": 4, "stepSize": 0.2}),
    ("RandomForest", {"numTrees": 12, "maxDepth": 6, "minInstancesPerNode": 20}),
])
def test_trees_from_counted_rows_are_those_of_the_library(spark, many, model_type, settings, tmp_path):
    estimator = models.classifier(model_type, {model_type: settings})
    found = trees.counts(many)
    ours, theirs = trees.fitted(found, estimator, model_type, settings, 42), estimator.fit(many)
    found.release()
    assert type(ours) is type(theirs) and len(ours.trees) == len(theirs.trees)
    assert ours.getOrDefault("maxDepth") == settings["maxDepth"] == max(t.depth for t in ours.trees)
    got, want = (models.scores(m.transform(many)) for m in (ours, theirs))
    assert got == pytest.approx(want, abs=0.003)
    assert list(ours.featureImportances.toArray()) == pytest.approx(list(theirs.featureImportances.toArray()), abs=0.06)
    if model_type == "GradientBoosting":
        # nothing is drawn: the first splits and all leaves of values of few kinds are the same
        assert ours.trees[0].toDebugString.split("\n")[1:3] == theirs.trees[0].toDebugString.split("\n")[1:3]
    ours.write().save(str(tmp_path / "m"))
    again = type(ours).load(str(tmp_path / "m"))
    assert models.scores(again.transform(many)) == pytest.approx(got, abs=1e-9)


def test_boosted_trees_of_few_values_equal_the_library_in_every_row(spark, many):
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=["a", "b", "d"], outputCol="scaled_features").transform(many.drop("scaled_features"))
    settings = {"maxIter": 5, "maxDepth": 4, "stepSize": 0.1}
    estimator = models.classifier("GradientBoosting", {"GradientBoosting": settings})
    found = trees.counts(df)
    ours, theirs = trees.fitted(found, estimator, "GradientBoosting", settings, 42), estimator.fit(df)
    found.release()
    margins = [{(r.a, r.b): r.rawPrediction[1] for r in m.transform(df).select("a", "b", "rawPrediction").distinct().collect()} for m in (ours, theirs)]
    assert margins[0] == pytest.approx(margins[1], abs=1e-9) and len(margins[0]) == 63


def test_one_fit_serves_fewer_trees_and_less_depth(spark, many):
    found = trees.counts(many)
    held = trees.counts(many, found.ends)
    for model_type, points in (
        ("RandomForest", [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": 5} for n in (3, 6) for d in (3, 8)]),
        ("GradientBoosting", [{"maxIter": n, "maxDepth": 3, "stepSize": 0.1} for n in (2, 5)]),
    ):
        together = trees.areas_by_task(found, held, model_type, points, 42)
        for point, auc in zip(points, together, strict=True):
            assert trees.areas_by_task(found, held, model_type, [point], 42) == [auc]
            model = trees.fitted(found, models.classifier(model_type, {model_type: point}), model_type, point, 42)
            assert models.auc_evaluator().setNumBins(0).evaluate(model.transform(many)) == pytest.approx(auc, abs=1e-9)
    found.release(), held.release()


def test_a_search_of_many_rows_fits_trees_once_for_points_alike(spark, many, tmp_path, monkeypatch):
    # each point of each fold was a fit of its own over all rows
    fits, whole, asked = [], models.classifier, trees.areas_by_task
    monkeypatch.setattr(models, "classifier", lambda m, *a: (fits.append(m), whole(m, *a))[1])
    monkeypatch.setattr(trees, "areas_by_task", lambda f, t, m, p, s: (fits.append((m, len(p))), asked(f, t, m, p, s))[1])
    monkeypatch.setattr(trees, "MIN_ROWS", 10_000)
    grids = {"RandomForest": {"numTrees": [2, 4], "maxDepth": [3, 5]}, "GradientBoosting": {"maxIter": [2, 3], "maxDepth": [3]},
             "LogisticRegression": {"regParam": [0.1]}}
    scores = search.searched(many.drop("scaled_features"), ["a", "b", "c"], str(tmp_path), "s", list(grids), SMALL, grids, 2)
    assert sorted(fits, key=str) == sorted([("RandomForest", 4), ("GradientBoosting", 2), "LogisticRegression"] * 2, key=str)
    assert scores.count() == 14 and all(0.8 < r.auc < 1 for r in scores.collect())


def test_rows_of_too_many_combinations_are_left_to_the_library(spark, many, monkeypatch):
    assert trees.counts(many.withColumn("label", F.col("label") + 1)) is None
    monkeypatch.setattr(trees, "MAX_CELLS", 100)
    assert trees.counts(many) is None and trees.counts(many.limit(1000)) is None
    assert not trees.fits("RandomForest", {"numTrees": 3, "impurity": "entropy"}) and not trees.fits("LogisticRegression", {})
