from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.operators import bounded, quality


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, 1, 1, "1", 25, "01"), (1, 1, 2, "2", 30, "01"), (2, 1, 1, "1", None, "02"), (3, 1, 1, "2", 45, "03")],
        "ID_VIV long, ID_HOG long, ID_PER long, P02 string, P03 long, I01 string",
    )


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "ID_VIV long, P02 string, P03 string, V01 string, H1303 string")


def score(spark, n, d):
    return spark.range(1).select(quality.quality_score(F.lit(float(n)), F.lit(float(d))).alias("s")).first().s


def test_quality_score(spark):
    assert score(spark, 0, 0) == 100.0
    assert score(spark, 50, 20) == 0.0
    assert score(spark, 2, 1) == 95.6


def test_table_quality(people, empty):
    row = quality.table_quality(people, "poblacion").first()
    assert (row.total_records, row.avg_null_percent, row.duplicate_percent, row.is_valid) == (4, 4.17, 0.0, True)
    none = quality.table_quality(empty, "vivienda").first()
    assert (none.total_records, none.quality_score, none.is_valid) == (0, 0.0, False)


def test_null_profiles(spark, people, empty):
    got = {r.column: (r.null_count, r.null_percent) for r in quality.null_profile(people).collect()}
    assert got["P03"] == (1, 25.0) and got["P02"] == (0, 0.0)
    summary = quality.null_summary(quality.null_profile(people)).first()
    assert (summary.columns_with_nulls, summary.avg_null_percent, summary.high_null_columns) == (1, 4.17, "P03")
    assert quality.null_share(empty).first().null_percent == 100.0
    assert quality.null_share(people).first().null_cells == 1


def test_duplicates_count_null_as_a_value(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 1)], "a int, b int")
    row = quality.duplicate_profile(df, ["a", "b"]).first()
    assert (row.rows, row.distinct_keys, row.duplicate_count) == (3, 2, 1)
    assert quality.duplicate_profile(df, []).first().duplicate_count == 0


def test_id_columns():
    assert quality.id_columns(["ID_VIV", "X", "ID_HOG"], "hogar") == ["ID_VIV", "ID_HOG"]
    assert quality.id_columns(["user_id", "a", "codigo_x", "ID_A", "id_b"], "otra") == ["user_id", "codigo_x", "ID_A"]


def test_schema_compliance(people):
    whole = quality.schema_compliance(people, ["P02", "P03"]).first()
    assert (whole.is_compliant, whole.compliance_percent, whole.complete_rows) == (True, 100.0, 3)
    part = quality.schema_compliance(people, ["P02", "P03", "ESCOLA"]).first()
    assert (part.is_compliant, part.compliance_percent, part.missing_columns) == (False, 66.7, "ESCOLA")


def test_type_check(people):
    got = {r.column: r for r in quality.type_check(people, {"P02": "int", "P03": "string", "I01": "string", "Z": "int"}).collect()}
    assert [got[c].type_ok for c in ("P02", "P03", "I01", "Z")] == [False, False, True, True]
    assert got["P03"].known_values == 3


def test_structure_check(people):
    row = quality.structure_check(people, presets.SCHEMAS["poblacion"]).first()
    assert (row.is_valid, row.missing_required, row.missing_keys) == (False, "I02", "")
    assert abs(row.compliance_score - 600 / 7) < 1e-9


def test_domain_coverage(spark):
    df = spark.createDataFrame([(f"{i:02d}",) for i in range(1, 22)] + [(None,), ("99",)], "p string")
    row = quality.domain_coverage(df, "p").first()
    assert (row.covered, row.coverage_percent, row.missing, row.adequate) == (21, 87.5, "22,23,24", True)
    few = quality.domain_coverage(df.limit(3), "p").first()
    assert (few.covered, few.adequate) == (3, False)


def test_domain_difference(spark):
    a = spark.createDataFrame([("1",), ("1",), ("3",)], "k string")
    b = spark.createDataFrame([("1",), ("2",)], "k string")
    got = {r.k: r.status for r in quality.domain_difference(a, b, "k").collect()}
    assert got == {"1": "both", "2": "domain_only", "3": "observed_only"}


def test_threshold_profiles(spark):
    df = spark.createDataFrame([(0.08, 500, 0.0)], "null_share double, rows long, duplicate_share double")
    flags = lambda p: tuple(quality.threshold_check(df, p).first())[3:]
    assert flags(None) == (False, False, True)
    assert flags("development") == (True, True, True)
    assert flags("production") == (False, False, True)


def test_skew(spark):
    df = spark.createDataFrame([(1,)] * 8 + [(2,)] * 2, "k int")
    row = quality.skew_report(df, "k").first()
    assert (row.groups, row.rows, row.max_size, row.min_size, row.skew_ratio, row.is_skewed) == (2, 10, 8, 2, 4.0, True)


def test_check_score(spark, empty):
    rows = lambda flags: spark.createDataFrame([("t", str(i), f) for i, f in enumerate(flags)], "table_name string, check_name string, passed boolean")  # noqa: E731,E501
    assert quality.overall_score(rows([True, True, True, False])).first().overall_quality_score == 75.0
    assert quality.overall_score(rows([])).first().overall_quality_score == 0.0
    checks = quality.census_checks({"vivienda": empty, "hogar": empty.withColumn("ID_HOG", F.lit(1))})
    got = {(r.table_name, r.check_name): r.passed for r in checks.collect()}
    assert got[("hogar", "household_size_reasonable")] is False and got[("vivienda", "required_columns_present")] is True


def test_person_ages_out_of_range_and_text(spark):
    base = spark.range(1001).select(F.col("id").alias("ID_VIV"), F.lit(1).alias("ID_HOG"), F.lit(1).alias("ID_PER"))
    good = base.withColumn("P03", F.when(F.col("ID_VIV") == 0, "x").otherwise("30"))
    bad = base.withColumn("P03", F.when(F.col("ID_VIV") == 0, "121").otherwise("30"))
    flag = lambda df: {r.check_name: r.passed for r in quality.person_checks(df).collect()}
    assert all(flag(good).values())
    assert flag(bad)["age_values_reasonable"] is False


def test_wide_table_score(spark):
    df = spark.range(1).select(
        quality.wide_table_score(F.lit(10.0), F.lit(4.0), F.lit(24), F.lit(12)).alias("s")
    )
    assert df.first().s == pytest.approx(0.3 * 80 + 0.4 * 80 + 0.2 * 96 + 0.1 * 24, abs=0.051)


def test_wide_table_metrics_and_load_report(people):
    row = quality.wide_table_metrics(people.withColumn("es_x", F.lit(1)).withColumn("target_a", F.lit(0.0)), "censo_master").first()
    assert (row.record_count, row.geographic_coverage, row.feature_count, row.target_variables) == (4, 3, 1, "target_a")
    report = {r.table_name: (r.kind, r.rows) for r in quality.load_report({"poblacion": people, "dict_x": people}).collect()}
    assert report == {"poblacion": ("data", 4), "dict_x": ("dictionary", 4)}


def test_empty_tables_have_profiles(empty):
    for metrics in (quality.null_profile(empty), quality.null_share(empty), quality.schema_profile(empty),
                    quality.table_metadata(empty, "t"), quality.skew_report(empty, "P02"),
                    quality.duplicate_profile(empty, ["ID_VIV"]), quality.domain_coverage(empty, "P02"),
                    bounded.size_estimate(empty)):
        assert metrics.count() >= 1
    assert isinstance(reduce(DataFrame.unionByName, [empty]), DataFrame)


def test_small_sides(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    assert bounded.small_copy(df, max_rows=9) is None
    assert bounded.small_copy(df, max_bytes=500) is None
    assert bounded.small_copy(df).count() == 10
    assert "ResolvedHint" in bounded.broadcast_small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded.broadcast_small(df, 0.0001)._jdf.queryExecution().analyzed().toString()
